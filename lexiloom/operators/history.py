"""The log of lookups: cleaning, repeats, latest per key, retention, removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import describe_time, sanitize_query
from lexiloom.operators.ordered import in_blocks, previous


def clean_log(log: DataFrame) -> DataFrame:
    """Rows with a mode and a query, the query without tabs and line ends."""
    out = log.withColumn("query", sanitize_query(F.col("query")))
    return out.filter(F.col("epoch_second").isNotNull() & (F.coalesce(F.length("mode"), F.lit(0)) > 0) & F.col("query").rlike(r"\S"))


ORDER = ["epoch_second", "mode", "query"]


def drop_repeats(log: DataFrame) -> DataFrame:
    """Without rows of the same mode and query as the row kept before them in the log.

    The order is by time, then by mode and query; a run of equal rows keeps its first. A
    word asked before and after a sentence is kept both times. Rows of one moment that
    are equal are collapsed before anything is ordered; the order is cut into blocks, so
    that no mode is in one task.
    """
    rows = log.groupBy(*ORDER).agg(F.count("*").alias("n")).drop("n")
    mine = F.struct("mode", "query")
    out = previous(in_blocks(rows, ORDER), ORDER, mine, "_before")
    return out.filter(F.col("_before").isNull() | (F.col("_before") != mine)).select(*ORDER)


def latest_per_key(log: DataFrame, limit: int | None = 1000) -> DataFrame:
    """The last time of each (mode, query), newest first; a feature of ``limit`` rows."""
    last = log.groupBy("mode", "query").agg(F.max("epoch_second").alias("epoch_second"), F.count("*").alias("times"))
    newest = last.orderBy(F.col("epoch_second").desc(), "mode", "query")
    return newest if limit is None else newest.limit(limit)


def retain(log: DataFrame, keep: int = 1000, above: int = 2000) -> DataFrame:
    """The newest ``keep`` rows once the log has more than ``above``."""
    if log.count() <= above:
        return log
    return log.orderBy(F.col("epoch_second").desc(), F.col("mode"), F.col("query")).limit(keep)


def remove_keys(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Without all rows of the given (mode, query)."""
    return log.join(keys.select("mode", "query").distinct(), ["mode", "query"], "left_anti")


def matching(log: DataFrame, text: str) -> DataFrame:
    """Rows whose query holds a text in any case; a blank text keeps all."""
    return log if not text.strip() else log.filter(F.contains(F.lower("query"), F.lit(text.lower())))


def explicit(log: DataFrame) -> DataFrame:
    """Only what was asked for: rows whose ``trigger`` isn't a re-run by a switch.

    A log without that column holds nothing else.
    """
    return log.filter(~F.coalesce(F.col("trigger"), F.lit("search")).isin("mode", "source")) if "trigger" in log.columns else log


def compact(log: DataFrame, keep: int = 1000, above: int = 2000) -> DataFrame:
    """What is written back when the log is tidied: no repeats, at most the newest rows."""
    return retain(drop_repeats(clean_log(log)), keep, above)


def described(log: DataFrame, this_year: int, most: int = 110) -> DataFrame:
    """Rows as they are listed: time in short, and a preview of the query."""
    line = F.regexp_replace(F.trim("query"), r"\s+", " ")
    preview = F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most)), F.lit("…"))).otherwise(line)
    return log.select(*ORDER, describe_time(F.col("epoch_second"), this_year).alias("time"), preview.alias("preview"))

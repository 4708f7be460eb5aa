"""Plain files: tab-separated dictionaries, catalogue, word lists, log, corpus, stores."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import normalize_headword, strip_bom
from lexiloom.sources import marker

CATALOG_COLUMNS = ("id", "name", "format", "file", "entries", "enabled", "priority")


def tsv_can_read(name: str, first_lines: list[str]) -> bool:
    """Whether a file looks like a tab-separated dictionary."""
    data = [line for line in (x.removeprefix("﻿") for x in first_lines) if line.strip() and not line.startswith("#")]
    return name.lower().endswith((".tsv", ".txt")) and bool(data) and not data[0].startswith("@") and data[0].find("\t") > 0


def tsv_entries(lines: DataFrame) -> DataFrame:
    """One sense with one gloss a line: ``lines`` is ``(source_id, line_no, line)``.

    Blank lines, comments and lines without headword or gloss are skipped; quotes are
    ordinary characters (``parsed_rows`` is the strict reading).
    """
    f = F.split(strip_bom(F.col("line")), "\t")
    at = lambda i: F.trim(F.regexp_replace(F.coalesce(F.get(f, F.lit(i)), F.lit("")), r"[\r\n]+$", ""))
    rows = lines.filter(F.col("line").rlike(r"\S") & ~strip_bom(F.col("line")).startswith("#")).select("source_id", F.col("line_no").alias("source_line"), at(0).alias("headword"), at(1).alias("gloss"), at(2).alias("pos"))
    rows = rows.filter((F.col("headword") != "") & (F.col("gloss") != ""))
    none = F.array().cast("array<struct<en:string,vi:string,gloss_index:int>>")
    sense = F.struct(F.when(F.col("pos") != "", F.col("pos")).alias("pos"), F.array("gloss").alias("glosses"), none.alias("examples"))
    return rows.select("source_id", "source_line", "headword", normalize_headword(F.col("headword")).alias("headword_norm"), F.array(sense).alias("senses"))


def read_tsv(spark: SparkSession, path: str, source_id: int) -> DataFrame:
    return tsv_entries(marker.read_lines(spark, path, source_id))


#: Readers by format: whether they take a file, and how they read it.
READERS = {
    "marker": (lambda name, lines: marker.can_read(lines), lambda spark, path, i: marker.entries(marker.read_lines(spark, path, i))),
    "tsv": (tsv_can_read, read_tsv),
}


def pick_reader(name: str, first_lines: list[str]):
    """The format of a file and its reader; none that takes it is an error."""
    for form, (takes, read) in READERS.items():
        if takes(name, first_lines):
            return form, read
    raise ValueError(f"no reader takes {name}")


def read_dictionary(spark: SparkSession, path: str, source_id: int) -> DataFrame:
    """Entries of a file in whichever format takes it."""
    first = [r["value"] for r in spark.read.text(path).limit(20).collect()]
    return pick_reader(Path(path).name, first)[1](spark, path, source_id)


def display_name(name: str, first_lines: list[str]) -> str:
    """The ``# name:`` of the first ten lines, else the file's stem."""
    for line in first_lines[:10]:
        if line.removeprefix("﻿").startswith("# name:"):
            return line.split(":", 1)[1].strip()
    return Path(name).stem


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of sources; numbers that are none are an error."""
    rows = spark.read.text(path).filter(F.col("value").rlike(r"\S") & ~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= len(CATALOG_COLUMNS))
    return rows.select(*[F.get("f", F.lit(i)).cast("int" if c in ("id", "entries", "enabled", "priority") else "string").alias(c) for i, c in enumerate(CATALOG_COLUMNS)])


def catalog_or_default(spark: SparkSession, path: str, name: str, entries: int) -> DataFrame:
    """The catalogue, or a single source where it is missing or empty."""
    kind = "id int, name string, format string, file string, entries int, enabled int, priority int"
    try:
        found = read_catalog(spark, path)
        if not found.isEmpty():
            return found
    except AnalysisException:
        pass
    return spark.createDataFrame([(0, name, "", "", entries, 1, 0)], kind)


def write_catalog(sources: DataFrame, path: str) -> None:
    text = sources.orderBy("priority", "id").select(F.concat_ws("\t", *[F.col(c).cast("string") for c in CATALOG_COLUMNS]).alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).filter((F.col("word") != "") & ~F.col("word").startswith("#"))


def write_words(words: DataFrame, path: str) -> None:
    words.distinct().orderBy("word").select(F.col("word").alias("value")).write.mode("overwrite").text(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Log lines ``seconds TAB mode TAB query``; broken ones are left out."""
    f = F.split("value", "\t", 3)
    rows = spark.read.text(path).filter(F.size(f) == 3)
    out = rows.select(F.expr("try_cast(split(value, '\t', 3)[0] as bigint)").alias("epoch_second"), F.get(f, F.lit(1)).alias("mode"), F.get(f, F.lit(2)).alias("query"))
    return out.filter(F.col("epoch_second").isNotNull() & (F.col("mode") != "") & F.col("query").rlike(r"\S"))


def append_history(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws("\t", F.col("epoch_second").cast("string"), "mode", "query").alias("value")).write.mode("append").text(path)


def rewrite_history(rows: DataFrame, path: str, fresh: str) -> None:
    """The whole log anew: written to ``fresh`` first, then put into the place of ``path``."""
    rows.orderBy("epoch_second", "mode", "query").select(F.concat_ws("\t", F.col("epoch_second").cast("string"), "mode", "query").alias("value")).write.mode("overwrite").text(fresh)
    spark = rows.sparkSession
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{fresh} can't be moved to {path}")


def tokenizer_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``(id, piece, score)`` of a tokenizer file that lists ``[piece, score]`` pairs."""
    kind = "model struct<vocab:array<array<string>>>"
    rows = spark.read.schema(kind).json(path, multiLine=True).select(F.posexplode("model.vocab").alias("id", "v"))
    return rows.select("id", F.get("v", F.lit(0)).alias("piece"), F.get("v", F.lit(1)).cast("double").alias("score"))


def read_pairs(spark: SparkSession, en_path: str, vi_path: str) -> DataFrame:
    """Two line-aligned corpora as one table; the longer one's rest is left out.

    A side of several files is read on through them in the order of their paths.
    """
    en, vi = marker.read_lines(spark, en_path, 0, across_files=True), marker.read_lines(spark, vi_path, 0, across_files=True)
    return en.select("line_no", F.col("line").alias("en")).join(vi.select("line_no", F.col("line").alias("vi")), "line_no")

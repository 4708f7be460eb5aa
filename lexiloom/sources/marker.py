"""Dictionaries of marked lines: ``@`` entry, ``*`` part of speech, ``-`` gloss, ``=``
example, ``!`` idiom, ``+`` cross-reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions.text import collapse_spaces, normalize_headword, strip_bom
from lexiloom.operators.ordered import BLOCK, in_blocks, latest


def can_read(first_lines: list[str]) -> bool:
    return any(line.removeprefix("﻿").startswith("@") for line in first_lines[:20])


def read_lines(spark: SparkSession, path: str, source_id: int, across_files: bool = False) -> DataFrame:
    """``(source_id, file, line_no, line)``, lines numbered from 1.

    Files are read in splits. A split's rows come in order, so that a line's number is its
    place in the split and the number of lines in the splits before, of which there is a
    row each. ``across_files`` numbers on through the files in the order of their paths.
    """
    place = ["file", "start"]
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    splits = text.groupBy(*place).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = (Window.orderBy(*place) if across_files else Window.partitionBy("file").orderBy("start")).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(*place, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.col("row") - F.col("first") + F.col("before") + 1
    return text.join(splits, place).select(F.lit(source_id).alias("source_id"), "file", number.cast("long").alias("line_no"), "line")


def split_headword(raw: Column) -> dict[str, Column]:
    """Headword, pronunciation between the first slashes after a blank, and a variant."""
    found = r"^(.+?)\s+/([^/]*)(?:/(.*))?$"
    has = raw.rlike(r"^.+?\s+/")
    clean = lambda c: collapse_spaces(F.replace(c, F.lit("_"), F.lit(" ")))
    ipa = F.trim(F.regexp_extract(raw, found, 2))
    variant = F.trim(F.regexp_extract(F.regexp_extract(raw, found, 3), r"\(([^)]*)\)", 1))
    return {
        "headword": clean(F.when(has, F.regexp_extract(raw, found, 1)).otherwise(raw)),
        "ipa": F.when(has & (ipa != ""), ipa),
        "variant": F.when(has & (variant != ""), variant),
    }


def marker_lines(lines: DataFrame) -> DataFrame:
    """The non-blank lines with their marker, rest, and the entry they belong to."""
    text = F.when(F.col("line_no") == 1, strip_bom(F.col("line"))).otherwise(F.col("line"))
    rows = lines.withColumn("_t", text).filter(F.col("_t").rlike(r"\S"))
    rows = rows.withColumn("mark", F.substring("_t", 1, 1)).withColumn("rest", F.trim(F.substring("_t", 2, 1 << 30)))
    order = ["source_id", "file", "line_no"]
    head = F.when(F.col("mark") == "@", F.struct("source_id", "file", "line_no"))
    rows = latest(in_blocks(rows, order), order, head, "_head")
    mine = (F.col("_head.source_id") == F.col("source_id")) & (F.col("_head.file") == F.col("file"))
    return rows.withColumn("entry_no", F.when(mine, F.col("_head.line_no"))).drop("_t", "_head", BLOCK)


def bad_lines(lines: DataFrame) -> DataFrame:
    """Lines without a known marker, and those before the first entry."""
    return marker_lines(lines).filter(F.col("entry_no").isNull() | ~F.col("mark").isin(*"@*!-=+")).select("source_id", "file", "line_no", "line")


def bad_line_report(lines: DataFrame, samples: int = 20) -> tuple[int, list[str]]:
    """How many lines are malformed, and the first of them."""
    bad = bad_lines(lines)
    first = bad.orderBy("source_id", "file", "line_no").limit(samples).collect()
    return bad.count(), [r["line"] for r in first]


def entries(lines: DataFrame) -> DataFrame:
    """Nested entries. A gloss or example belongs to the idiom opened since the last
    ``*``, else to the sense; an example without English text is dropped."""
    rows = marker_lines(lines).filter(F.col("entry_no").isNotNull() & F.col("mark").isin(*"@*!-=+"))
    key = ["source_id", "file", "entry_no"]
    w = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda m: F.sum((F.col("mark") == m).cast("int")).over(w)
    rows = rows.withColumn("block", count("*")).withColumn("idiom", count("!"))
    rows = rows.withColumn("opened", F.last(F.when(F.col("mark").isin("*", "!"), F.col("mark")), ignorenulls=True).over(w))
    rows = rows.withColumn("place", F.when(F.col("opened") == "!", F.struct(F.lit("i").alias("k"), F.col("idiom").alias("n"))).otherwise(F.struct(F.lit("s").alias("k"), F.col("block").alias("n"))))
    parts = F.split("rest", r"\+", 2)
    en, vi = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    g = Window.partitionBy(*key, "place").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_gloss = (F.col("mark") == "-") & (F.col("rest") != "")
    rows = rows.withColumn("gloss_index", F.sum(is_gloss.cast("int")).over(g) - 1)
    gloss = F.when(is_gloss, F.struct("line_no", F.col("rest").alias("g")))
    example = F.when((F.col("mark") == "=") & (en != ""), F.struct("line_no", F.struct(en.alias("en"), F.when(vi != "", vi).alias("vi"), F.col("gloss_index").cast("int").alias("gloss_index")).alias("x")))
    opens = F.when(F.col("mark").isin("*", "!"), F.col("rest"))
    per = rows.filter(F.col("mark").isin(*"*!-=")).groupBy(*key, "place").agg(
        F.max(opens).alias("title"),
        F.max(opens.isNotNull()).alias("marked"),
        F.transform(F.array_sort(F.collect_list(gloss)), lambda x: x["g"]).alias("glosses"),
        F.transform(F.array_sort(F.collect_list(example)), lambda x: x["x"]).alias("examples"),
    )
    per = per.filter(F.col("marked") | (F.size("glosses") + F.size("examples") > 0))
    title = F.when(F.col("title") != "", F.col("title"))
    sense = F.struct(F.col("place.n").alias("n"), F.struct(title.alias("pos"), "glosses", "examples").alias("s"))
    phrase = collapse_spaces(F.replace("title", F.lit("_"), F.lit(" ")))
    idiom = F.struct(F.col("place.n").alias("n"), F.struct(phrase.alias("phrase"), "glosses", "examples").alias("s"))
    nested = per.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("place.k") == "s", sense))), lambda x: x["s"]).alias("senses"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("place.k") == "i", idiom))), lambda x: x["s"]).alias("idioms"),
    )
    heads = rows.groupBy(*key).agg(F.max(F.when(F.col("mark") == "@", F.col("rest"))).alias("raw"), F.transform(F.array_sort(F.collect_list(F.when((F.col("mark") == "+") & (F.col("rest") != ""), F.struct("line_no", "rest")))), lambda x: x["rest"]).alias("cross_refs"))
    out = heads.join(nested, key, "left")
    cols = split_headword(F.col("raw"))
    senses_type = "array<struct<pos:string,glosses:array<string>,examples:array<struct<en:string,vi:string,gloss_index:int>>>>"
    return out.select(
        "source_id",
        F.col("entry_no").alias("source_line"),
        cols["headword"].alias("headword"),
        normalize_headword(cols["headword"]).alias("headword_norm"),
        cols["ipa"].alias("ipa"),
        cols["variant"].alias("variant"),
        F.coalesce("senses", F.array().cast(senses_type)).alias("senses"),
        F.coalesce("idioms", F.array().cast(senses_type.replace("pos:", "phrase:"))).alias("idioms"),
        "cross_refs",
    ).filter(F.col("headword") != "")

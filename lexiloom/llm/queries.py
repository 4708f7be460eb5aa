"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.canonical import sense_labels
from lexiloom.llm.consistent import confusable_texts, inconsistent_texts
from lexiloom.llm.mix import mix, mix_report, sized_documents
from lexiloom.llm.residue import residue_texts
from lexiloom.llm.terms import CRITICAL, distinctive_terms, gloss_term_counts
from lexiloom.llm.tokens import token_ids
from lexiloom.session import checkpointed

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = sense_labels(_table(spark, sf_dir, "entries"), _table(spark, sf_dir, "pos_labels"))
    return labels.filter(~F.col("exact")).select("entry_id", "sense_no", "pos_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gloss_term_counts(_table(spark, sf_dir, "entries")).filter(F.col("mark").isNotNull()).select("term", "mark")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gloss_term_counts(_table(spark, sf_dir, "entries"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distinctive_terms(_table(spark, sf_dir, "entries"), min_tf=3, min_records=2, max_share=0.02, min_score=CRITICAL)
    return found.select("entry_id", "term")


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive_terms(_table(spark, sf_dir, "entries"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inconsistent_texts(_table(spark, sf_dir, "entries")).select("entry_id", "field", "sense_no", "item_no")


def p6_whole_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusable_texts(_table(spark, sf_dir, "entries"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(_table(spark, sf_dir, "documents"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sums, buckets and copies all start from the sizes: encoded once, kept in the shared folder
    return checkpointed(sized_documents(_table(spark, sf_dir, "documents")))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sized(spark, sf_dir), _table(spark, sf_dir, "mix_targets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, targets = _sized(spark, sf_dir), _table(spark, sf_dir, "mix_targets")
    return mix_report(mix(sized, targets), sized, targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_texts(_table(spark, sf_dir, "documents")).select("doc_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p2_counts, p5_found, p5_scores, p6_found, p6_whole_script, p7_ids, p8_mix, p8_report, p9_found)}

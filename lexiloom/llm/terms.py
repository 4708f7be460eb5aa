"""Frequency of every term, and how distinctive a term is per record.

Frequencies use last-seen counters: each task keeps, per term, its occurrences, its
records and the last record it was seen in, over the records in their order. A record
never spans tasks, so the tasks' counters add up exactly after they are
hash-partitioned by term. No set of records is ever held, and a term that is in every
record leaves each task as one row.

Distinctiveness is the log-likelihood ratio of a two-by-two contingency table: the
term's count in the record against its count in the remaining collection.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.consistent import SUSPECT, consistent
from lexiloom.operators.skew import lookup
from lexiloom.session import checkpointed

LETTERS = regex.compile(r"\p{L}+")
HARD = regex.compile(SUSPECT)

#: Terms that a task's counters hold before they are handed on.
COUNTERS = 400_000
#: Rows of one output batch.
BATCH = 20_000
#: From this log-likelihood ratio on a term is characteristic: the critical value of the
#: chi-squared distribution of one degree of freedom at 0.001, which the ratio follows
#: where the record is drawn like the rest.
CRITICAL = 10.828


def terms(text: str) -> list[str]:
    """The maximal runs of letters of the lower-cased consistent form."""
    return LETTERS.findall((consistent(text) if HARD.search(text) else text).lower())


def _records(batch: pa.RecordBatch) -> Iterator[tuple[Any, list[str]]]:
    """Each row's id and its terms; null texts have none."""
    for key, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        yield key, [t for text in texts or () if text for t in terms(text)]


def entry_record(entries: DataFrame, headword: bool) -> DataFrame:
    """``(entry_id, texts)``: the glosses of all senses, with the headword on demand."""
    glosses = F.flatten(F.transform(F.coalesce("senses", F.array()), lambda s: F.coalesce(s["glosses"], F.array().cast("array<string>"))))
    texts = F.concat(F.array("headword"), glosses) if headword else glosses
    return entries.select("entry_id", texts.alias("texts"))


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters: dict[str, list[int]] = {}  # term -> [occurrences, records, last record]
    record = 0

    def flush() -> Iterator[pa.RecordBatch]:
        names = list(counters)
        for i in range(0, len(names), BATCH):
            part = names[i : i + BATCH]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([counters[t][0] for t in part], pa.int64()), pa.array([counters[t][1] for t in part], pa.int64())],
                names=["term", "occurrences", "records"],
            )
        counters.clear()

    for batch in batches:
        for _, words in _records(batch):
            record += 1  # every row is a record of its own
            for t in words:
                c = counters.get(t)
                if c is None:
                    counters[t] = [1, 1, record]
                else:
                    c[0] += 1
                    if c[2] != record:
                        c[1] += 1
                        c[2] = record
            if len(counters) > COUNTERS:
                yield from flush()
    yield from flush()


def term_counts(records: DataFrame) -> DataFrame:
    """``(term, occurrences, records)`` over ``records`` = ``(id, array of texts)``.

    Every row is a record, repeated rows too. Null or empty arrays and texts have no
    terms; an empty table gives an empty result. Texts of any length are read whole.
    """
    partial = records.mapInArrow(_last_seen, "term string, occurrences long, records long")
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark(records: Column, total: int, rare: int, common: float) -> Column:
    """``rare`` wins where a collection is so small that both would hold."""
    return F.when(records <= rare, "rare").when(records > common * total, "common")


def gloss_term_counts(entries: DataFrame, rare: int = 2, common: float = 0.10) -> DataFrame:
    """Every term of ``senses.glosses`` with its counts, and a mark or null.

    ``rare``: in at most that many records; ``common``: in more than that share.
    """
    counts = term_counts(entry_record(entries, headword=False))
    return counts.withColumn("mark", mark(F.col("records"), entries.count(), rare, common))


def _per_record(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["entry_id", "term", "tf", "record_terms"])
            for c in out:
                c.clear()
            return b

        for batch in batches:
            for key, words in _records(batch):
                for t, n in Counter(words).items():
                    if n >= least:
                        for c, v in zip(out, (key, t, n, len(words)), strict=True):
                            c.append(v)
                if len(out[0]) >= BATCH:
                    yield flush()
        yield flush()

    return run


def record_terms(records: DataFrame, least: int = 1) -> DataFrame:
    """``(entry_id, term, tf, record_terms)`` of terms that a record has ``least`` times."""
    return records.mapInArrow(_per_record(least), "entry_id long, term string, tf long, record_terms long")


def log_likelihood(tf: Column, record_terms_: Column, occurrences: Column, total: Column) -> Column:
    """Signed log-likelihood ratio; negative where the record has less than its part."""

    def part(k: Column, row: Column, column: Column) -> Column:
        return F.when(k > 0, k * F.log(k * total / (row * column))).otherwise(F.lit(0.0))

    k11, k12 = tf.cast("double"), (occurrences - tf).cast("double")
    k21, k22 = (record_terms_ - tf).cast("double"), (total - record_terms_ - occurrences + tf).cast("double")
    g = 2 * (part(k11, k11 + k21, k11 + k12) + part(k12, k12 + k22, k11 + k12) + part(k21, k11 + k21, k21 + k22) + part(k22, k12 + k22, k21 + k22))
    return F.when(tf * total >= record_terms_ * occurrences, g).otherwise(-g)


def distinctive_terms(entries: DataFrame, min_tf: int = 1, min_records: int = 1, max_share: float = 1.0, min_score: float | None = None) -> DataFrame:
    """Each entry's terms of headword and glosses, scored against all entries.

    ``(entry_id, term, tf, records, occurrences, score)``, where ``min_score`` is given
    only those that score as much. ``min_tf`` is applied where the terms are counted, so
    that only candidates are shuffled; the statistics are of all entries and all terms. Very common terms meet a bounded broadcast instead of
    one join partition. Nulls count as empty; an empty table gives an empty result.
    """
    records = entry_record(entries, headword=True)
    # the vocabulary, small beside the texts, is read three times: kept in the shared folder
    counts = checkpointed(term_counts(records))
    total = counts.agg(F.sum("occurrences")).first()[0] or 0
    n = entries.count()
    stats = counts.filter((F.col("records") >= min_records) & (F.col("records") <= max_share * n))
    found = record_terms(records, min_tf)
    joined = lookup(found, stats, "term", ["occurrences", "records"], ["entry_id", "term"], "records", how="inner")
    score = log_likelihood(F.col("tf"), F.col("record_terms"), F.col("occurrences"), F.lit(float(total)))
    out = joined.select("entry_id", "term", "tf", "records", "occurrences", score.alias("score"))
    return out if min_score is None else out.filter(F.col("score") >= min_score)

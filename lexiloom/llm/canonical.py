"""Mapping of freely typed values to the closest entry of a reference list.

A prefix-filter set-similarity join. Values and reference spellings are sets of letter
pairs; the pairs are ordered by global rarity, and only each set's rare prefix is
joined. Length and positional filters drop most candidates, the Jaccard similarity of
the rest is computed exactly, and the best is kept. An edit-distance check then decides
whether the best is a misspelling of the entry or another word altogether.

Only distinct values enter the join, so the size of the table doesn't matter to it.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.consistent import consistent
from lexiloom.operators.skew import lookup
from lexiloom.session import checkpointed

#: Least Jaccard similarity of letter pairs of a candidate.
THRESHOLD = 0.3
#: Parts into which the sets that share a token are split: the smaller side is repeated
#: that often, so that a token of a third of all sets is joined by as many tasks.
SALTS = 16

_BRACKETS = re.compile(r"[(\[{<]([^)\]}>]*)[)\]}>]")
_SPLIT = re.compile(r"[,;:=|/\\+*•·–—]|\s-\s|\s/|/\s|\n|\t")
_LETTERS = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Without accents; the stroke of đ counts as one."""
    return "".join(c for c in unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D")) if not unicodedata.combining(c))


def words(text: str) -> str:
    """Only the words, lower-cased, one space between."""
    return " ".join(_LETTERS.findall(text.lower()))


def segments(value: str | None) -> list[str]:
    """What a typed value may mean: the whole, what is outside brackets, its parts."""
    if value is None:
        return []
    text = unicodedata.normalize("NFC", consistent(value)).lower()
    outside = _BRACKETS.sub(" , ", text)
    inside = _BRACKETS.findall(text)
    out = [words(text), words(outside)]
    for chunk in (outside, *inside):
        parts = _SPLIT.split(chunk)
        # "n/a" is one thing: single letters beside a separator aren't parts
        out += [w for p in parts if len(w := words(p)) > 1 or len(parts) == 1]
    return [s for s in dict.fromkeys(out) if s]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _segments(values: pd.Series) -> pd.Series:
    return values.map(segments)


def spellings(label: str | None, name_en: str | None, abbr: str | None) -> list[tuple[str, bool]]:
    """The spellings of a reference entry, and whether each must be met exactly.

    The label with and without accents and spaces, its English name in singular and
    plural, the abbreviation, and shortened English words of three letters or more.
    """
    out: dict[str, bool] = {}
    if label and (w := words(unicodedata.normalize("NFC", label))):
        for form in (w, w.replace(" ", ""), fold(w), fold(w).replace(" ", "")):
            out.setdefault(form, len(form) <= 4)
    if abbr and (w := words(unicodedata.normalize("NFC", abbr))):
        out.setdefault(w, True)
        out.setdefault(fold(w), True)
    if name_en and (w := words(name_en)):
        for form in (w, w + "s", w[:-1] + "ies" if w.endswith("y") else w + "es" if w.endswith(("x", "s")) else w):
            out.setdefault(form, len(form) <= 4)
        first, *rest = w.split(" ")
        for n in range(3, len(first)):
            out.setdefault(" ".join([first[:n], *rest]), True)
            if rest:
                out.setdefault(" ".join([first[:n], rest[0][0]]), True)
        if len(w) <= 4:
            out.setdefault(w[0], True)
    return list(out.items())


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("form", T.StringType()), T.StructField("exact", T.BooleanType())])))
def _spellings(label: pd.Series, name_en: pd.Series, abbr: pd.Series) -> pd.Series:
    return pd.Series([[{"form": f, "exact": e} for f, e in spellings(*x)] for x in zip(label, name_en, abbr, strict=True)], dtype=object)


def pairs(text: Column) -> Column:
    """The padded letter pairs of a text; a repeated pair is numbered, so that it counts."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    grams = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))
    # in sorted order equal pairs stand together: number = distance from the first equal one
    return F.transform(grams, lambda g, i: F.concat(g, (i + 1 - F.array_position(grams, g)).cast("string")))


def set_similarity_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(left_id, right_id, jaccard)`` of all pairs of token sets with that similarity.

    ``left`` and ``right`` are ``(id, tokens)``, ``right`` the smaller. Exact: the filters
    drop no pair that reaches the threshold. Empty token sets have no partner.
    """
    sides = {"left": left, "right": right}
    tokens = left.select(F.explode("tokens").alias("token")).unionAll(right.select(F.explode("tokens").alias("token")))
    rarity = tokens.groupBy("token").agg(F.count("*").alias("df"))
    prefixes, sets = {}, {}
    for name, df in sides.items():
        ranked = (
            df.select("id", F.explode("tokens").alias("token"))
            .join(rarity, "token")
            .groupBy("id")
            .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
            .select(F.col("id").alias(f"{name}_id"), F.col("ranked.token").alias(f"{name}_set"), F.size("ranked").alias(f"{name}_n"))
        )
        sets[name] = ranked
        n = F.col(f"{name}_n")
        keep = n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
        prefixes[name] = ranked.select(f"{name}_id", f"{name}_n", F.posexplode(F.slice(f"{name}_set", F.lit(1), keep)).alias(f"{name}_pos", "token"))
    prefixes["left"] = prefixes["left"].withColumn("salt", F.pmod(F.xxhash64("left_id"), F.lit(SALTS)))
    prefixes["right"] = prefixes["right"].withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    ln, rn = F.col("left_n"), F.col("right_n")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (ln + rn) - F.lit(1e-9))
    most = 1 + F.least(ln - F.col("left_pos") - 1, rn - F.col("right_pos") - 1)
    candidates = (
        prefixes["left"]
        .join(prefixes["right"], ["token", "salt"])
        .filter((rn >= ln * F.lit(threshold) - 1e-9) & (ln >= rn * F.lit(threshold) - 1e-9))
        # the first shared token of the two prefixes bounds what can be shared after it
        .groupBy("left_id", "right_id")
        .agg(F.min(F.struct("left_pos", "right_pos", "left_n", "right_n")).alias("first"))
        .select("left_id", "right_id", "first.*")
        .filter(most >= need)
    )
    both = candidates.select("left_id", "right_id").join(sets["left"], "left_id").join(sets["right"], "right_id")
    shared = F.size(F.array_intersect("left_set", "right_set"))
    return both.withColumn("jaccard", shared / (ln + rn - shared)).filter(F.col("jaccard") >= threshold).select("left_id", "right_id", "jaccard")


def close_enough(segment: Column, form: Column, exact: Column) -> Column:
    """Whether a segment is a misspelling of a form.

    One edit; two neighbours swapped; two edits in a form of eight characters or more.
    """
    distance = F.levenshtein(segment, form)
    sorted_letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    swapped = (distance == 2) & (sorted_letters(segment) == sorted_letters(form))
    return (distance == 0) | (~exact & ((distance <= 1) | swapped | ((distance == 2) & (F.length(form) >= 8))))


def canonical_values(values: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(value, n, pos_id, jaccard, exact)`` of each distinct ``value`` that occurs ``n``
    times; ``pos_id`` is 0 where it means no label, ``exact`` where it is one as it stands.

    ``labels`` is ``(pos_id, label, name_en, abbr)``. Nulls are no values. Values that
    hold no letter mean no label. Ties go to the earlier part of the value, the nearer
    spelling, the lower ``pos_id``. A spelling that several labels share stands for the
    one it is the whole label, name or abbreviation of, and for none if only shortened.
    """
    # both sides are read several times below: computed once, kept in the shared folder
    distinct = checkpointed(values.filter(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n")).withColumn("segments", _segments("value")))
    typed = distinct.select("value", F.posexplode("segments").alias("part", "segment"))
    lists = labels.select("pos_id", F.posexplode(_spellings("label", "name_en", "abbr")).alias("rank", "s")).select("pos_id", "rank", "s.*")
    forms = lists.groupBy("form").agg(F.min(F.struct("rank", "pos_id", "exact")).alias("m"), F.count_distinct("pos_id").alias("owners"))
    whole = labels.select(F.explode(F.array("label", "name_en", "abbr")).alias("form")).select(F.lower("form").alias("form")).distinct().withColumn("whole", F.lit(True))
    forms = checkpointed(forms.join(whole, "form", "left").filter((F.col("owners") == 1) | F.col("whole")).select("form", "m.pos_id", "m.exact"))
    left = typed.select(F.col("segment").alias("id")).distinct().withColumn("tokens", pairs(F.col("id")))
    right = forms.select(F.col("form").alias("id"), pairs(F.col("form")).alias("tokens"))
    joined = set_similarity_join(left, right, threshold)
    near = (
        joined.join(forms, joined["right_id"] == forms["form"])
        .filter(close_enough(F.col("left_id"), F.col("form"), F.col("exact")))
        .select(F.col("left_id").alias("segment"), "pos_id", "jaccard", F.levenshtein("left_id", "form").alias("distance"))
    )
    order = F.struct((-F.col("jaccard")).alias("j"), "distance", "part", "pos_id")
    best = typed.join(near, "segment").groupBy("value").agg(F.min(order).alias("best"))
    names = labels.select(F.col("label").alias("value")).distinct().withColumn("exact", F.lit(True))
    out = distinct.join(best, "value", "left").join(names, "value", "left")
    return out.select("value", "n", F.coalesce("best.pos_id", F.lit(0)).alias("pos_id"), F.coalesce(-F.col("best.j"), F.lit(0.0)).alias("jaccard"), F.coalesce("exact", F.lit(False)).alias("exact"))


def sense_labels(entries: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(entry_id, sense_no, pos, pos_id, exact)``: every sense with a pos.

    ``pos_id`` is 0 for what means no label, ``exact`` tells a pos that is a label as it
    stands. Senses whose pos is null or blank give no row; so do entries without senses.
    Repeated rows are kept. The many rows of a frequent value meet a bounded broadcast.
    """
    senses = entries.select("entry_id", F.posexplode("senses").alias("sense_no", "s")).select("entry_id", "sense_no", F.col("s.pos").alias("pos"))
    senses = senses.filter(F.col("pos").rlike(r"[^\s\p{Z}]"))
    # a row per distinct value, read twice below: computed once, kept in the shared folder
    mapping = checkpointed(canonical_values(senses.select(F.col("pos").alias("value")), labels, threshold).withColumnRenamed("value", "pos"))
    out = lookup(senses, mapping, "pos", ["pos_id", "exact"], ["entry_id", "sense_no"], "n")
    return out.select("entry_id", "sense_no", "pos", F.coalesce("pos_id", F.lit(0)).alias("pos_id"), "exact")

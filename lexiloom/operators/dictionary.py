"""Keys, lookups, source filter and candidate ranking over nested dictionary entries.

Entries are ordered by ``(headword_norm, source_id, source_line, entry_id)``. The order
is compared where it matters; no global row number is made, as that would put the whole
dictionary into one task.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions.text import collapse_spaces, is_junk_gloss, lemma_candidates, normalize_headword, word_count
from lexiloom.operators.ordered import numbered

NO_PRIORITY = 2_147_483_647


def entry_order(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c) for c in ("headword_norm", "source_id", "source_line", "entry_id")])


def has_gloss(senses: Column, idioms: Column) -> Column:
    some = lambda xs: F.coalesce(F.exists(xs, lambda x: F.coalesce(F.size(x["glosses"]), F.lit(0)) > 0), F.lit(False))
    return some(senses) | some(idioms)


def primary_keys(entries: DataFrame) -> DataFrame:
    """``(key, entry_id, is_alias)``: one row per entry, homographs repeat."""
    return entries.filter(F.col("headword_norm") != "").select(F.col("headword_norm").alias("key"), "entry_id", F.lit(False).alias("is_alias"))


def alias_keys(entries: DataFrame) -> DataFrame:
    """Keys under which idioms are found: the idiom, and without a leading ``to``.

    A key that is a headword already is no alias. Of the entries that claim one, those
    whose headword is the idiom's first word come before all others, then the entry
    order, the place of the idiom, and the whole idiom before the shortened one.
    """
    idioms = entries.select("entry_id", "headword_norm", "source_id", "source_line", F.posexplode("idioms").alias("idiom_no", "i"))
    phrase = idioms.withColumn("k", normalize_headword(F.col("i.phrase"))).filter(F.col("k") != "")
    bare = F.when(F.col("k").startswith("to "), F.col("k").substr(F.lit(4), F.length("k"))).otherwise(F.col("k"))
    both = phrase.withColumn("bare", bare).withColumn("pass_no", F.when(F.substring_index("bare", " ", 1) == F.col("headword_norm"), 0).otherwise(1))
    keys = both.select("entry_id", "headword_norm", "source_id", "source_line", "idiom_no", "pass_no", F.posexplode(F.array_distinct(F.array("k", "bare"))).alias("form", "key")).filter(F.col("key") != "")
    rank = F.struct("pass_no", "headword_norm", "source_id", "source_line", "entry_id", "idiom_no", "form")
    best = keys.groupBy("key").agg(F.min_by("entry_id", rank).alias("entry_id"))
    return best.join(primary_keys(entries).select("key").distinct(), "key", "left_anti").select("key", "entry_id", F.lit(True).alias("is_alias"))


def all_keys(entries: DataFrame) -> DataFrame:
    return primary_keys(entries).unionByName(alias_keys(entries))


def lookup_all(queries: DataFrame, entries: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Every entry of each query's key: ``queries`` is ``(query_id, query)``."""
    asked = queries.withColumn("key", normalize_headword(F.col("query")))
    keys = all_keys(entries) if keys is None else keys
    return asked.join(keys, "key").join(entries, "entry_id")


def lookup_first(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """``(query_id, key, entry_id)``: the first entry in order of each query's key."""
    hits = lookup_all(queries, entries.select("entry_id", "headword", "headword_norm", "source_id", "source_line", "idioms"))
    return hits.groupBy("query_id", "key").agg(F.min_by("entry_id", entry_order()).alias("entry_id"))


def contains(queries: DataFrame, keys: DataFrame) -> DataFrame:
    return queries.join(keys.select("key").distinct(), "key", "left_semi")


def prefix_scan(keys: DataFrame, prefix: str, limit: int) -> DataFrame:
    """The first keys in byte order that start with the normalized prefix; duplicates are kept."""
    prefix = " ".join(unicodedata.normalize("NFC", prefix.replace("_", " ")).lower().split())
    if not prefix or limit <= 0:
        return keys.limit(0)
    return keys.filter(F.col("key").startswith(prefix)).orderBy("key", "entry_id").limit(limit)


def phrase_starters(keys: DataFrame) -> DataFrame:
    """The distinct first words of keys of several words."""
    return keys.filter(F.instr("key", " ") > 0).select(F.substring_index("key", " ", 1).alias("starter")).distinct()


def source_catalog(sources: DataFrame) -> DataFrame:
    """The catalogue in its order, with whether any source is enabled at all."""
    return sources.orderBy("priority", "id")


def apply_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of enabled sources with their ``source_priority``.

    Sources that the catalogue doesn't know count as enabled and come last. If all are
    disabled, all rows pass and no source comes first.
    """
    small = sources.select(F.col("id").alias("_id"), (F.col("enabled") == 1).alias("_enabled"), F.col("priority").alias("_priority"))
    any_on = small.agg(F.coalesce(F.max("_enabled"), F.lit(False)).alias("on")).first()["on"]
    joined = rows.join(small, F.col("source_id") == F.col("_id"), "left")
    if not any_on:
        return joined.withColumn("source_priority", F.lit(0)).drop("_id", "_enabled", "_priority")
    return joined.filter(F.coalesce("_enabled", F.lit(True))).withColumn("source_priority", F.coalesce("_priority", F.lit(NO_PRIORITY))).drop("_id", "_enabled", "_priority")


def reorder_sources(sources: DataFrame, move_id: int, by: int) -> DataFrame:
    """Move a source up or down; priorities are renumbered. Out of range: unchanged.

    The catalogue is a short list and is handled on the driver.
    """
    rows = [r.asDict() for r in source_catalog(sources).collect()]
    at = next((i for i, r in enumerate(rows) if r["id"] == move_id), None)
    if at is not None and 0 <= at + by < len(rows):
        rows.insert(at + by, rows.pop(at))
        for i, r in enumerate(rows):
            r["priority"] = i
    return sources.sparkSession.createDataFrame(rows, sources.schema)


def chosen_forms(queries: DataFrame, entries: DataFrame, sources: DataFrame | None = None, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(query_id, form, via_lemma)``: the form that stands for each query; and ``(form, entry_id)`` of all forms.

    The word itself if it has a gloss; else its first lemma that has one; else the word
    though without gloss. ``queries`` is ``(query_id, query)``.
    """
    asked = queries.withColumn("norm", normalize_headword(F.col("query")))
    forms = asked.select("query_id", F.posexplode(F.concat(F.array("norm"), lemma_candidates(F.col("norm")))).alias("rank", "form"))
    rows = entries.select("entry_id", "source_id", has_gloss(F.col("senses"), F.col("idioms")).alias("glossed"))
    rows = rows.withColumn("source_priority", F.lit(0)) if sources is None else apply_sources(rows, sources)
    keys = all_keys(entries) if keys is None else keys
    keyed = keys.withColumnRenamed("key", "form").join(rows, "entry_id")
    # whether a form has any gloss is a row a form: entries are brought in only for the form that is chosen
    known = keyed.groupBy("form").agg(F.max("glossed").alias("any_gloss"))
    usable = forms.join(known, "form").filter(F.col("any_gloss") | (F.col("rank") == 0))
    best = usable.groupBy("query_id").agg(F.min(F.struct((~F.col("any_gloss")).alias("bare"), "rank", "form")).alias("b"))
    return best.select("query_id", "b.form", (F.col("b.rank") > 0).alias("via_lemma")), keyed.select("form", "entry_id")


def resolve(queries: DataFrame, entries: DataFrame, sources: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """``(query_id, form, via_lemma, entry_id)``: the entries of the form that stands for each query."""
    chosen, keyed = chosen_forms(queries, entries, sources, keys)
    return chosen.join(keyed, "form").select("query_id", "form", "via_lemma", "entry_id")


def ranked_candidates(entries: DataFrame, group: list[str], sources: DataFrame | None = None, most: int = 12) -> DataFrame:
    """The glosses of a group of entries, best first, at most ``most`` of them.

    A sense weighs as many as it has glosses and examples, less a thousand for each step
    of its source's priority (up to 100). First glosses of senses come before all
    others; those lose a hundredth a place.
    """
    rows = entries.withColumn("source_priority", F.lit(0)) if sources is None else apply_sources(entries, sources)
    senses = rows.select(*group, "entry_id", "headword", "source_id", "source_priority", "source_line", "headword_norm", F.posexplode("senses").alias("sense_no", "s"))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    weight = size(F.col("s.glosses")) + size(F.col("s.examples")) - (F.lit(0) if sources is None else F.least("source_priority", F.lit(100)) * 1000)
    glosses = senses.withColumn("weight", weight).select("*", F.posexplode("s.glosses").alias("gloss_no", "gloss"))
    score = F.col("weight").cast("double") - F.lit(0.01) * F.col("gloss_no")
    scored = glosses.withColumn("score", F.round(score, 6)).withColumn("is_rest", (F.col("gloss_no") > 0).cast("int"))
    order = Window.partitionBy(*group).orderBy("is_rest", F.col("score").desc(), "source_priority", "headword_norm", "source_id", "source_line", "entry_id", "sense_no", "gloss_no")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select(*group, "rank", "entry_id", "headword", F.col("s.pos").alias("pos"), "gloss", "score", "source_id")


def phrase_candidates(entries: DataFrame, keys: DataFrame, most: int = 12) -> DataFrame:
    """Glosses of the idioms that a key names: ``keys`` is ``(key, entry_id)``."""
    idioms = keys.join(entries, "entry_id").select("key", "entry_id", "headword_norm", "source_id", "source_line", F.posexplode("idioms").alias("idiom_no", "i"))
    named = normalize_headword(F.col("i.phrase"))
    mine = idioms.filter((named == F.col("key")) | (named == F.concat(F.lit("to "), F.col("key"))))
    glosses = mine.select("*", F.posexplode("i.glosses").alias("gloss_no", "gloss"))
    order = Window.partitionBy("key").orderBy("headword_norm", "source_id", "source_line", "entry_id", "idiom_no", "gloss_no")
    ranked = glosses.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("key", "rank", "entry_id", F.col("i.phrase").alias("phrase"), "gloss", F.round(F.pow(F.lit(0.95), F.col("rank") - 1), 6).alias("score"))


def dictionary_stats(entries: DataFrame) -> DataFrame:
    """One row of counts over all entries."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    total = lambda xs, f: F.aggregate(F.coalesce(xs, F.array()), F.lit(0), lambda a, x: a + size(x[f]))
    return entries.agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum((word_count(F.col("headword_norm")) > 1).cast("long")), F.lit(0)).alias("multiword"),
        F.coalesce(F.sum(size(F.col("senses")).cast("long")), F.lit(0)).alias("senses"),
        F.coalesce(F.sum((total(F.col("senses"), "glosses") + total(F.col("idioms"), "glosses")).cast("long")), F.lit(0)).alias("glosses"),
        F.coalesce(F.sum((total(F.col("senses"), "examples") + total(F.col("idioms"), "examples")).cast("long")), F.lit(0)).alias("examples"),
        F.coalesce(F.sum(size(F.col("idioms")).cast("long")), F.lit(0)).alias("idioms"),
    )


def usable_glosses(glosses: DataFrame) -> DataFrame:
    return glosses.filter(~is_junk_gloss(F.col("gloss"))).withColumn("gloss", collapse_spaces(F.col("gloss")))


def lookup_entries(queries: DataFrame, entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Every entry of each query's key of enabled sources, with its ``source_priority``."""
    return apply_sources(lookup_all(queries, entries), sources)


def dump(entries: DataFrame, headword: str) -> DataFrame:
    """All entries of a headword."""
    one = entries.sparkSession.createDataFrame([(headword,)], "raw string").select(normalize_headword(F.col("raw")).alias("headword_norm"))
    return entries.join(F.broadcast(one), "headword_norm", "left_semi")


def with_ordinals(entries: DataFrame) -> DataFrame:
    """The entries with their number in the order of the dictionary, from 0."""
    return numbered(entries, ["headword_norm", "source_id", "source_line", "entry_id"], "ordinal")


def entries_at(ordinals: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries by number; one out of bounds gives none. ``entries`` has its ``ordinal``."""
    return ordinals.select("ordinal").join(entries, "ordinal")


def set_enabled(sources: DataFrame, source_id: int, on: bool) -> DataFrame:
    return sources.withColumn("enabled", F.when(F.col("id") == source_id, F.lit(int(on)).cast(sources.schema["enabled"].dataType)).otherwise(F.col("enabled")))


def source_totals(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source_id, declared, found)``: entries of each source by catalogue and in fact."""
    found = entries.groupBy("source_id").agg(F.count("*").alias("found"))
    both = sources.select(F.col("id").alias("source_id"), F.col("entries").alias("declared")).join(found, "source_id", "full")
    return both.select("source_id", "declared", F.coalesce("found", F.lit(0)).alias("found"))


def idiom_focus(queries: DataFrame, entries: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``(query_id, entry_id, idiom_no, phrase, glosses)``: the idioms that a query of several
    words names, with or without a leading ``to``, of the entries found for it."""
    some = entries if sources is None else apply_sources(entries, sources)
    hits = lookup_all(queries, some).filter(F.instr("key", " ") > 0)
    idioms = hits.select("query_id", "key", "entry_id", F.posexplode("idioms").alias("idiom_no", "i")).withColumn("k", normalize_headword(F.col("i.phrase")))
    mine = idioms.filter((F.col("k") == F.col("key")) | (F.col("k") == F.concat(F.lit("to "), F.col("key"))) | (F.concat(F.lit("to "), F.col("k")) == F.col("key")))
    return mine.select("query_id", "entry_id", "idiom_no", F.col("i.phrase").alias("phrase"), F.col("i.glosses").alias("glosses"))

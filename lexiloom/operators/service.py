"""What a user asks in one go: the cascade of a word, and views over glossed sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import segment
from lexiloom.functions.text import contains_letter, looks_like_sentence, looks_vietnamese, subtitle_clean
from lexiloom.operators.dictionary import apply_sources, lookup_entries, resolve
from lexiloom.operators.search import fuzzy_english
from lexiloom.operators.translate import translate_texts

#: Characters of a piece that a translator is given at most.
PIECE = 400


def word_cascade(queries: DataFrame, entries: DataFrame, sources: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, stage, rank, entry_id, text)``: the first stage that answers each query.

    ``lookup``: entries under the key. ``resolve``: entries of a base form, ``text`` names
    it. ``translate``: a text of four words or more, translated. ``fuzzy``: the nearest
    headwords. A later stage is only asked what no earlier one has answered.
    """
    asked = queries.select("query_id", "query")
    left = lambda done: asked.join(done.select("query_id").distinct(), "query_id", "left_anti")
    found = lookup_entries(asked, entries, sources).select("query_id", F.lit("lookup").alias("stage"), F.col("source_priority").alias("rank"), "entry_id", F.col("key").alias("text"))
    rest = left(found)
    based = resolve(rest, entries, sources).select("query_id", F.lit("resolve").alias("stage"), F.lit(0).alias("rank"), "entry_id", F.col("form").alias("text"))
    rest = rest.join(based.select("query_id").distinct(), "query_id", "left_anti")
    long = looks_like_sentence(F.col("query"))
    said = translate_texts(rest.filter(long).select(F.col("query_id").alias("text_id"), F.col("query").alias("text")), entries, sources)
    said = said.select(F.col("text_id").alias("query_id"), F.lit("translate").alias("stage"), F.lit(0).alias("rank"), F.lit(None).cast("long").alias("entry_id"), F.col("translation").alias("text"))
    near = fuzzy_english(apply_sources(entries, sources), rest.filter(~F.coalesce(long, F.lit(False)) & F.col("query").isNotNull()), k)
    near = near.select("query_id", F.lit("fuzzy").alias("stage"), "rank", F.col("doc_id").alias("entry_id"), F.col("headword_norm").alias("text"))
    return found.unionByName(based).unionByName(said).unionByName(near)


def resolved_ratio(glossed: DataFrame) -> DataFrame:
    """``(sentence_id, words, resolved, ratio)``: the share of words and phrases with candidates."""
    kinds = glossed.select("sentence_id", F.transform("segments", lambda s: s["kind"]).alias("k"))
    words = F.size(F.filter("k", lambda k: k != "PUNCT"))
    done = F.size(F.filter("k", lambda k: k.isin("WORD", "PHRASE")))
    return kinds.select("sentence_id", words.alias("words"), done.alias("resolved"), F.when(words > 0, done / words).otherwise(F.lit(0.0)).alias("ratio"))


def flat_gloss(glossed: DataFrame) -> DataFrame:
    """``(sentence_id, gloss)``: the default glosses in a line, marks and unknown words as they are."""
    shown = F.transform("segments", lambda s: F.when((s["kind"] != "PUNCT") & (F.size(s["candidates"]) > 0), F.get(s["candidates"], F.lit(0))["gloss"]).otherwise(s["source"]))
    return glossed.select("sentence_id", F.array_join(shown, "").alias("gloss"))


def paragraph_pieces(texts: DataFrame, most: int = PIECE) -> DataFrame:
    """``(text_id, sentence_no, piece_no, piece, passes)`` of what a translator is given.

    Sentences in order, cut into pieces; one that holds no letter or is Vietnamese already
    ``passes`` as it stands. Others are cleaned of style tags and dialogue dashes.
    """
    cut = texts.select("text_id", F.posexplode(segment.sentences("text")).alias("sentence_no", "sentence"))
    passes = ~contains_letter(F.col("sentence")) | looks_vietnamese(F.col("sentence"))
    given = cut.withColumn("passes", passes).withColumn("given", F.when(passes, F.col("sentence")).otherwise(subtitle_clean(F.col("sentence"))))
    rows = given.select("text_id", "sentence_no", "passes", F.posexplode(segment.pieces(most)("given")).alias("piece_no", "piece"))
    return rows.select("text_id", "sentence_no", "piece_no", "piece", "passes")

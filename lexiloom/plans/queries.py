"""The queries of the core, by name. Each runs over its whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import segment, text
from lexiloom.operators import dictionary, gloss, history, lexicon, search, service, subword, translate
from lexiloom.operators.packed import packed_glosses
from lexiloom.operators.parse_rows import failed_rows, valid_rows
from lexiloom.session import checkpointed, ensure_checkpoint_dir
from lexiloom.sources import store
from lexiloom.sources.files import tsv_entries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Of the queries ``*_rows`` and ``reverse_search``: every row whose id is divisible by this asks.
ASKS = 100
#: What is searched for in the search queries that have SQL: (id, Vietnamese or English text).
SEARCHES = ((1, "con mương"), (2, "cái cân"), (3, "đường ray"), (4, "bức tường dốc đứng"), (5, "rough path"))
FUZZY = ((1, "gardenn"), (2, "whistel"), (3, "clumzy"), (4, "set upp"), (5, "wether"))
MISSPELT = ((1, "con muong"), (2, "cai cann"), (3, "duong rayy"), (4, "ngon thap"), (5, "set"))
LOOKUPS = ((1, "Set"), (2, "weigh_out"), (3, "to pull a valve"), (4, "gardens"), (5, "no such word"))


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _asked(spark: SparkSession, rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), "query_id int, query string")


def _asking(spark: SparkSession, sf_dir: str, table: str, row_id: str, query: Column) -> DataFrame:
    return _table(spark, sf_dir, table).filter(F.col(row_id) % ASKS == 0).select(F.col(row_id).alias("query_id"), query.alias("query"))


def _asking_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asking(spark, sf_dir, "documents", "doc_id", F.col("headword"))


def _asking_headwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asking(spark, sf_dir, "entries", "entry_id", F.col("headword"))


def _asking_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    glosses = F.flatten(F.transform("senses", lambda s: F.coalesce(s["glosses"], F.array().cast("array<string>"))))
    return _asking(spark, sf_dir, "entries", "entry_id", F.get(F.filter(glosses, lambda g: g.isNotNull()), F.lit(0)))


def _each(asked: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Asks each distinct text once, for ``set`` alone is a tenth; all who ask it get its rows."""
    found = ask(asked.select(F.col("query").alias("query_id"), "query").filter(F.col("query").isNotNull()).distinct()).withColumnRenamed("query_id", "_text")
    return asked.withColumnRenamed("query", "_text").join(found, "_text").drop("_text")


def _docs(spark: SparkSession, sf_dir: str, fold: bool = False) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return _table(spark, sf_dir, "documents").select("doc_id", text.split_tokens(text.remove_diacritics(t) if fold else t).alias("tokens"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_glosses(_table(spark, sf_dir, "entries")).select("entry_id", "sense_no", "gloss_no", "value_pos", "value")


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "tsv_lines").select("line_id", "raw_line")
    return failed_rows(lines).select("line_id", "row_reason").withColumnRenamed("row_reason", "reason")


@query
def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_rows(_table(spark, sf_dir, "tsv_lines")).select("line_id", "headword", "gloss", "pos")


@query
def tokens_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("terms"))


@query
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(_docs(spark, sf_dir))


@query
def doc_frequency_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    n, _ = search.corpus_stats(docs)
    df = search.doc_frequency(search.postings(docs))
    return df.select("term", "df", F.round(text.bm25_idf(F.lit(float(n)), F.col("df")), 6).alias("idf"))


@query
def doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.doc_lengths(_docs(spark, sf_dir)).agg(F.count("*").alias("docs"), F.round(F.avg("doc_len"), 6).alias("avg_len"), F.max("doc_len").alias("max_len"))


def _bm25(spark: SparkSession, sf_dir: str, asked: DataFrame, fold: bool) -> DataFrame:
    q = text.remove_diacritics(F.col("query")) if fold else F.col("query")
    scored = search.bm25_scores(_docs(spark, sf_dir, fold), asked.select("query_id", text.split_tokens(q).alias("tokens")))
    return search.top_per_query(scored.select("query_id", "doc_id", "score"), 10)


@query
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, _asked(spark, SEARCHES), fold=False)


@query
def bm25_accent_free_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, _asked(spark, SEARCHES), fold=True)


@query
def bm25_search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_asking_documents(spark, sf_dir), lambda q: _bm25(spark, sf_dir, q, fold=False))


@query
def bm25_accent_free_search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_asking_documents(spark, sf_dir), lambda q: _bm25(spark, sf_dir, q, fold=True))


@query
def reverse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_asking_glosses(spark, sf_dir), lambda q: search.search_vietnamese(_table(spark, sf_dir, "entries"), q, 10))


@query
def accent_fold_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _docs(spark, sf_dir).select(F.explode("tokens").alias("term")).distinct()
    return terms.groupBy(text.remove_diacritics(F.col("term")).alias("folded")).agg(F.count("*").alias("forms"))


@query
def normalize_headword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "entries").select("entry_id", text.normalize_headword(F.col("headword")).alias("norm"))


def _glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    senses = _table(spark, sf_dir, "entries").select("entry_id", F.explode("senses").alias("s"))
    return senses.select("entry_id", F.explode("s.glosses").alias("gloss")).filter(F.col("gloss").isNotNull())


@query
def gloss_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _glosses(spark, sf_dir).select(F.explode(text.gloss_alternatives(F.col("gloss"))).alias("alternative")).groupBy("alternative").agg(F.count("*").alias("n"))


@query
def trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _table(spark, sf_dir, "entries").select(F.col("entry_id").alias("doc_id"), text.trigrams(F.col("headword_norm")).alias("tokens"))
    return search.postings(heads)


@query
def fuzzy_match_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuzzy_english(_table(spark, sf_dir, "entries"), _asked(spark, FUZZY), 10)


@query
def fuzzy_match_jaccard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_asking_headwords(spark, sf_dir), lambda q: search.fuzzy_english(_table(spark, sf_dir, "entries"), q, 10))


@query
def compound_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.compounds(_table(spark, sf_dir, "entries"), 3)


@query
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.suggest(search.compounds(_table(spark, sf_dir, "entries"), 3), _asked(spark, MISSPELT), 5)


@query
def did_you_mean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_asking_glosses(spark, sf_dir), lambda q: search.suggest(search.compounds(_table(spark, sf_dir, "entries"), 3), q, 5))


@query
def compound_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = search.compounds(_table(spark, sf_dir, "entries"), 3)
    expanded = search.expand_compounds(_docs(spark, sf_dir), words)
    return expanded.filter(F.instr("term", "_") > 0).groupBy("term").agg(F.count("*").alias("n"))


@query
def alias_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.alias_keys(_table(spark, sf_dir, "entries")).select("key", "entry_id")


@query
def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.lookup_first(_asked(spark, LOOKUPS), _table(spark, sf_dir, "entries"))


@query
def exact_lookup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_asking_headwords(spark, sf_dir), lambda q: dictionary.lookup_first(q, _table(spark, sf_dir, "entries")))


@query
def homograph_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.lookup_all(_asked(spark, LOOKUPS), _table(spark, sf_dir, "entries")).select("query_id", "key", "entry_id")


@query
def homograph_lookup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_asking_headwords(spark, sf_dir), lambda q: dictionary.lookup_all(q, _table(spark, sf_dir, "entries")).select("query_id", "key", "entry_id"))


@query
def key_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "lookup_history").select(text.normalize_headword(F.col("query")).alias("key")).distinct()
    return dictionary.contains(asked, dictionary.all_keys(_table(spark, sf_dir, "entries")))


@query
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.prefix_scan(dictionary.all_keys(_table(spark, sf_dir, "entries")), "ga", 50).select("key", "entry_id")


@query
def phrase_starters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.phrase_starters(dictionary.all_keys(_table(spark, sf_dir, "entries")))


@query
def lemma_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "parallel_pairs").select(F.explode(text.english_tokens(F.col("en"))).alias("word")).distinct()
    return words.select("word", F.array_join(text.lemma_candidates(F.col("word")), " ").alias("lemmas"), text.is_past_form(F.col("word")).alias("past"))


@query
def resolve_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "lookup_history").select(F.lower("query").alias("query")).filter(F.col("query").rlike(r"\S")).distinct()
    got = dictionary.resolve(asked.select(F.col("query").alias("query_id"), "query"), _table(spark, sf_dir, "entries"), _table(spark, sf_dir, "dict_sources"))
    return got.groupBy(F.col("query_id").alias("query"), "form", "via_lemma").agg(F.count("*").alias("entries"))


@query
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = dictionary.ranked_candidates(_table(spark, sf_dir, "entries"), ["headword_norm"], _table(spark, sf_dir, "dict_sources"))
    return ranked.select("headword_norm", "rank", "entry_id", "gloss", "score")


@query
def phrase_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _table(spark, sf_dir, "entries")
    return dictionary.phrase_candidates(entries, dictionary.all_keys(entries).select("key", "entry_id")).select("key", "rank", "gloss", "score")


@query
def source_filter_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dictionary.apply_sources(_table(spark, sf_dir, "entries").select("entry_id", "source_id"), _table(spark, sf_dir, "dict_sources"))
    return rows.select("entry_id", "source_id", "source_priority")


@query
def source_all_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = _table(spark, sf_dir, "dict_sources").withColumn("enabled", F.lit(0))
    return dictionary.apply_sources(_table(spark, sf_dir, "entries").select("entry_id", "source_id"), off).groupBy("source_id").agg(F.count("*").alias("n"))


@query
def source_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.reorder_sources(_table(spark, sf_dir, "dict_sources"), 5, -2).select("id", "priority")


@query
def dictionary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.dictionary_stats(_table(spark, sf_dir, "entries"))


@query
def looks_vietnamese(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.looks_vietnamese(F.col("text")).alias("vietnamese"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.clean_log(_table(spark, sf_dir, "lookup_history"))


@query
def latest_per_key_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest_per_key(_log(spark, sf_dir), limit=1000)


@query
def consecutive_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.drop_repeats(_log(spark, sf_dir))


@query
def history_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.retain(_log(spark, sf_dir), 1000, 2000)


@query
def history_delete_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("word", "set up"), ("sentence", "set up")], "mode string, query string")
    return history.remove_keys(_log(spark, sf_dir), gone)


@query
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = lexicon.stride_sample(_table(spark, sf_dir, "parallel_pairs"), 1000)
    return sample.select("line_no", F.size("en").alias("en_tokens"), F.size("vi").alias("vi_tokens"))


def _lexicon(spark: SparkSession, sf_dir: str, iterations: int, most_tokens: int | None = 20) -> DataFrame:
    return lexicon.train(_table(spark, sf_dir, "parallel_pairs"), iterations, most_tokens)


@query
def em_iteration_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexicon(spark, sf_dir, 1).select("e", "f", F.round("t", 6).alias("t"))


@query
def em_model1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of 0.005 and more, where the lexicon is cut, of lines of any length; ``em_model1_whole`` has all."""
    return _lexicon(spark, sf_dir, 4, most_tokens=None).select("e", "f", F.round("t", 6).alias("t")).filter(F.col("t") >= 0.005)


@query
def em_model1_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexicon(spark, sf_dir, 4, most_tokens=None).select("e", "f", F.round("t", 6).alias("t"))


@query
def lexicon_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.format_translations(lexicon.top_translations(_lexicon(spark, sf_dir, 4, most_tokens=None)))


@query
def lexicon_score_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lexicon.top_translations(_lexicon(spark, sf_dir, 4))
    senses = _table(spark, sf_dir, "entries").select("entry_id", "headword_norm", F.posexplode("senses").alias("sense_no", "s"))
    rows = senses.select("entry_id", "sense_no", "headword_norm", F.posexplode("s.glosses").alias("gloss_no", "gloss")).filter(F.col("gloss").isNotNull())
    scored = lexicon.score_glosses(rows.select(F.struct("entry_id", "sense_no", "gloss_no").alias("id"), F.col("headword_norm").alias("en"), "gloss"), table)
    return scored.select("id.entry_id", "id.sense_no", "id.gloss_no", "score")


@query
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.sentences("text")).alias("sentence_no", "sentence"))


@query
def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.pieces(400)("text")).alias("piece_no", "piece"))


@query
def tokenize_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return docs.select("doc_id", F.array_join(F.transform(segment.tokens("text"), lambda t: t["text"]), "").alias("text"))


@query
def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "tsv_lines").select("source_id", "line_no", F.col("raw_line").alias("line"))
    rows = tsv_entries(lines)
    return rows.select("source_id", "source_line", "headword", F.col("senses")[0]["glosses"][0].alias("gloss"), F.col("senses")[0]["pos"].alias("pos"))


@query
def accent_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _docs(spark, sf_dir).select(F.explode("tokens").alias("term"))
    return search.accent_forms(terms).select("folded", F.array_join("forms", " ").alias("forms"))


@query
def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.source_totals(_table(spark, sf_dir, "entries"), _table(spark, sf_dir, "dict_sources"))


@query
def source_set_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = dictionary.set_enabled(_table(spark, sf_dir, "dict_sources"), 2, False)
    rows = dictionary.apply_sources(_table(spark, sf_dir, "entries").select("entry_id", "source_id"), off)
    return rows.groupBy("source_id").agg(F.count("*").alias("n"))


@query
def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dictionary.lookup_entries(_asked(spark, LOOKUPS), _table(spark, sf_dir, "entries"), _table(spark, sf_dir, "dict_sources"))
    return found.select("query_id", "key", "entry_id", "source_priority")


@query
def entry_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.with_ordinals(_table(spark, sf_dir, "entries")).select("ordinal", "entry_id")


@query
def idiom_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "lookup_history").select(F.col("query").alias("query_id"), "query").filter(F.col("query").contains(" ")).distinct()
    found = dictionary.idiom_focus(asked, _table(spark, sf_dir, "entries"))
    return found.groupBy(F.col("query_id").alias("query")).agg(F.count("*").alias("idioms"), F.count_distinct("entry_id").alias("entries"))


@query
def word_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, (*LOOKUPS, (6, "gardning"), (7, "weigh the old scales"), (8, "running")))
    return service.word_cascade(asked, _table(spark, sf_dir, "entries"), _table(spark, sf_dir, "dict_sources"))


@query
def english_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.vocabulary_ids(lexicon.english_vocabulary(_table(spark, sf_dir, "entries")))


@query
def vietnamese_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.vocabulary_ids(lexicon.vietnamese_vocabulary(_table(spark, sf_dir, "entries")))


@query
def em_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training on the dictionary's words only: two iterations, the whole table."""
    entries = _table(spark, sf_dir, "entries")
    t = lexicon.train(_table(spark, sf_dir, "parallel_pairs"), 2, english=lexicon.english_vocabulary(entries), vietnamese=lexicon.vietnamese_vocabulary(entries))
    return t.select("e", "f", F.round("t", 6).alias("t"))


@query
def lexicon_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = lexicon.top_translations(_lexicon(spark, sf_dir, 4))
    senses = _table(spark, sf_dir, "entries").select(F.col("headword_norm").alias("en"), F.explode("senses").alias("s"))
    asked = senses.select("en", F.explode("s.glosses").alias("gloss")).select("en", F.explode(text.split_tokens(F.col("gloss"))).alias("vi")).distinct()
    return lexicon.probabilities(asked, table).select("en", "vi", F.round("p", 6).alias("p"))


@query
def gloss_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("gloss")
    return _glosses(spark, sf_dir).distinct().select("entry_id", "gloss", text.shorten(g).alias("short"), text.is_junk_gloss(g).alias("junk"), text.normalize_vietnamese(g).alias("plain"))


@query
def usable_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.usable_glosses(_glosses(spark, sf_dir)).groupBy("gloss").agg(F.count("*").alias("n"))


@query
def history_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.described(_log(spark, sf_dir), 2024)


@query
def history_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.matching(_log(spark, sf_dir), "SET")
    return rows.groupBy("mode", "query", text.looks_like_sentence(F.col("query")).alias("sentence"), text.paste_normalize(F.col("query")).alias("pasted")).agg(F.count("*").alias("n"))


@query
def history_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.compact(history.explicit(_table(spark, sf_dir, "lookup_history")), 1000, 2000)


@query
def paragraph_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.paragraph_pieces(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"))


def _store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The store of a folder's entries, built once an application in the shared folder."""
    name = hashlib.md5(f"{spark.sparkContext.applicationId}:{sf_dir}".encode()).hexdigest()  # noqa: S324
    folder = f"{ensure_checkpoint_dir(spark)}/store-{name}"
    if store.locate(spark, [folder]) is None:
        files = int(spark.conf.get("spark.sql.shuffle.partitions"))
        store.write_store(_table(spark, sf_dir, "entries"), folder, files, _table(spark, sf_dir, "dict_sources"))
    return store.read_store(spark, folder)


@query
def store_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _store(spark, sf_dir)
    return parts["postings"].groupBy("index").agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"))


@query
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_asking_glosses(spark, sf_dir), lambda q: store.search(_store(spark, sf_dir), q, 10))


@query
def store_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.fuzzy(_store(spark, sf_dir), _asked(spark, FUZZY), 10)


@query
def store_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.verify(_store(spark, sf_dir))


def _glossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _table(spark, sf_dir, "parallel_pairs").select(F.col("line_no").alias("sentence_id"), F.col("en").alias("sentence"))
    return gloss.gloss_sentences(pairs, _table(spark, sf_dir, "entries"), _table(spark, sf_dir, "dict_sources"))


@query
def resolved_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.resolved_ratio(_glossed(spark, sf_dir))


@query
def flat_gloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service.flat_gloss(_glossed(spark, sf_dir))


@query
def gloss_segments_likely(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glosses in the order of the lexicon's likelihood."""
    pairs = _table(spark, sf_dir, "parallel_pairs").select(F.col("line_no").alias("sentence_id"), F.col("en").alias("sentence"))
    table = checkpointed(lexicon.top_translations(_lexicon(spark, sf_dir, 4)))
    return gloss.first_glosses(pairs, _table(spark, sf_dir, "entries"), _table(spark, sf_dir, "dict_sources"), lexicon=table)


@query
def gloss_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _table(spark, sf_dir, "parallel_pairs").select(F.col("line_no").alias("sentence_id"), F.col("en").alias("sentence"))
    return gloss.first_glosses(pairs, _table(spark, sf_dir, "entries"), _table(spark, sf_dir, "dict_sources"))


@query
def rule_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _table(spark, sf_dir, "parallel_pairs").select(F.col("line_no").alias("text_id"), F.col("en").alias("text"))
    return translate.translate_texts(pairs, _table(spark, sf_dir, "entries"), _table(spark, sf_dir, "dict_sources"))


@query
def subword_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode = subword.encoder(subword.read_vocabulary(subword.model_lines()), unknown=0, end=2)
    return _table(spark, sf_dir, "parallel_pairs").select("line_no", encode("en").alias("ids"))

"""The stored dictionary: entries, keys, indexes, compounds, lexicon and catalogue.

All parts are Parquet sorted by what they are asked by, so that a look-up reads the row
groups that may hold its keys. Searches for few terms read postings by term; those for many
read the entries once, with the stored numbers of the terms.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import bm25, bm25_idf, trigrams
from lexiloom.operators.dictionary import all_keys, apply_sources, dictionary_stats, source_totals, with_ordinals
from lexiloom.operators.search import compounds, gloss_documents, rank_blocks, rank_hits, route, show_hits, suggest, top_per_query
from lexiloom.sources.files import display_name, pick_reader

INDEXES = ("vi", "vi_plain", "tri")
#: Asked terms that are written into the scan's filter; more are joined.
FEW_TERMS = 1_000


def _indexed(entries: DataFrame, name: str) -> DataFrame:
    """``(doc_id, tokens)`` of one index."""
    if name == "tri":
        return entries.select(F.col("entry_id").alias("doc_id"), trigrams(F.col("headword_norm")).alias("tokens"))
    return gloss_documents(entries, fold=name == "vi_plain")


def write_store(entries: DataFrame, folder: str, files: int = 8, sources: DataFrame | None = None, lexicon: DataFrame | None = None) -> None:
    """Entries with their ordinals, keys, the three indexes with the terms' and documents'
    numbers, compounds, and what of catalogue and lexicon there is."""

    def save(df: DataFrame, name: str, *order: str) -> None:
        df.repartitionByRange(files, *order[:1]).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/{name}")

    save(with_ordinals(entries), "entries", "headword_norm", "ordinal")
    save(all_keys(entries), "keys", "key", "entry_id")
    for name in INDEXES:
        docs = _indexed(entries, name)
        rows = docs.select("doc_id", F.size("tokens").cast("long").alias("doc_len"), F.explode("tokens").alias("term"))
        posts = rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))
        save(posts, f"postings/index={name}", "term", "doc_id")
        saved = entries.sparkSession.read.parquet(f"{folder}/postings/index={name}")
        save(saved.groupBy("term").agg(F.count("*").alias("df")), f"terms/index={name}", "term")
        lengths = docs.select(F.greatest(F.size("tokens"), F.lit(0)).cast("long").alias("n"))
        stats = lengths.agg(F.count("*").alias("docs"), F.greatest(F.lit(1.0), F.coalesce(F.avg("n"), F.lit(0.0))).alias("average"))
        stats.coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats/index={name}")
    save(compounds(entries, 3), "compounds", "compound")
    if sources is not None:
        sources.coalesce(1).write.mode("overwrite").parquet(f"{folder}/sources")
    if lexicon is not None:
        write_lexicon(lexicon, folder, files)


def write_lexicon(lexicon: DataFrame, folder: str, files: int = 8) -> None:
    """``(e, f, rank, q)`` sorted by word; what is quantized to nothing is left out."""
    lexicon.filter(F.col("q") > 0).repartitionByRange(files, "e").sortWithinPartitions("e", "rank").write.mode("overwrite").parquet(f"{folder}/lexicon")


def read_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """The stored lexicon; an empty one, by which nothing is likely, where none is stored."""
    try:
        return spark.read.parquet(f"{folder}/lexicon")
    except AnalysisException:
        return spark.createDataFrame([], "e string, f string, rank int, q int")


def read_store(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The parts by name; ``sources`` only where the store has a catalogue."""
    parts = {n: spark.read.parquet(f"{folder}/{n}") for n in ("entries", "keys", "postings", "terms", "stats", "compounds")}
    parts["lexicon"] = read_lexicon(spark, folder)
    try:
        parts["sources"] = spark.read.parquet(f"{folder}/sources")
    except AnalysisException:
        pass
    return parts


def locate(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first folder that holds a store."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in candidates:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/keys")
        if path.getFileSystem(conf).exists(path):
            return folder
    return None


def build(spark: SparkSession, files: list[str], folder: str, parts: int = 8) -> DataFrame:
    """A store of dictionary files, the first of which is the base; gives its catalogue.

    A source's id is its place in the list. Missing files are skipped and leave a gap; a
    file that no reader takes is an error. Extra sources come before the base.
    """
    read, catalog = [], []
    for i, path in enumerate(files):
        if locate_file(spark, path) is None:
            continue
        first = [r["value"] for r in spark.read.text(path).limit(20).collect()]
        form, reader = pick_reader(Path(path).name, first)
        read.append((i, reader(spark, path, i)))
        catalog.append((i, display_name(Path(path).name, first), form, Path(path).name))
    if not read:
        raise ValueError("none of the files is there")
    none = F.array().cast("array<struct<phrase:string,glosses:array<string>,examples:array<struct<en:string,vi:string,gloss_index:int>>>>")
    wanted = {"ipa": F.lit(None).cast("string"), "variant": F.lit(None).cast("string"), "idioms": none, "cross_refs": F.array().cast("array<string>")}
    same = [df.select("source_id", "source_line", "headword", "headword_norm", "senses", *[F.col(c) if c in df.columns else v.alias(c) for c, v in wanted.items()]) for _, df in read]
    whole = same[0]
    for df in same[1:]:
        whole = whole.unionByName(df)
    # ids follow the order of the dictionary, so that they don't depend on how files are split
    ordered = with_ordinals(whole.withColumn("entry_id", F.xxhash64("source_id", "source_line", "headword"))).withColumn("entry_id", F.col("ordinal")).drop("ordinal")
    counts = {r["source_id"]: r["count"] for r in ordered.groupBy("source_id").count().collect()}
    rows = [(i, name, form, file, int(counts.get(i, 0)), 1, len(catalog) - 1 if i == 0 else i - 1) for i, name, form, file in catalog]
    sources = spark.createDataFrame(rows, "id int, name string, format string, file string, entries int, enabled int, priority int")
    write_store(ordered, folder, parts, sources)
    return sources


def locate_file(spark: SparkSession, path: str) -> str | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def _few(asked: DataFrame) -> list[str] | None:
    """The asked terms, if they are few."""
    terms = [r["term"] for r in asked.select(F.explode("tokens").alias("term")).distinct().limit(FEW_TERMS + 1).collect()]
    return terms if len(terms) <= FEW_TERMS else None


def _stats(store: dict[str, DataFrame], name: str) -> tuple[int, float]:
    stats = store["stats"].filter(F.col("index") == name).first()
    return (stats["docs"], stats["average"]) if stats else (0, 1.0)


def _hits(store: dict[str, DataFrame], name: str, asked: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score, matched, asked)`` from the postings of the asked terms."""
    terms = asked.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"), F.size(F.array_distinct("tokens")).alias("asked"))
    few = _few(asked)
    posts, df = (store[part].filter(F.col("index") == name) for part in ("postings", "terms"))
    if few is not None:  # pushed down to the sorted row groups
        posts, df = posts.filter(F.col("term").isin(few)), df.filter(F.col("term").isin(few))
    n, average = _stats(store, name)
    found = terms.join(df.select("term", "df"), "term").join(posts.select("term", "doc_id", "tf", "doc_len"), "term")
    score = bm25(bm25_idf(F.lit(float(n)), F.col("df")), F.col("tf"), F.col("doc_len"), F.lit(float(average)), b=0.2)
    return found.withColumn("s", score).groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"), F.count("*").alias("matched"), F.max("asked").alias("asked"))


def search(store: dict[str, DataFrame], queries: DataFrame, k: int = 20) -> DataFrame:
    """``(query_id, doc_id, headword, score, rank, display, matched_gloss)``.

    A query without accents is asked of the accent-free index, another of the accented.
    Only entries of enabled sources are hits, if the store has a catalogue. Many terms are
    asked of the entries in blocks, for their hits would be far more than the entries.
    """
    asked = route(queries)
    out = []
    for fold, name in ((False, "vi"), (True, "vi_plain")):
        mine = asked.filter(F.col("fold") == fold)
        if _few(mine) is not None:
            best = rank_hits(_hits(store, name, mine), store["entries"], mine, k, fold, store.get("sources"))
        else:
            df = store["terms"].filter(F.col("index") == name).select("term", "df")
            best = rank_blocks(store["entries"], mine, df, *_stats(store, name), k, fold, store.get("sources"))
        out.append(show_hits(best, store["entries"], mine, fold))
    return out[0].unionByName(out[1])


def fuzzy(store: dict[str, DataFrame], queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, doc_id, headword_norm, score, rank)``: the nearest headwords by letter
    triples, of enabled sources; homographs count once, by their lowest id."""
    asked = queries.select("query_id", trigrams(F.lower("query")).alias("g"))
    grams = asked.select("query_id", F.size("g").alias("qn"), F.explode("g").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"), F.first("qn").alias("qn"))
    some = store["entries"] if "sources" not in store else apply_sources(store["entries"], store["sources"])
    heads = some.filter(F.col("headword_norm") != "").groupBy("headword_norm").agg(F.min("entry_id").alias("doc_id"))
    posts = store["postings"].filter(F.col("index") == "tri").select("term", "doc_id", "tf", "doc_len").join(heads, "doc_id")
    pairs = grams.join(posts, "term").groupBy("query_id", "doc_id", "headword_norm").agg(F.sum(F.least("qtf", "tf")).alias("m"), F.first("qn").alias("qn"), F.first("doc_len").alias("dn"))
    return top_per_query(pairs.withColumn("score", F.col("m") / (F.col("qn") + F.col("dn") - F.col("m"))).select("query_id", "doc_id", "headword_norm", "score"), k)


def did_you_mean(store: dict[str, DataFrame], queries: DataFrame, k: int = 5) -> DataFrame:
    return suggest(store["compounds"].select("compound"), queries, k)


def verify(store: dict[str, DataFrame]) -> DataFrame:
    """``(check, ok, detail)``: what must hold of a store."""
    entries, keys = store["entries"], store["keys"]
    n = entries.count()
    stats = dictionary_stats(entries).first()
    checks = [("entries", n > 0, str(n)), ("keys cover headwords", keys.filter(~F.col("is_alias")).count() == entries.filter(F.col("headword_norm") != "").count(), str(keys.count()))]
    ends = entries.agg(F.min("ordinal"), F.max("ordinal"), F.count_distinct("ordinal")).first()
    checks.append(("ordinals are dense", n == 0 or tuple(ends) == (0, n - 1, n), str(tuple(ends))))
    checks.append(("aliases are no headwords", keys.filter("is_alias").join(keys.filter("not is_alias"), "key", "left_semi").limit(1).count() == 0, ""))
    checks.append(("keys lead to entries", keys.join(entries, "entry_id", "left_anti").limit(1).count() == 0, ""))
    for name in INDEXES:
        posts = store["postings"].filter(F.col("index") == name)
        checks.append((f"{name}: postings lead to entries", posts.join(entries, posts["doc_id"] == entries["entry_id"], "left_anti").limit(1).count() == 0, ""))
        checks.append((f"{name}: numbers of terms", posts.groupBy("term").count().join(store["terms"].filter(F.col("index") == name), "term").filter(F.col("count") != F.col("df")).limit(1).count() == 0, ""))
    if "sources" in store:
        wrong = source_totals(entries, store["sources"]).filter(F.col("declared").isNotNull() & (F.col("declared") != F.col("found"))).count()
        checks.append(("catalogue's numbers", wrong == 0, f"{wrong} sources differ; {stats['entries']} entries"))
    return entries.sparkSession.createDataFrame(checks, "check string, ok boolean, detail string")

"""Inverted indexes, relevance and fuzzy search, compounds and spelling suggestions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions.text import bm25, bm25_boost, bm25_idf, gloss_alternatives, remove_diacritics, split_tokens, word_count
from lexiloom.operators.dictionary import apply_sources
from lexiloom.session import spread


#: Asked terms up to which they are looked for within a row instead of by a join.
FEW_TERMS = 1_000
#: Queries that a task compares at once, and texts of the other side.
ASKED_ONCE, BLOCK = 50_000, 1 << 16


def postings(docs: DataFrame) -> DataFrame:
    """``(term, doc_id, tf)`` of ``docs`` = ``(doc_id, tokens)``."""
    return docs.select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def doc_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    """``(doc_id, doc_len)``, documents without tokens included."""
    return docs.select("doc_id", F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0)).cast("long").alias("doc_len"))


def corpus_stats(docs: DataFrame) -> tuple[int, float]:
    """Number of documents and their average length, 1 at least."""
    r = doc_lengths(docs).agg(F.count("*").alias("n"), F.avg("doc_len").alias("a")).first()
    return r["n"], max(1.0, r["a"] or 0.0)


def gloss_documents(entries: DataFrame, fold: bool = False, *more: Column) -> DataFrame:
    """Entries as documents: tokens of sense glosses, then of idiom glosses."""
    of = lambda xs: F.flatten(F.transform(F.coalesce(xs, F.array()), lambda x: F.coalesce(x["glosses"], F.array().cast("array<string>"))))
    text = F.array_join(F.concat(of(F.col("senses")), of(F.col("idioms"))), "\n")
    return entries.select(F.col("entry_id").alias("doc_id"), split_tokens(remove_diacritics(text) if fold else text).alias("tokens"), *more)


def bm25_scores(docs: DataFrame, queries: DataFrame, b: float = 0.2) -> DataFrame:
    """``(query_id, doc_id, score, matched, asked)`` of the documents that share a term.

    ``queries`` is ``(query_id, tokens)``. Documents are scanned once: only the tokens
    that some query asks for leave the scan, which is what makes it one pass over any
    number of documents. Lengths come along with the row, so nothing joins them back.
    """
    n, average = corpus_stats(docs)
    asked = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"), F.size(F.array_distinct("tokens")).alias("asked"))
    few = [r["term"] for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    if len(few) <= FEW_TERMS:  # picked within the row, before anything is exploded
        rows = docs.select("doc_id", F.size("tokens").alias("doc_len"), F.explode(F.filter("tokens", lambda t: t.isin(few))).alias("term"))
    else:
        rows = docs.select("doc_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
        rows = rows.join(asked.select("term").distinct(), "term", "left_semi")
    hits = rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(df, "term").withColumn("s", bm25(bm25_idf(F.lit(float(n)), F.col("df")), F.col("tf"), F.col("doc_len"), F.lit(float(average)), b=b))
    return scored.join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"), F.count("*").alias("matched"), F.max("asked").alias("asked"))


def top_per_query(scored: DataFrame, k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The best ``k`` of each query; scores are compared rounded, ties go to the lower id."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), tie)
    return scored.withColumn(score, F.round(score, 6)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def route(queries: DataFrame) -> DataFrame:
    """``(query_id, query, fold, q, tokens)``: a query without accents is asked without."""
    plain = remove_diacritics(F.col("query")) == F.col("query")
    q = F.lower(F.col("query"))
    return queries.select("query_id", "query", plain.alias("fold"), q.alias("q"), split_tokens(q).alias("tokens"))


def _glosses(xs: Column, display: Column | None = None) -> Column:
    """The glosses of senses or idioms in order, each with what is shown as its word."""
    shown = (lambda x: x["phrase"]) if display is None else (lambda x: display)
    return F.flatten(F.transform(F.coalesce(xs, F.array()), lambda x: F.transform(F.coalesce(x["glosses"], F.array().cast("array<string>")), lambda g: F.struct(shown(x).alias("display"), g.alias("gloss")))))


def _glosses_only(entries: DataFrame) -> DataFrame:
    """Entries with the glosses of their senses and idioms, without all else."""
    only = lambda c: F.transform(c, lambda x: F.struct(x["glosses"].alias("glosses"))).alias(c)
    return entries.select("entry_id", "headword", "headword_norm", only("senses"), only("idioms"))


def _boosted(entries: DataFrame, fold: bool) -> DataFrame:
    """What decides on an entry's boosts: synonyms, first glosses, one word, short; and its tokens."""
    folded = (lambda c: F.lower(remove_diacritics(c))) if fold else F.lower
    glosses = F.flatten(F.transform(F.coalesce("senses", F.array()), lambda s: F.coalesce(s["glosses"], F.array().cast("array<string>"))))
    synonyms = F.array_distinct(F.flatten(F.transform(glosses, lambda g: gloss_alternatives(folded(F.coalesce(g, F.lit("")))))))
    first = F.transform(F.coalesce("senses", F.array()), lambda s: folded(F.coalesce(F.get(s["glosses"], F.lit(0)), F.lit(""))))
    holds = lambda c: F.coalesce(c, F.lit(False))
    one, brief = holds(word_count(F.col("headword_norm")) == 1), holds(F.length("headword_norm") <= 6)
    return gloss_documents(entries, fold, F.col("headword"), synonyms.alias("synonyms"), first.alias("firsts"), one.alias("one"), brief.alias("brief"))


def rank_hits(hits: DataFrame, entries: DataFrame, asked: DataFrame, k: int, fold: bool, sources: DataFrame | None = None) -> DataFrame:
    """The best ``k`` hits of each query, boosted, of enabled sources only.

    ``hits`` is ``(query_id, doc_id, score, matched, asked)``, ``asked`` ``(query_id, q)``.
    """
    some = entries if sources is None else apply_sources(entries, sources)
    # taken apart once an entry, not once a hit
    joined = hits.join(_boosted(some, fold).drop("tokens"), "doc_id").join(asked.select("query_id", "q"), "query_id")
    whole = F.array_contains("synonyms", F.col("q"))
    primary = F.exists("firsts", lambda g: F.contains(g, F.col("q")))
    boost = bm25_boost(whole, primary, F.col("one"), F.when(F.col("brief"), 0).otherwise(7))
    scored = joined.withColumn("score", F.col("score") * boost * F.pow(F.col("matched") / F.col("asked"), F.lit(2.0)))
    return top_per_query(scored.select("query_id", "doc_id", "headword", "score"), k)


def show_hits(best: DataFrame, entries: DataFrame, asked: DataFrame, fold: bool) -> DataFrame:
    """Ranked hits with the gloss that matched and what is shown as its word.

    That is the gloss with most of the query's terms, the earliest of several; one of an
    idiom shows the whole idiom.
    """
    terms = F.array_distinct("tokens")
    info = entries.select(F.col("entry_id").alias("doc_id"), F.concat(_glosses(F.col("senses"), F.col("headword")), _glosses(F.col("idioms"))).alias("_glosses"))
    joined = best.join(info, "doc_id").join(asked.select("query_id", "tokens"), "query_id")
    text = lambda g: F.coalesce(remove_diacritics(g) if fold else g, F.lit(""))
    scored = F.transform("_glosses", lambda g, i: F.struct((-F.size(F.array_intersect(split_tokens(text(g["gloss"])), terms))).alias("m"), i.alias("i"), g["display"].alias("display"), g["gloss"].alias("gloss")))
    top = F.array_min(scored)
    return joined.select(*best.columns, top["display"].alias("display"), top["gloss"].alias("matched_gloss"))


def search_vietnamese(entries: DataFrame, queries: DataFrame, k: int = 20, fold: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """Reverse search: BM25 over glosses, boosted, times the squared share of terms met.

    ``queries`` is ``(query_id, query)``. Boosts: the query is a whole synonym, it stands
    in a first gloss, the headword is one word, the headword is short. Weights beyond the
    boosts are this project's choice.
    """
    prepared = queries.withColumn("q", F.lower(remove_diacritics(F.col("query")) if fold else F.col("query")))
    terms = prepared.select("query_id", "q", split_tokens(F.col("q")).alias("tokens"))
    docs = gloss_documents(entries, fold)
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return rank_blocks(entries, terms, df, *corpus_stats(docs), k, fold, sources)


def rank_blocks(entries: DataFrame, asked: DataFrame, df: DataFrame, n: int, average: float, k: int, fold: bool, sources: DataFrame | None = None) -> DataFrame:
    """The same as ``rank_hits`` of the hits of ``asked`` = ``(query_id, q, tokens)``, any number of queries.

    Documents are compared with all queries in blocks within a task, so that no hit is a row
    but those that may be among the best. ``df`` is ``(term, df)``, ``n`` and ``average`` the
    number of documents and their length; ``ASKED_ONCE`` queries are asked in a pass.
    """
    rows = asked.select("query_id", "q", F.array_distinct("tokens").alias("tokens")).filter(F.size("tokens") > 0).toArrow()
    wanted = asked.select(F.explode("tokens").alias("term")).distinct()
    numbers = df.join(wanted, "term", "left_semi").select("term", bm25_idf(F.lit(float(n)), F.col("df")).alias("idf")).toArrow()
    some = spread(_glosses_only(entries if sources is None else apply_sources(entries, sources)))
    info = _boosted(some, fold).withColumn("firsts", F.array_join("firsts", "\0"))
    schema = f"query_id {dict(asked.dtypes)['query_id']}, doc_id {dict(entries.dtypes)['entry_id']}, headword string, score double"
    passes = [info.mapInArrow(_best_hits(rows.slice(i, ASKED_ONCE), numbers, average, k), schema) for i in range(0, max(1, rows.num_rows), ASKED_ONCE)]
    return top_per_query(reduce(DataFrame.unionByName, passes), k)


def _grams(text: str, repeated: bool) -> list[str]:
    """The letter triples of a text, each once; where ``repeated``, a second one is another triple."""
    padded = f"$${text}$$"
    grams = [padded[i : i + 3] for i in range(len(text) + 2)] if text else []
    if len(once := dict.fromkeys(grams)) == len(grams) or not repeated:
        return list(once)
    seen: Counter[str] = Counter()
    out = []
    for g in grams:
        out.append(f"{g}{seen[g] or ''}")
        seen[g] += 1
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _best_hits(asked: pa.Table, numbers: pa.Table, average: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(query_id, doc_id, headword, score)``: of a task's documents the best ``k`` for each query and their ties.

    Of documents of the very same score the ``k`` lowest ids. ``numbers`` is ``(term, idf)`` of the asked terms.
    """
    ids, texts = asked["query_id"].combine_chunks(), asked["q"].to_pylist()
    terms, idf = numbers["term"].combine_chunks(), numbers["idf"].to_numpy()
    number = {t: i for i, t in enumerate(terms.to_pylist())}
    tokens = asked["tokens"].to_pylist()
    k1, b = 1.2, 0.2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [np.array([number[t] for t in ts if t in number], "i8") for ts in tokens]
        names = pa.array(dict.fromkeys(texts), pa.string())
        of_name = {t: i for i, t in enumerate(names.to_pylist())}
        floors = np.zeros(len(texts))
        for block in _blocks(batches):
            n, doc_ids = block.num_rows, block["doc_id"].to_numpy()
            place, code = _codes(block["tokens"], terms)
            both, tf = np.unique(code * n + place, return_counts=True)
            code, place = both // n, both % n
            length = np.asarray(pc.list_value_length(block["tokens"]).fill_null(0), "f8")
            weight = idf[code] * tf * (k1 + 1) / (tf + k1 * ((1.0 - b) + b * length[place] / average))
            ends = np.searchsorted(code, np.arange(len(terms) + 1))
            syn_place, syn = _codes(block["synonyms"], names)
            order = np.argsort(syn, kind="stable")
            syn_place, syn_ends = syn_place[order], np.searchsorted(syn[order], np.arange(len(names) + 1))
            one, brief = (np.where(np.asarray(block[c]), factor, 1.0) for c, factor in (("one", 1.4), ("brief", 1.2)))
            at, found, scores = [], [], []
            for i, w in enumerate(wanted):
                spans = [slice(ends[t], ends[t + 1]) for t in w.tolist() if ends[t + 1] > ends[t]]
                if not spans:
                    continue
                where = np.concatenate([place[x] for x in spans])
                matched = np.bincount(where, minlength=n)
                total = np.bincount(where, weights=np.concatenate([weight[x] for x in spans]), minlength=n)
                some = np.flatnonzero(matched)
                whole = np.ones(n)
                name = of_name[texts[i]]
                whole[syn_place[syn_ends[name] : syn_ends[name + 1]]] = 3.0
                size, matched, total, whole = len(tokens[i]), matched[some], total[some], whole[some]
                share = (matched / size) ** 2.0
                score = lambda boost: total * (boost * one[some] * brief[some]) * share  # noqa: B023, E731
                low = score(whole)
                floor = max(floors[i], np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else 0.0)
                # of a text in a first gloss all tokens but the two at its ends stand there whole
                may = np.flatnonzero((matched >= size - 2) & (low * 1.8 >= floor - 1e-5))
                if len(may):
                    holds = np.asarray(pc.match_substring(block["firsts"].take(pa.array(some[may])), texts[i]).fill_null(False))
                    whole[may[holds]] *= 1.8
                    low = score(whole)
                    floor = max(floor, np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else 0.0)
                floors[i] = floor
                keep = np.flatnonzero(low >= floor - 2e-6)  # scores are compared rounded
                keep = keep[np.lexsort((doc_ids[some[keep]], -low[keep]))]
                _, first, inverse = np.unique(-low[keep], return_index=True, return_inverse=True)
                keep = keep[np.arange(len(keep)) - first[inverse] < k]
                at.append(np.full(len(keep), i))
                found.append(some[keep])
                scores.append(low[keep])
            if at:
                docs = pa.array(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(at))), block["doc_id"].take(docs), block["headword"].take(docs), pa.array(np.concatenate(scores))], ["query_id", "doc_id", "headword", "score"])

    return run


def _codes(lists: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of what is listed and named: the place of its list, and the number of its name."""
    code = pc.index_in(lists.flatten(), value_set=names)
    there = np.asarray(code.is_valid())
    return np.asarray(pc.list_parent_indices(lists), "i8")[there], np.asarray(code.drop_null(), "i8")


def _nearest(asked: pa.Table, k: int, least: float, repeated: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best ``k`` of a task's texts ``(id, text)`` for each of ``asked`` = ``(query_id, query)``, and their ties.

    The texts come in blocks; of a block the triples that are asked for lead to its texts, so that
    no pair is a row. A score of m common triples is at most m / those of the query, by which all
    are left out that can't be among the best.
    """
    ids, texts = asked["query_id"].combine_chunks(), asked["query"].to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        wanted = [np.array([number.setdefault(g, len(number)) for g in _grams(q, repeated)], "i4") for q in texts]
        for block in _blocks(batches):
            grams = [_grams(t, repeated) for t in block["text"].to_pylist()]
            sizes = np.array([len(g) for g in grams])
            met = [[n for g in gs if (n := number.get(g)) is not None] for gs in grams]
            place = np.repeat(np.arange(len(met), dtype="i4"), [len(x) for x in met])
            gram = np.fromiter((n for x in met for n in x), "i4", len(place))
            place = place[np.argsort(gram, kind="stable")]
            ends = np.cumsum(np.bincount(gram, minlength=len(number)))
            starts = np.concatenate([[0], ends])
            at, found, scores = [], [], []
            for i, w in enumerate(wanted):
                lists = [place[starts[g] : ends[g]] for g in w.tolist() if ends[g] > starts[g]]
                if not lists:
                    continue
                common = np.bincount(np.concatenate(lists), minlength=len(met))
                floor = max(least, best(common, sizes, len(w)))
                some = np.flatnonzero(common >= max(1, np.ceil(floor * len(w) - 1e-9)))
                m = common[some]
                score = m / (len(w) + sizes[some] - m)
                keep = score >= floor - 1e-6  # scores are compared rounded
                keep &= score >= least
                at.append(np.full(keep.sum(), i))
                found.append(some[keep])
                scores.append(score[keep])
            if at:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(at))), *(block[c].take(pa.array(np.concatenate(found))) for c in ("id", "text")), pa.array(np.concatenate(scores))], ["query_id", "id", "text", "score"])

    def best(common: np.ndarray, sizes: np.ndarray, n: int) -> float:
        """A score that ``k`` of the texts reach."""
        have = np.cumsum(np.bincount(common)[:0:-1])
        if not len(have) or have[-1] < k:
            return 0.0
        some = np.flatnonzero(common >= len(have) - np.searchsorted(have, k))
        scores = common[some] / (n + sizes[some] - common[some])
        return float(np.partition(scores, len(scores) - k)[len(scores) - k])

    return run


def nearest(texts: DataFrame, asked: DataFrame, k: int, least: float = 0.0, repeated: bool = False) -> DataFrame:
    """``(query_id, id, text, score)`` by the Jaccard similarity of letter triples: of each task of
    ``texts`` = ``(id, text)`` its best ``k`` for each of ``asked`` = ``(query_id, query)`` with their ties.

    Any number of queries is asked, ``ASKED_ONCE`` of them in a pass over the texts.
    """
    rows = asked.select("query_id", "query").filter(F.col("query").isNotNull()).toArrow()
    kinds = dict(texts.dtypes)
    # comparing costs far more than moving: over all cores, whatever the number of bytes
    texts = texts.repartition(2 * texts.sparkSession.sparkContext.defaultParallelism)
    schema = f"query_id {dict(asked.dtypes)['query_id']}, id {kinds['id']}, text string, score double"
    passes = [texts.select("id", "text").mapInArrow(_nearest(rows.slice(i, ASKED_ONCE), k, least, repeated), schema) for i in range(0, max(1, rows.num_rows), ASKED_ONCE)]
    return reduce(DataFrame.unionByName, passes)


def fuzzy_english(entries: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Headwords nearest to each query by their letter triples; ties to the lower id.

    Triples count as often as both sides have them.
    """
    # homographs share a headword: compare each once
    heads = entries.filter(F.col("headword_norm") != "").groupBy("headword_norm").agg(F.min("entry_id").alias("id"))
    found = nearest(heads.withColumnRenamed("headword_norm", "text"), queries.select("query_id", F.lower("query").alias("query")), k, repeated=True)
    return top_per_query(found.select("query_id", F.col("id").alias("doc_id"), F.col("text").alias("headword_norm"), "score"), k)


def compounds(entries: DataFrame, least: int = 3) -> DataFrame:
    """``(compound, n)``: synonyms of two or three all-letter syllables, often enough."""
    of = lambda xs: F.flatten(F.transform(F.coalesce(xs, F.array()), lambda x: F.coalesce(x["glosses"], F.array().cast("array<string>"))))
    gloss = entries.select(F.explode(F.concat(of(F.col("senses")), of(F.col("idioms")))).alias("gloss")).filter(F.col("gloss").isNotNull())
    alts = gloss.select(F.explode(gloss_alternatives(F.lower("gloss"))).alias("compound"))
    return alts.filter(F.col("compound").rlike(r"^\p{L}+( \p{L}+){1,2}$")).groupBy("compound").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def suggest(words: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.5) -> DataFrame:
    """Did you mean: compounds whose accent-free letter triples resemble the query's.

    A query of one syllable, or one that is a compound already but for its accents, has no
    suggestion.
    """
    known = words.select(F.col("compound").alias("id"), remove_diacritics(F.col("compound")).alias("text"))
    asked = queries.select("query_id", remove_diacritics(F.lower("query")).alias("query")).filter(F.instr("query", " ") > 0)
    asked = asked.join(known.select(F.col("text").alias("query")).distinct(), "query", "left_anti")
    found = nearest(known, asked, k, least)
    return top_per_query(found.select("query_id", F.col("id").alias("compound"), "score"), k, tie="compound")


def expand_compounds(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """``(doc_id, pos, term)``: the syllables and the compounds they form, joined by ``_``.

    The runs of two and three are made within the row, so that none carries the document.
    """
    grams = lambda n: F.transform(F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - n + 1, F.lit(0))), lambda _, i: F.struct(i.alias("pos"), F.array_join(F.slice("tokens", i + 1, n), " ").alias("compound")))
    found = tokens.select("doc_id", F.inline(F.concat(grams(2), grams(3)))).join(words.select("compound"), "compound", "left_semi")
    found = found.select("doc_id", "pos", F.replace("compound", F.lit(" "), F.lit("_")).alias("term"))
    return tokens.select("doc_id", F.posexplode("tokens").alias("pos", "term")).unionByName(found)


def accent_forms(terms: DataFrame) -> DataFrame:
    """``(folded, forms)``: the accented forms of each accent-free term, in order."""
    return terms.select("term").distinct().groupBy(remove_diacritics(F.col("term")).alias("folded")).agg(F.sort_array(F.collect_list("term")).alias("forms"))


def longest_postings(posts: DataFrame) -> int:
    """The number of postings of the commonest term."""
    return doc_frequency(posts).agg(F.max("df")).first()[0] or 0

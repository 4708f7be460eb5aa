"""Glossing sentences: longest phrases first, then words, tiled over the sentence.

Dictionary look-ups are joins over all distinct forms at once. Sentences meet what was
found by chunks: a chunk gets each of its forms once, however often it occurs there, so that
no word carries its candidates along. Only the greedy scan of a sentence, which depends on
what was taken before it, is a function of one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.segment import tokenize
from lexiloom.functions.tables import FUNCTION_WORDS, OBJECT_PRONOUNS
from lexiloom.functions.text import is_junk_gloss, lemma_candidates, normalize_headword
from lexiloom.operators.dictionary import NO_PRIORITY, all_keys, chosen_forms, phrase_candidates, phrase_starters, ranked_candidates
from lexiloom.operators.lexicon import score_glosses
from lexiloom.session import checkpointed

LONGEST_PHRASE = 4
#: Copies from which on a sentence counted as hot; copies are spread over the chunks now, whatever their number.
HOT_SENTENCE = 1_000
#: Characters of text in a chunk, about; where all candidates of each segment are given, and where not.
CHUNK_WHOLE, CHUNK = 250_000, 1_000_000
#: Pairs that a task remembers to have given already.
REMEMBERED = 300_000
FUNCTION_POS = "từ chức năng"
SEGMENT = "struct<source:string, start:int, end:int, kind:string, candidates:array<struct<headword:string, gloss:string, pos:string, score:double, source_id:int>>>"


CANDIDATES = "array<struct<headword:string,gloss:string,pos:string,score:double,source_id:int>>"
PRIOR = "array<struct<f:string,p:double>>"
Cut = Callable[[str | None], list[str]]


def in_chunks(rows: DataFrame, row_id: str, text: str, size: int = CHUNK) -> tuple[DataFrame, int]:
    """``(chunk, id, text)`` and the number of chunks; copies of a text are spread over them."""
    chars = rows.agg(F.sum(F.coalesce(F.length(text), F.lit(0)) + 8)).first()[0] or 0
    n = max(-(-chars // size), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    chunk = F.pmod(F.xxhash64(row_id, text), F.lit(n)).cast("int")
    return rows.select(chunk.alias("chunk"), F.col(row_id).alias("id"), F.col(text).alias("text")), n


def _vocabulary(placed: DataFrame, cut: Cut) -> DataFrame:
    """``(chunk, word)``: the words of each chunk's sentences, as they stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, str]] = set()
        for b in batches:
            new = {}
            for chunk, text in zip(b["chunk"].to_pylist(), b["text"].to_pylist(), strict=True):
                for sentence in cut(text):
                    new.update(((chunk, t), None) for t, _, _, is_word in tokenize(sentence) if is_word)
            out = [x for x in new if x not in seen]
            seen = seen if len(seen) < REMEMBERED else set()
            seen.update(out)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string())], names=["chunk", "word"])

    return placed.select("chunk", "text").mapInArrow(run, "chunk int, word string").distinct()


def _tries(norms: list[str], heads: list[list[str]]) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """Of each word's place the phrases ``(words, key)`` that may start there: the longest come first,
    then the word as it stands, then its lemmas by rank."""
    for at, hs in enumerate(heads):
        after = norms[at + 1 : at + LONGEST_PHRASE] if hs else ()
        found = [(n, " ".join((h, *after[: n - 1]))) for n in range(len(after) + 1, 1, -1) if after[n - 2] not in OBJECT_PRONOUNS for h in hs]
        if found:
            yield at, found


def _phrases_tried(placed: DataFrame, words: DataFrame, cut: Cut, chunks: int) -> DataFrame:
    """``(chunk, key)``: what is to be looked up as a phrase. ``words`` is ``(chunk, word, norm, heads)``."""

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        norm = dict(zip(known["word"].to_pylist(), known["norm"].to_pylist(), strict=True))
        heads = dict(zip(known["word"].to_pylist(), known["heads"].to_pylist(), strict=True))
        out: dict[str, None] = {}
        for text in set(rows["text"].to_pylist()):
            for sentence in cut(text):
                ws = [t for t, _, _, is_word in tokenize(sentence) if is_word]
                for _, tries in _tries([norm[w] for w in ws], [heads[w] for w in ws]):
                    out.update((key, None) for _, key in tries)
        chunk = rows["chunk"][0].as_py() if rows.num_rows else 0
        return pa.table({"chunk": pa.array([chunk] * len(out), pa.int32()), "key": pa.array(list(out), pa.string())})

    both = [x.repartition(chunks, "chunk").groupBy("chunk") for x in (placed.select("chunk", "text"), words.select("chunk", "word", "norm", "heads"))]
    return both[0].cogroup(both[1]).applyInArrow(run, "chunk int, key string")


def _gathered(candidates: DataFrame, by: str, name: str) -> DataFrame:
    one = F.struct("rank", F.struct("headword", "gloss", "pos", F.col("score").cast("double").alias("score"), F.col("source_id").cast("int").alias("source_id")).alias("c"))
    return candidates.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias(name))


def _weighed(entries: DataFrame) -> DataFrame:
    """Entries without the texts of their examples, of which only the number counts."""
    sense = lambda s: F.struct(s["pos"].alias("pos"), s["glosses"].alias("glosses"), F.transform(s["examples"], lambda _: F.lit(True)).alias("examples"))
    return entries.select("entry_id", "headword", "headword_norm", "source_id", "source_line", F.transform("senses", sense).alias("senses"))


def candidates_by_form(forms: DataFrame, entries: DataFrame, sources: DataFrame | None, keys: DataFrame | None = None) -> DataFrame:
    """``(form, via_lemma, candidates)`` of distinct forms."""
    keys = all_keys(entries) if keys is None else keys
    chosen = checkpointed(chosen_forms(forms.select(F.col("form").alias("query_id"), F.col("form").alias("query")), entries, sources, keys)[0])
    # many forms stand for one: its entries are ranked once
    mine = keys.select(F.col("key").alias("form"), "entry_id").join(chosen.select("form").distinct(), "form", "left_semi")
    ranked = ranked_candidates(mine.join(_weighed(entries), "entry_id"), ["form"], sources)
    found = chosen.join(_gathered(ranked, "form", "candidates"), "form", "left")
    return found.select(F.col("query_id").alias("form"), "via_lemma", F.coalesce("candidates", F.array().cast(CANDIDATES)).alias("candidates"))


def likelihood_order(known: DataFrame, lexicon: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``(form, ..., candidates)`` with each list of two or more in the order of its source's
    priority, then of how likely its glosses translate the form, then as it was.

    Where no synonym of a gloss is known under the form itself, the candidate's headword
    stands for the form.
    """
    rows = known.filter(F.size("candidates") > 1).select("form", F.posexplode("candidates").alias("place", "c"))
    ids = rows.select(F.struct("form", "place").alias("id"), F.col("form").alias("form_en"), F.col("c.headword").alias("head_en"), F.col("c.gloss").alias("gloss"))
    by_form = score_glosses(ids.select("id", F.col("form_en").alias("en"), "gloss"), lexicon).withColumnRenamed("score", "by_form")
    by_head = score_glosses(ids.select("id", F.col("head_en").alias("en"), "gloss"), lexicon).withColumnRenamed("score", "by_head")
    scored = rows.withColumn("id", F.struct("form", "place")).join(by_form, "id", "left").join(by_head, "id", "left")
    likely = F.coalesce(F.when(F.col("by_form") > 0, F.col("by_form")), "by_head", F.lit(0.0))
    if sources is None:
        scored = scored.withColumn("priority", F.lit(0))
    else:
        order = sources.select(F.col("id").alias("_source"), F.col("priority").alias("_priority"))
        scored = scored.join(order, F.col("c.source_id") == F.col("_source"), "left").withColumn("priority", F.coalesce("_priority", F.lit(NO_PRIORITY)))
    lists = scored.groupBy("form").agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", (-likely).alias("likely"), "place", "c"))), lambda x: x["c"]).alias("_ordered"))
    return known.join(lists, "form", "left").withColumn("candidates", F.coalesce("_ordered", "candidates")).drop("_ordered")


def gloss_sentences(sentences: DataFrame, entries: DataFrame, sources: DataFrame | None = None, keys: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """``(sentence_id, sentence, segments)`` of ``sentences`` = ``(sentence_id, sentence)``.

    Segments tile the sentence: PHRASE, WORD, UNKNOWN or PUNCT. A phrase whose glosses
    are all junk, or that has none, counts as no match. Function words that the dictionary
    has get their fixed translation first. Null sentences have no segments. With a
    ``lexicon`` the candidates of a word come in the order of their likelihood.

    Equal sentences of a chunk are glossed once.
    """
    kind = dict(sentences.dtypes)["sentence_id"]
    candidate = pa.struct([("headword", pa.string()), ("gloss", pa.string()), ("pos", pa.string()), ("score", pa.float64()), ("source_id", pa.int32())])
    segment = pa.list_(pa.struct([("source", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("candidates", pa.list_(candidate))]))

    def make(rows: pa.Table, known: Known) -> pa.Table:
        texts = rows["text"].to_pylist()
        place = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        # nested values are made from a few rows at a time, for as Python's they are large
        some = [pa.array([known.segments(t) for t in x], segment) for x in _slices(list(place), 500)]
        made = pa.chunked_array(some, segment).combine_chunks()
        return pa.table({"sentence_id": rows["id"], "sentence": rows["text"], "segments": made.take(pa.array([place[t] for t in texts], pa.int64()))})

    return with_dictionary(sentences, "sentence_id", "sentence", entries, sources, keys, lexicon, make=make, schema=f"sentence_id {kind}, sentence string, segments array<{SEGMENT}>", size=CHUNK_WHOLE)


def first_glosses(sentences: DataFrame, entries: DataFrame, sources: DataFrame | None = None, keys: DataFrame | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """``(sentence_id, segment_no, source, kind, gloss)``: the segments of ``gloss_sentences``, a row
    each, with the first gloss."""
    kind = dict(sentences.dtypes)["sentence_id"]

    def make(rows: pa.Table, known: Known) -> pa.Table:
        done: dict[str | None, list[tuple]] = {}
        source, number, kinds, glosses, of = [], [], [], [], []
        for i, t in enumerate(rows["text"].to_pylist()):
            if t not in done:
                done[t] = [(s["source"], s["kind"], s["candidates"][0]["gloss"] if s["candidates"] else None) for s in known.segments(t)]
            for j, (what, k, g) in enumerate(done[t]):
                of.append(i)
                number.append(j)
                source.append(what)
                kinds.append(k)
                glosses.append(g)
        ids = rows["id"].combine_chunks().take(pa.array(of, pa.int64()))
        return pa.table({"sentence_id": ids, "segment_no": pa.array(number, pa.int32()), "source": pa.array(source, pa.string()), "kind": pa.array(kinds, pa.string()), "gloss": pa.array(glosses, pa.string())})

    return with_dictionary(sentences, "sentence_id", "sentence", entries, sources, keys, lexicon, make=make, schema=f"sentence_id {kind}, segment_no int, source string, kind string, gloss string", most=1)


def _slices(xs: list, n: int) -> Iterator[list]:
    return (xs[i : i + n] for i in range(0, len(xs), n))


class Known:
    """What the dictionary has for the words of a chunk."""

    def __init__(self, table: pa.Table) -> None:
        self.norm: dict[str, str] = {}
        self.heads: dict[str, list[str]] = {}
        self.low: dict[str, str] = {}
        self.phrases: dict[str, list[dict] | None] = {}
        self.forms: dict[str, dict] = {}
        self.lemmas: dict[str, list[str]] = {}
        self.priors: dict[str, list[dict]] = {}
        for r in table.to_pylist():
            what, key = r["what"], r["key"]
            if what == "word":
                self.norm[key], self.low[key], self.heads[key] = r["norm"], r["low"], r["list"]
            elif what == "phrase":
                self.phrases[key] = r["candidates"]
            elif what == "form":
                self.forms[key] = {"via_lemma": r["via_lemma"], "candidates": r["candidates"]}
            else:
                self.lemmas[key], self.priors[key] = r["list"], r["prior"] or []

    def resolved(self, word: str) -> list[dict]:
        """The forms that stand for a word and its lemmas, by rank."""
        return [{"rank": i, **f} for i, x in enumerate(self.lemmas[word]) if (f := self.forms.get(x))]

    def segments(self, sentence: str | None) -> list[dict]:
        toks = tokenize(sentence)
        norms = [self.norm[t] for t, _, _, is_word in toks if is_word]
        spans = []
        for at, tries in _tries(norms, [self.heads[t] for t, _, _, is_word in toks if is_word]):
            n, key = next(((n, k) for n, k in tries if k in self.phrases), (0, ""))
            if n and self.phrases[key]:  # the longest one decides, junk or not
                spans.append({"at": at, "n": n, "candidates": self.phrases[key]})
        singles = [{"at": i, "candidates": f["candidates"]} for i, n in enumerate(norms) if (f := self.forms.get(n))]
        return scan(sentence, [dict(zip(("text", "start", "end", "is_word"), t, strict=True)) for t in toks], spans, singles)


def with_dictionary(
    texts: DataFrame, row_id: str, text: str, entries: DataFrame, sources: DataFrame | None, keys: DataFrame | None, lexicon: DataFrame | None = None, *,
    make: Callable[[pa.Table, Known], pa.Table], schema: str, cut: Cut = lambda t: [t] if t else [], lemmas: bool = False, priors: DataFrame | None = None, most: int | None = None, size: int = CHUNK,
) -> DataFrame:
    """What ``make`` gives for each chunk ``(id, text)`` of the texts, from what is known of its words.

    ``cut`` makes sentences of a text. With ``lemmas`` the forms of the lemmas of each word are
    known too, and what ``priors``, a lexicon, has of the word; ``most`` is how many candidates of a
    form are used.
    """
    placed, chunks = in_chunks(texts, row_id, text, size)
    # each of these is read several times below: computed once, kept in the shared folder
    keys = checkpointed(all_keys(entries)) if keys is None else keys
    spoken = checkpointed(_vocabulary(placed, cut))
    words = spoken.select("word").distinct().select("word", normalize_headword(F.col("word"), composed=True).alias("norm"), F.lower("word").alias("low"))
    tried = words.select("word", F.posexplode(F.concat(F.array("norm"), lemma_candidates(F.col("norm")))).alias("rank", "head")).join(phrase_starters(keys).withColumnRenamed("starter", "head"), "head", "left_semi")
    heads = tried.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "head"))), lambda x: x["head"]).alias("heads"))
    none = F.array().cast("array<string>")
    words = checkpointed(words.join(heads, "word", "left").withColumn("heads", F.coalesce("heads", none)))
    mine = spoken.join(words, "word")
    matches = _phrases_tried(placed, mine, cut, chunks)
    matches = checkpointed(matches.join(keys.filter(F.instr("key", " ") > 0).select("key").distinct(), "key", "left_semi"))
    # phrases: glosses of the idioms so named, else those of the entries of that headword
    named = keys.join(matches.select("key").distinct(), "key", "left_semi").select("key", "entry_id")
    idioms = entries.select("entry_id", "headword_norm", "source_id", "source_line", F.transform("idioms", lambda i: F.struct(i["phrase"].alias("phrase"), i["glosses"].alias("glosses"))).alias("idioms"))
    as_idiom = phrase_candidates(idioms, named).select("key", "rank", F.col("phrase").alias("headword"), "gloss", F.lit(None).cast("string").alias("pos"), "score", F.lit(-1).alias("source_id"))
    as_entry = ranked_candidates(named.join(_weighed(entries), "entry_id"), ["key"], sources).select("key", "rank", "headword", "gloss", "pos", "score", "source_id")
    as_entry = as_entry.join(as_idiom.select("key").distinct(), "key", "left_anti")
    glosses = checkpointed(as_idiom.unionByName(as_entry))
    proper = glosses.filter(~is_junk_gloss(F.col("gloss"))).select("key").distinct()
    phrases = _gathered(glosses.join(proper, "key", "left_semi"), "key", "candidates")

    forms = words.select(F.col("norm").alias("form"))
    asked = mine.select("chunk", F.col("norm").alias("form"))
    if lemmas:
        listed = words.select("low", F.concat(F.array("low"), lemma_candidates(F.col("low"))).alias("forms")).distinct()
        forms = forms.unionByName(listed.select(F.explode("forms").alias("form")))
        likely = F.lit(None).cast(PRIOR)
        if priors is not None:
            table = priors.groupBy(F.col("e").alias("low")).agg(F.collect_list(F.struct("f", (F.col("q") / F.lit(65535.0)).alias("p"))).alias("prior"))
        listed = listed.withColumn("prior", likely) if priors is None else listed.join(table, "low", "left")
        listed = mine.select("chunk", "low").distinct().join(listed, "low")
        asked = asked.unionByName(listed.select("chunk", F.explode("forms").alias("form")))
    known = candidates_by_form(forms.distinct(), entries, sources, keys)
    known = known if lexicon is None else likelihood_order(known, lexicon, sources)
    known = checkpointed(known if most is None else known.withColumn("candidates", F.slice("candidates", 1, most)))
    if most is not None:
        phrases = phrases.withColumn("candidates", F.slice("candidates", 1, most))

    def part(rows: DataFrame, what: str, key: str, **columns: str) -> DataFrame:
        kinds = {"norm": "string", "low": "string", "list": "array<string>", "via_lemma": "boolean", "candidates": CANDIDATES, "prior": PRIOR}
        return rows.select("chunk", F.lit(what).alias("what"), F.col(key).alias("key"), *[(F.col(columns[c]) if c in columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    parts = part(mine, "word", "word", norm="norm", low="low", list="heads")
    parts = parts.unionByName(part(matches.join(phrases, "key", "left"), "phrase", "key", candidates="candidates"))
    parts = parts.unionByName(part(asked.distinct().join(known, "form"), "form", "form", via_lemma="via_lemma", candidates="candidates"))
    if lemmas:
        parts = parts.unionByName(part(listed, "lemmas", "low", list="forms", prior="prior"))

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        return make(rows, Known(found))

    both = [x.repartition(chunks, "chunk").groupBy("chunk") for x in (placed, parts)]
    return both[0].cogroup(both[1]).applyInArrow(run, schema)


def scan(sentence: str | None, toks: list[dict], phrases: list[dict], singles: list[dict]) -> list[dict]:
    """The greedy scan of one sentence from left to right."""
    by_start = {p["at"]: p for p in phrases or ()}
    by_word = {s["at"]: s for s in singles or ()}
    places = [i for i, t in enumerate(toks or ()) if t["is_word"]]
    out, i, word = [], 0, 0
    while i < len(toks or ()):
        t = toks[i]
        if not t["is_word"]:
            out.append({"source": t["text"], "start": t["start"], "end": t["end"], "kind": "PUNCT", "candidates": []})
            i += 1
            continue
        if word in by_start:
            p = by_start[word]
            last = places[word + p["n"] - 1]
            end = toks[last]["end"]
            out.append({"source": sentence[t["start"] : end], "start": t["start"], "end": end, "kind": "PHRASE", "candidates": p["candidates"]})
            i, word = last + 1, word + p["n"]
            continue
        s = by_word.get(word)
        found = list(s["candidates"]) if s else []
        if s and (fixed := FUNCTION_WORDS.get(t["text"].lower())):
            vi = fixed[0] or f"({t['text'].lower()} — tiếng Việt không cần dịch)"
            found.insert(0, {"headword": t["text"], "gloss": vi, "pos": FUNCTION_POS, "score": 2.0, "source_id": -1})
        out.append({"source": t["text"], "start": t["start"], "end": t["end"], "kind": "WORD" if s else "UNKNOWN", "candidates": found})
        i, word = i + 1, word + 1
    return out


def flatten(segments: list[dict]) -> str:
    """The default glosses as one line."""
    return "".join(s["candidates"][0]["gloss"] if s["kind"] != "PUNCT" and s["candidates"] else s["source"] for s in segments)

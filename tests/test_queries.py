import random
import re
from collections import Counter, defaultdict
from math import log, sqrt

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import dictionary, lexicon, search
from lexiloom.plans import queries

ENGLISH = {"house": "nhà", "book": "sách", "cat": "mèo", "dog": "chó", "tree": "cây", "red": "đỏ"}


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables by name and gives their folder."""

    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


def brute_table(pairs, iterations):
    """IBM Model 1 over all lines."""
    lines = [(["", *re.findall(r"[\w']+", en.lower())], re.findall(r"\w+", vi.lower())) for en, vi in pairs]
    t = defaultdict(lambda: 1.0)
    for _ in range(iterations):
        c = Counter()
        for en, vi in lines:
            for f in vi:
                z = sum(t[e, f] for e in en)
                for e in en:
                    c[e, f] += t[e, f] / z
        total = Counter()
        for (e, _f), x in c.items():
            total[e] += x
        t = {(e, f): x / total[e] for (e, f), x in c.items()}
    return t


def brute_translations(pairs, iterations):
    """The best 16 of each word of at least 0.005."""
    out = defaultdict(dict)
    for p, f, e in sorted((-round(p, 6), f, e) for (e, f), p in brute_table(pairs, iterations).items()):
        if e and -p >= 0.005 and len(out[e]) < 16:
            out[e][f] = round(-p * 65535) / 65535
    return out


def brute_score(en, gloss, translations):
    best = None
    for alt in filter(str.strip, re.split("[,;]", re.sub(r"\([^)]*\)", " ", gloss))):
        tokens = re.findall(r"\w+", alt.lower())
        met = [translations[en.lower()][f] for f in tokens if f in translations[en.lower()]]
        if met:
            best = max(best or 0, sum(met) / sqrt(len(tokens)))
    return best


def test_whole_table_keeps_unlikely_cells(spark, folder):
    rng = random.Random(9)
    pairs = [(" ".join(rng.choices("abcdefgh", k=3)), " ".join(rng.choices([f"v{i}" for i in range(150)], k=rng.randint(1, 20)))) for _ in range(40)]
    at = folder(parallel_pairs=spark.createDataFrame([(i, *p) for i, p in enumerate(pairs, 1)], "line_no long, en string, vi string"))
    got, wanted = {(r["e"], r["f"]): r["t"] for r in queries.em_model1_whole(spark, at).collect()}, brute_table(pairs, 4)
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 2e-6 for k in wanted)
    assert min(got.values()) < 0.01


@pytest.mark.parametrize("batch", [1 << 20, 30])
def test_training_takes_lines_of_any_length(spark, folder, monkeypatch, batch):
    monkeypatch.setattr(lexicon, "BATCH", batch)
    monkeypatch.setattr(lexicon, "FREQUENT", 5)
    monkeypatch.setattr(lexicon, "CHUNK_BYTES", 400)
    rng = random.Random(13)
    long = lambda letter, n: " ".join(f"{letter}{rng.randint(0, rng.choice([3, 60]))}" for _ in range(n))
    pairs = [(long("e", rng.choice([2, 30])), long("v", rng.choice([1, 45]))) for _ in range(40)] + [("stock line", "câu mẫu mẫu")] * 9
    at = folder(parallel_pairs=spark.createDataFrame([(i, *p) for i, p in enumerate(pairs, 1)], "line_no long, en string, vi string"))
    wanted = brute_table(pairs, 4)
    for rows, least in ((queries.em_model1_whole, 0), (queries.em_model1, 0.005)):
        got, some = {(r["e"], r["f"]): r["t"] for r in rows(spark, at).collect()}, {k: t for k, t in wanted.items() if round(t, 6) >= least}
        assert got.keys() == some.keys() and all(abs(got[k] - some[k]) < 2e-6 for k in some)
    top = {r["e"]: [x.split("(")[0] for x in r["translations"].split()] for r in queries.lexicon_topk(spark, at).collect()}
    assert top == {e: list(fs) for e, fs in brute_translations(pairs, 4).items()}


def test_scored_glosses_against_brute_force(spark, folder, entries_of):
    rng = random.Random(7)
    pairs = []
    for _ in range(60):
        words = rng.choices(list(ENGLISH), k=rng.randint(1, 3))
        pairs.append((" ".join(["the", *words]), " ".join([*(ENGLISH[w] for w in words), "là", "của"])))
    rows = [(w, [("danh từ", [f"{f}, là", "của (là) các; là của nó", None, f"{ENGLISH['cat']} {f}"]), ("động từ", ["xyz"])]) for w, f in ENGLISH.items()]
    at = folder(parallel_pairs=spark.createDataFrame([(i, *p) for i, p in enumerate(pairs, 1)], "line_no long, en string, vi string"), entries=entries_of(*rows))
    got = {(r["entry_id"], r["sense_no"], r["gloss_no"]): r["score"] for r in queries.lexicon_score_gloss(spark, at).collect()}
    table = brute_translations(pairs, 4)
    wanted = {(i, s, g): x for i, (w, senses) in enumerate(rows, 1) for s, (_, glosses) in enumerate(senses) for g, text in enumerate(glosses) if text and (x := brute_score(w, text, table)) is not None}
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-4 for k in wanted)


def test_glosses_meet_their_words_translations_as_rows(spark):
    """A gloss is a row, also of many tokens and synonyms: its tokens aren't."""
    table = spark.createDataFrame([("cat", "mèo", 1, 65535), ("cat", "con", 2, 13107), ("dog", "chó", 1, 65535)], "e string, f string, rank int, q int")
    glosses = spark.createDataFrame([(1, "Cat", "con mèo, con con"), (2, "cat", "chó"), (3, "dog", "(x) , ,chó chó"), (4, None, "mèo"), (5, "cat", None), (6, "emu", "mèo")], "id int, en string, gloss string")
    scored = lexicon.score_glosses(glosses, table)
    assert {r["id"]: r["score"] for r in scored.collect()} == {1: round(1.2 / sqrt(2), 6), 3: round(2 / sqrt(2), 6)}
    assert "Generate" not in scored._jdf.queryExecution().toString()


def test_probabilities_read_entries_once(spark, folder, entries_of):
    pairs = spark.createDataFrame([(1, "cat", "mèo"), (2, "cat", "mèo"), (3, "dog", "chó")], "line_no long, en string, vi string")
    at = folder(parallel_pairs=pairs, entries=entries_of(("cat", [("n", ["mèo con", None])]), ("dog", [("n", ["mèo"]), ("v", None)]), ("emu", None)))
    found = queries.lexicon_probability(spark, at)
    assert {(r["en"], r["vi"], r["p"] > 0.9) for r in found.collect()} == {("cat", "mèo", True), ("cat", "con", False), ("dog", "mèo", False)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("headword_norm") and found.inputFiles() and found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2


def brute_bm25(docs, asked, b=0.2):
    """{(query, doc): score} of all that share a term."""
    n, average = len(docs), max(1.0, sum(map(len, docs.values())) / len(docs))
    df = Counter(t for d in docs.values() for t in {*d})
    idf = {t: log(1 + (n - x + 0.5) / (x + 0.5)) for t, x in df.items()}
    return {(q, i): sum(idf[t] * d.count(t) * 2.2 / (d.count(t) + 1.2 * (1 - b + b * len(d) / average)) for t in {*terms} if t in d) for q, terms in asked.items() for i, d in docs.items() if {*terms} & {*d}}


@pytest.mark.parametrize("few", [0, 2, 1000])
def test_relevance_by_any_number_of_terms(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW_TERMS", few)
    rng = random.Random(few)
    docs = {i: rng.choices("abcdefgh", k=rng.randint(0, 12)) for i in range(60)}
    asked = {i: rng.choices("abcdefghxyz", k=rng.randint(1, 5)) for i in range(20)}
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in search.bm25_scores(spark.createDataFrame(list(docs.items()), "doc_id int, tokens array<string>"), spark.createDataFrame(list(asked.items()), "query_id int, tokens array<string>")).collect()}
    wanted = brute_bm25(docs, asked)
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-9 for k in wanted)


def brute_nearest(texts, asked, k, least):
    """{(query, text, score, rank)} by the letter triples of each pair."""
    grams = lambda t: Counter(f"$${t}$$"[i : i + 3] for i in range(len(t) + 2)) if t else Counter()
    out = set()
    for q, text in asked.items():
        scored = []
        for t, i in texts.items():
            a, b = grams(text), grams(t)
            m = (a & b).total()
            if m and (s := m / (a.total() + b.total() - m)) >= least:
                scored.append((-round(s, 6), i, t))
        out |= {(q, t, -s, r) for r, (s, _, t) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("once", [3, 50_000])
def test_nearest_texts_in_blocks_and_passes(spark, entries_of, monkeypatch, once):
    monkeypatch.setattr(search, "ASKED_ONCE", once)
    monkeypatch.setattr(search, "BLOCK", 7)
    rng = random.Random(once)
    heads = list(dict.fromkeys("".join(rng.choices("ab ô😀", k=rng.randint(1, 9))).strip() or "a" for _ in range(150)))
    asked = {i: rng.choice([*heads, "aaaa", "b" * 9, "", "zz", "abab😀ab"]) for i in range(25)}
    table = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    entries = entries_of(*((h, None) for h in heads))
    plans = search.fuzzy_english(entries, table, 10)
    got = {(r["query_id"], r["headword_norm"], r["score"], r["rank"]) for r in plans.collect()}
    assert got == brute_nearest({h: i for i, h in enumerate(heads)}, asked, 10, 0) != set()
    # no row a pair: neither side's triples are joined
    assert "Join" not in plans._jdf.queryExecution().toString()

    words = spark.createDataFrame([(f"{a} {b}",) for a in ("trông", "chăm", "nom", "tặng") for b in ("nom", "sóc", "quà")], "compound string")
    close = {1: "trong nomm", 2: "cham soc", 3: "tang", 4: "tangg qua", 5: "nom nomx"}
    rows = {(r["query_id"], r["compound"], r["rank"]) for r in search.suggest(words, spark.createDataFrame(list(close.items()), "query_id int, query string"), 3).collect()}
    assert {q for q, _, _ in rows} == {1, 4, 5} and (1, "trông nom", 1) in rows and (4, "tặng quà", 1) in rows and (5, "nom nom", 1) in rows


def test_every_hundredth_row_asks(spark, folder, entries_of):
    rng = random.Random(11)
    words, syllables = ["set", "bank", "give up", "banks", None, "gift"], ["trông", "nom", "chăm", "sóc", "cho", "tặng"]
    compounds = ["trông nom", "chăm sóc", "cho tặng", "chăm soc"]
    texts = {i * 50: None if i % 9 == 0 else " ".join(rng.choices(["set", "bank", "give", "up", "gift", "a"], k=rng.randint(0, 8))) for i in range(1, 25)}
    heads = {i: rng.choice(words) for i in texts}
    rows = [(rng.choice(words[:4]), rng.choice([None, [("n", None)], [("n", [None, rng.choice([*compounds, "trông nomm" + rng.choice("abcdefgh")])]), ("v", [rng.choice(syllables)])]])) for _ in range(40)]
    entries = entries_of(*rows).withColumn("entry_id", F.col("entry_id") * 50)
    at = folder(entries=entries, documents=spark.createDataFrame([(i, t, heads[i]) for i, t in texts.items()], "doc_id long, text string, headword string"))

    scores = brute_bm25({i: (t or "").split() for i, t in texts.items()}, {i: heads[i].split() for i in texts if i % 100 == 0 and heads[i]})
    wanted = set()
    for q in {q for q, _ in scores}:
        wanted |= {(q, d, s, k) for k, (s, d) in enumerate(sorted(((round(s, 6), d) for (p, d), s in scores.items() if p == q), key=lambda x: (-x[0], x[1]))[:10], 1)}
    found = {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in queries.bm25_search_rows(spark, at).collect()}
    assert {(q, d, k) for q, d, _, k in found} == {(q, d, k) for q, d, _, k in wanted} and found
    assert queries.bm25_accent_free_search_rows(spark, at).count() == len(wanted)

    ids = {i * 50: h for i, (h, _) in enumerate(rows, 1)}
    same = {(a, b) for a, x in ids.items() if a % 100 == 0 for b, y in ids.items() if x == y}
    assert {(r["query_id"], r["entry_id"]) for r in queries.homograph_lookup_rows(spark, at).collect()} == same
    assert {(r["query_id"], r["entry_id"]) for r in queries.exact_lookup_rows(spark, at).collect()} == {(a, min(b for c, b in same if c == a)) for a, _ in same}
    asked = {a: h for a, h in ids.items() if a % 100 == 0}
    gloss = {i * 50: next((g for _, gs in s or () for g in gs or () if g), None) for i, (_, s) in enumerate(rows, 1) if i % 2 == 0}
    gloss = {i: g for i, g in gloss.items() if g}
    table = lambda d: spark.createDataFrame(list(d.items()), "query_id long, query string")
    rowset = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    # each row alone gives what all together give
    for one, whole in (
        (lambda q: search.fuzzy_english(entries, q, 10), queries.fuzzy_match_jaccard_rows),
        (lambda q: search.suggest(search.compounds(entries, 3), q, 5), queries.did_you_mean_rows),
        (lambda q: search.search_vietnamese(entries, q, 10), queries.reverse_search),
    ):
        assert rowset(whole(spark, at)) == rowset(one(table(asked if whole is queries.fuzzy_match_jaccard_rows else gloss))) != []
    assert len(gloss) > 5


def test_long_catalogues_are_used_whole(spark):
    n = 10_050
    sources = spark.createDataFrame([(i, int(i < n - 1), i) for i in range(n)], "id int, enabled int, priority int").coalesce(1)
    rows = spark.createDataFrame([(i,) for i in (0, n - 2, n - 1, n)], "source_id int")
    got = {r["source_id"]: r["source_priority"] for r in dictionary.apply_sources(rows, sources).collect()}
    assert got == {0: 0, n - 2: n - 2, n: dictionary.NO_PRIORITY}
    moved = {r["id"]: r["priority"] for r in dictionary.reorder_sources(sources, n - 1, -1).collect()}
    assert len(moved) == n and moved[n - 1] == n - 2 and moved[n - 2] == n - 1

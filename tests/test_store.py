import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import lexicon, ordered, search
from lexiloom.sources import files, store

N = "danh từ"


@pytest.fixture(scope="module")
def words(entries_of):
    return entries_of(("lamp", [(N, ["đèn bàn, đèn"])], [("to lamp up", ["thắp đèn lồng"])]), ("lantern", [(N, ["đèn lồng", "lồng đèn, đèn"])]), ("cage", [(N, ["lồng chim"])]), ("cage", None), ("oil", []))


@pytest.fixture(scope="module")
def parts(spark, words, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store"))
    sources = spark.createDataFrame([(0, "A", 5, 1, 0), (1, "B", None, 0, 1)], "id int, name string, entries int, enabled int, priority int")
    store.write_store(words, folder, 3, sources)
    assert store.locate(spark, [folder + "/none", folder]) == folder and store.locate(spark, []) is None
    return store.read_store(spark, folder)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_stored_searches_give_what_scans_give(spark, words, parts, monkeypatch):
    key = lambda df: sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in df.collect())
    accented, plain = ask(spark, "đèn lồng", "lồng chim", "không có"), ask(spark, "den long", "chim")
    for few in (store.FEW_TERMS, 1):
        monkeypatch.setattr(store, "FEW_TERMS", few)
        assert key(store.search(parts, accented)) == key(search.search_vietnamese(words, accented)) != []
        assert key(store.search(parts, plain)) == key(search.search_vietnamese(words, plain, fold=True)) != []
    shown = {(r["query_id"], r["doc_id"]): (r["display"], r["matched_gloss"]) for r in store.search(parts, accented).collect()}
    assert shown[0, 1] == ("to lamp up", "thắp đèn lồng") and shown[0, 2] == ("lantern", "đèn lồng")
    assert key(store.fuzzy(parts, ask(spark, "lampe", "cagge"))) == key(search.fuzzy_english(words, ask(spark, "lampe", "cagge"))) != []
    assert store.search(parts, ask(spark, "x").limit(0)).count() == 0 and store.did_you_mean(parts, ask(spark, "den lonk")).count() == 0


def test_terms_are_pushed_to_the_scan(spark, parts):
    hits = store._hits(parts, "vi", search.route(ask(spark, "đèn lồng")))
    assert "PushedFilters: [In(term" in hits._jdf.queryExecution().toString().replace("IsNotNull(term), ", "")


def test_a_good_store_verifies(parts):
    assert [r["check"] for r in store.verify(parts).collect() if not r["ok"]] == []
    broken = parts | {"entries": parts["entries"].filter("headword <> 'lamp'")}
    assert any(not r["ok"] for r in store.verify(broken).collect())


def test_missing_lexicon_is_empty(spark, parts, tmp_path):
    assert parts["lexicon"].count() == 0
    store.write_lexicon(spark.createDataFrame([("a", "b", 1, 9), ("a", "c", 2, 0)], "e string, f string, rank int, q int"), str(tmp_path))
    table = store.read_lexicon(spark, str(tmp_path))
    asked = spark.createDataFrame([("A", "b"), ("a", "c"), ("z", "b")], "en string, vi string")
    assert {(r["en"], r["vi"]): r["p"] > 0 for r in lexicon.probabilities(asked, table).collect()} == {("A", "b"): True, ("a", "c"): False, ("z", "b"): False}


def test_build_from_files(spark, tmp_path):
    (tmp_path / "base.txt").write_text("@lamp /l/\n*danh từ\n- đèn bàn\n", encoding="utf-8")
    (tmp_path / "more.tsv").write_text("# name: More\nlamp\tbóng đèn\noil\tdầu\n", encoding="utf-8")
    sources = store.build(spark, [str(tmp_path / "base.txt"), str(tmp_path / "gone.tsv"), str(tmp_path / "more.tsv")], str(tmp_path / "out"), 2)
    assert [(r["id"], r["name"], r["format"], r["entries"], r["priority"]) for r in sources.collect()] == [(0, "base", "marker", 1, 1), (2, "More", "tsv", 2, 1)]
    made = store.read_store(spark, str(tmp_path / "out"))
    assert [r["check"] for r in store.verify(made).collect() if not r["ok"]] == []
    assert {r["headword"] for r in store.search(made, ask(spark, "đèn")).collect()} == {"lamp"}
    (tmp_path / "odd.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        store.build(spark, [str(tmp_path / "odd.csv")], str(tmp_path / "no"))
    assert files.catalog_or_default(spark, str(tmp_path / "none.tsv"), "Base", 7).first()["entries"] == 7


def test_running_values_over_blocks(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, None, None, "a", "b"])) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, v string").repartition(6)
    blocks = ordered.in_blocks(df, ["i"])
    assert blocks.select(ordered.BLOCK).distinct().count() > 1
    last, wanted = None, []
    for i, v in rows:
        last = v or last
        wanted.append((i, last))
    assert [(r["i"], r["x"]) for r in ordered.latest(blocks, ["i"], F.col("v"), "x").orderBy("i").collect()] == wanted
    assert [r["x"] for r in ordered.previous(blocks, ["i"], F.col("i"), "x").orderBy("i").collect()] == [None, *range(299)]
    assert [r["n"] for r in ordered.numbered(df, ["i"], "n").orderBy("i").collect()] == list(range(300))
    assert ordered.numbered(df.limit(0), ["i"], "n").count() == 0


def test_vocabulary_of_training(spark, entries_of):
    e = entries_of(("red lamp", [(N, ["đèn đỏ"])]))
    assert [(r["word"], r["id"]) for r in lexicon.vocabulary_ids(lexicon.english_vocabulary(e)).orderBy("id").collect()] == [("lamp", 1), ("red", 2)]
    pairs = spark.createDataFrame([(1, "a red lamp", "đèn đỏ to"), (2, "a lamp", "đèn to")], "line_no long, en string, vi string")
    t = {(r["e"], r["f"]): r["t"] for r in lexicon.train(pairs, 2, english=lexicon.english_vocabulary(e), vietnamese=lexicon.vietnamese_vocabulary(e)).collect()}
    assert {x for x, _ in t} == {"", "lamp", "red"} and {y for _, y in t} == {"đèn", "đỏ"} and t["red", "đỏ"] > t["lamp", "đỏ"]


def test_compounds_are_expanded(spark):
    docs = spark.createDataFrame([(1, ["đèn", "lồng", "đỏ"]), (2, ["x"]), (3, [])], "doc_id int, tokens array<string>")
    known = spark.createDataFrame([("đèn lồng",), ("đèn lồng đỏ",)], "compound string")
    assert sorted((r["doc_id"], r["pos"], r["term"]) for r in search.expand_compounds(docs, known).collect()) == [(1, 0, "đèn"), (1, 0, "đèn_lồng"), (1, 0, "đèn_lồng_đỏ"), (1, 1, "lồng"), (1, 2, "đỏ"), (2, 0, "x")]
    assert search.longest_postings(search.postings(docs)) == 1


def test_many_asked_terms_make_no_hits_as_rows(spark, entries_of, monkeypatch):
    """Each query meets each document: what leaves a task is its best ones only, with the same rows."""
    r = random.Random(7)
    some = lambda: " ".join(r.choice(("đèn", "lồng", "bến", "cảng", "nặng", "lanternlike", "den")) for _ in range(r.randint(1, 4)))
    many = entries_of(*((r.choice(("lamp", "long lamp", "lanternlike", "")), [("danh từ", [some() + r.choice((", ", "")) + some(), some()])]) for _ in range(300)))
    asked = spark.createDataFrame([(i, some()) for i in range(40)] + [(40, None), (41, "?!"), (42, "ồng bế"), (43, "đèn lồng, bến")], "query_id int, query string")
    for fold in (False, True):
        docs, q = search.gloss_documents(many, fold), asked.withColumn("q", F.lower(search.remove_diacritics(F.col("query")) if fold else F.col("query")))
        terms = q.select("query_id", "q", search.split_tokens(F.col("q")).alias("tokens"))
        wanted = search.rank_hits(search.bm25_scores(docs, terms.select("query_id", "tokens")), many, terms, 5, fold)
        made = []
        real = search.top_per_query
        monkeypatch.setattr(search, "top_per_query", lambda s, k, **kw: made.append(s) or real(s, k, **kw))  # noqa: B023
        got = search.search_vietnamese(many, asked, 5, fold)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
        assert made[-1].count() < 2_000  # 12,000 pairs may meet; a task gives few
        monkeypatch.undo()
    assert search.search_vietnamese(many, asked.limit(0), 5).count() == 0

import pytest

from lexiloom.operators import dictionary, search, service

V, N = "động từ", "danh từ"
MINI = (
    ("fold", [(V, ["gấp, xếp, gập", "xếp gọn"])], [("to fold up", ["gấp gọn, xếp lại", "phá sản"]), ("to fold in", ["trộn nhẹ"])]),
    ("keep", [(V, ["giữ, cất"])], [("to keep watch", ["canh gác, trông chừng"])]),
    ("swim", [(V, ["bơi"])]),
    ("sing", [(V, ["hát, ca hát"])]),
    ("sang", []),
    ("spring", [(N, ["mùa xuân, tiết xuân"])]),
    ("spring", [(N, ["lò xo"])]),
    ("en plein air", [("phó từ", ["ngoài trời"])]),
)


@pytest.fixture(scope="module")
def mini(entries_of):
    return entries_of(*MINI)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_alias_lookup(spark, mini):
    got = {r["query_id"]: r["entry_id"] for r in dictionary.lookup_first(ask(spark, "fold up", "to fold up", "keep watch", "en_plein_air", "watch to"), mini).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 8}


def test_homographs_keep_their_order(spark, mini):
    assert [r["entry_id"] for r in dictionary.lookup_all(ask(spark, "SPRING"), mini).orderBy("entry_id").collect()] == [6, 7]
    assert dictionary.lookup_first(ask(spark, "spring"), mini).first()["entry_id"] == 6


def test_prefix_and_starters(spark, mini):
    keys = dictionary.all_keys(mini)
    assert [r["key"] for r in dictionary.prefix_scan(keys, "Fo", 10).collect()] == ["fold", "fold in", "fold up"]
    assert dictionary.prefix_scan(keys, "", 10).count() == 0
    starters = {r["starter"] for r in dictionary.phrase_starters(keys).collect()}
    assert {"fold", "keep", "to", "en"} <= starters and "swim" not in starters


def test_resolve_falls_back_to_lemma_then_to_itself(spark, mini):
    got = {r["query_id"]: (r["form"], r["via_lemma"]) for r in dictionary.resolve(ask(spark, "swimming", "sang", "spring", "nothing"), mini).collect()}
    assert got == {0: ("swim", True), 1: ("sing", True), 2: ("spring", False)}


def test_sources_all_disabled_pass_all(spark, mini):
    def cat(on):
        return spark.createDataFrame([(0, "a", "tsv", "f", 1, on, 0)], "id int, name string, format string, file string, entries int, enabled int, priority int")

    assert dictionary.apply_sources(mini, cat(0)).count() == 8
    assert dictionary.apply_sources(mini, cat(1)).count() == 8


def test_source_reorder(spark):
    cat = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "id int, priority int")
    order = lambda df: [r["id"] for r in df.orderBy("priority").collect()]
    assert order(dictionary.reorder_sources(cat, 1, -1)) == [1, 0, 2]
    assert order(dictionary.reorder_sources(cat, 0, -1)) == [0, 1, 2]


def test_reverse_and_fuzzy(spark, mini):
    q = ask(spark, "canh gác")
    assert search.search_vietnamese(mini, q).first()["headword"] == "keep"
    assert search.search_vietnamese(mini, ask(spark, "canh gac"), fold=True).first()["headword"] == "keep"
    assert search.fuzzy_english(mini, ask(spark, "sprinng")).orderBy("rank").first()["headword_norm"] == "spring"


def test_compounds_and_suggestions(spark, entries_of):
    e = entries_of(("guard", [(V, ["trông nom, canh gác"])]), ("mind", [(V, ["canh gác, để ý"])]), ("watch", [(V, ["canh gác ban đêm", "canh gác"])]), ("blah", [(N, ["linh tinh quá"])]))
    words = search.compounds(e, 3)
    assert {r["compound"] for r in words.collect()} == {"canh gác"}
    got = {r["query_id"]: r["compound"] for r in search.suggest(words, ask(spark, "canh gax", "canh gác", "canh gac", "gác")).collect()}
    assert got == {0: "canh gác"}


def test_shown_hits(spark, mini):
    asked = search.route(ask(spark, "canh gác", "xep gon"))
    assert {r["query_id"]: r["fold"] for r in asked.collect()} == {0: False, 1: True}
    best = search.search_vietnamese(mini, ask(spark, "canh gác"))
    shown = search.show_hits(best, mini, asked, fold=False).first()
    assert (shown["display"], shown["matched_gloss"]) == ("to keep watch", "canh gác, trông chừng")
    off = spark.createDataFrame([(0, 0, 0), (1, 1, 1)], "id int, enabled int, priority int")
    assert search.search_vietnamese(mini, ask(spark, "canh gác"), sources=off).count() == 0


def test_numbers_and_focus(spark, mini):
    numbered = dictionary.with_ordinals(mini.repartition(5))
    assert [r["headword"] for r in numbered.orderBy("ordinal").collect()] == ["en plein air", "fold", "keep", "sang", "sing", "spring", "spring", "swim"]
    assert sorted(r["ordinal"] for r in numbered.collect()) == list(range(8))
    assert [r["headword"] for r in dictionary.entries_at(spark.createDataFrame([(1,), (99,)], "ordinal long"), numbered).collect()] == ["fold"]
    assert {(r["query_id"], r["phrase"]) for r in dictionary.idiom_focus(ask(spark, "fold up", "to fold in", "fold"), mini).collect()} == {(0, "to fold up"), (1, "to fold in")}
    assert [r["entry_id"] for r in dictionary.dump(mini, " Spring ").orderBy("entry_id").collect()] == [6, 7]
    sources = spark.createDataFrame([(0, 9, 1), (3, None, 1)], "id int, entries int, enabled int")
    assert {(r["source_id"], r["declared"], r["found"]) for r in dictionary.source_totals(mini, sources).collect()} == {(0, 9, 8), (3, None, 0)}
    assert {r["id"]: r["enabled"] for r in dictionary.set_enabled(sources, 3, False).collect()} == {0: 1, 3: 0}


def test_cascade_stops_at_the_first_answer(spark, mini):
    off = spark.createDataFrame([(0, 1, 0)], "id int, enabled int, priority int")
    asked = ask(spark, "Spring", "swimming", "keep the old spring", "sprng", None)
    got = {(r["query_id"], r["stage"]) for r in service.word_cascade(asked, mini, off).collect()}
    assert got == {(0, "lookup"), (1, "resolve"), (2, "translate"), (3, "fuzzy")}


def test_empty_tables(spark, entries_of, mini):
    none = mini.limit(0)
    assert dictionary.all_keys(none).count() == 0
    assert dictionary.dictionary_stats(none).first()["entries"] == 0
    assert search.search_vietnamese(none, ask(spark, "x")).count() == 0

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import gloss, service, translate

V, N, A, P = "động từ", "danh từ", "tính từ", "phó từ"
WORDS = (
    ("swim", [(V, ["bơi, bơi lội"])]),
    ("harbour", [(N, ["bến cảng"])]),
    ("lantern", [(N, ["đèn lồng"])]),
    ("heavy", [(A, ["nặng"])]),
    ("water", [(N, ["nước"]), (V, ["tưới"])]),
    ("soft", [(A, ["mềm"])]),
    ("seat", [(N, ["chỗ, chỗ ngồi"])]),
    ("keep", [(V, ["giữ, cất"])], [("to keep off", ["tránh, tránh xa", "chặn lại"])]),
    ("paint", [(N, ["màu vẽ"]), (V, ["sơn phết"])]),
    ("drawing", [(N, ["bức vẽ"])]),
    ("draw", [(V, ["vẽ"])]),
    ("rope ladder", [(N, ["thang dây"])]),
)


@pytest.fixture(scope="module")
def words(entries_of):
    return entries_of(*WORDS)


SENTENCES = {
    "The heavy lantern": "Đèn lồng nặng",
    "This harbour": "Bến cảng này",
    "The heavy lantern. This harbour.": "Đèn lồng nặng. Bến cảng này.",
    "She swam to the harbour": None,
    "Water the harbour": "Tưới bến cảng",
    "Draw, paint, and water": "Vẽ, sơn phết, và tưới",
    "The four lanterns": "Bốn đèn lồng",
    "The softer lantern": "Đèn lồng mềm hơn",
    "A soft rope ladder": "Thang dây mềm",
    "He is drawing a lantern": "Anh ấy đang vẽ đèn lồng",
    "The lantern could not paint": None,
    "He kept off his seat": None,
    "": "",
}


def test_golden_sentences(spark, words):
    texts = spark.createDataFrame([*enumerate(SENTENCES), (99, None)], "text_id int, text string")
    got = {r["text_id"]: r["translation"] for r in translate.translate_texts(texts, words).collect()}
    for i, (source, wanted) in enumerate(SENTENCES.items()):
        if wanted is not None:
            assert got[i] == wanted, source
    by = dict(zip(SENTENCES, (got[i] for i in range(len(SENTENCES))), strict=True))
    assert by["She swam to the harbour"].startswith("Cô ấy đã bơi") and by["She swam to the harbour"].endswith("bến cảng")
    assert by["The lantern could not paint"].startswith("Đèn lồng không thể") and by["The lantern could not paint"].endswith("sơn phết")
    assert by["He kept off his seat"].startswith("Anh ấy đã tránh") and "của anh ấy" in by["He kept off his seat"]
    assert got[99] == ""


def test_segments_tile_the_sentence(spark, words):
    rows = spark.createDataFrame([(1, "He kept off his seat."), (2, "She swam home"), (3, None), (4, "She swam home"), (5, "")], "sentence_id int, sentence string")
    made = gloss.gloss_sentences(rows, words)
    got = {r["sentence_id"]: r["segments"] for r in made.collect()}
    assert "".join(s["source"] for s in got[1]) == "He kept off his seat."
    phrase = next(s for s in got[1] if s["kind"] == "PHRASE")
    assert phrase["source"] == "kept off" and phrase["candidates"][0]["gloss"] == "tránh, tránh xa"
    swam = next(s for s in got[2] if s["source"] == "swam")
    assert swam["kind"] == "WORD" and swam["candidates"][0]["headword"] == "swim"
    assert got[3] == [] and got[5] == [] and got[4] == got[2]
    assert {r["sentence_id"]: r["ratio"] for r in service.resolved_ratio(made).collect()}[2] == 1 / 3
    assert {r["sentence_id"]: r["gloss"] for r in service.flat_gloss(made).collect()}[2] == "She bơi, bơi lội home"


def test_stock_sentences_meet_their_copies(spark, words, monkeypatch):
    monkeypatch.setattr(gloss, "HOT_SENTENCE", 2)
    monkeypatch.setattr(translate, "HOT_SENTENCE", 2)
    rows = spark.createDataFrame([(i, "The heavy lantern") for i in range(9)] + [(9, "Water the harbour")], "text_id int, text string")
    got = {r["text_id"]: r["translation"] for r in translate.translate_texts(rows, words).collect()}
    assert got == {**dict.fromkeys(range(9), "Đèn lồng nặng"), 9: "Tưới bến cảng"}


def test_likelihood_orders_candidates(spark, entries_of):
    e = entries_of(("harbour", [(N, ["chỗ trú", "hải cảng"]), (N, ["bến tàu"])]))
    rows = spark.createDataFrame([(1, "harbour")], "sentence_id int, sentence string")
    table = spark.createDataFrame([("harbour", "bến", 1, 30000), ("harbour", "tàu", 2, 20000), ("harbour", "cảng", 3, 9000)], "e string, f string, rank int, q int")
    order = lambda lex: [c["gloss"] for c in gloss.gloss_sentences(rows, e, lexicon=lex).first()["segments"][0]["candidates"]]
    assert order(None) == ["chỗ trú", "bến tàu", "hải cảng"] and order(table) == ["bến tàu", "hải cảng", "chỗ trú"]
    assert order(table.limit(0)) == order(None)


def test_prior_changes_the_sense(spark):
    segments = [{"source": "harbour", "kind": "WORD", "candidates": [{"headword": "harbour", "gloss": "chỗ trú", "pos": N, "score": 1.0, "source_id": 0}, {"headword": "harbour", "gloss": "bến tàu", "pos": N, "score": 0.5, "source_id": 0}]}]
    assert translate.translate(segments, {}) == "Chỗ trú"
    assert translate.translate(segments, {}, {"harbour": {"bến": 0.41, "tàu": 0.39, "chỗ": 0.02}}) == "Bến tàu"


def _kept(monkeypatch, run):
    """Characters of what is kept in the shared folder while ``run`` runs, and its rows."""
    frames = []
    real = gloss.checkpointed

    def keep(df):
        frames.append(real(df))
        return frames[-1]

    for module in (gloss, translate):
        monkeypatch.setattr(module, "checkpointed", keep, raising=False)
    rows = run().collect()
    return sum(f.select(F.sum(F.length(F.to_json(F.struct(*f.columns))))).first()[0] or 0 for f in frames), rows


def test_no_word_carries_its_candidates(spark, entries_of, monkeypatch):
    long = entries_of(("lantern", [(N, ["đèn lồng " + "x" * 2_000])]))
    texts = spark.createDataFrame([(i, f"lantern {i}") for i in range(100)], "text_id int, text string")
    kept, rows = _kept(monkeypatch, lambda: translate.translate_texts(texts, long))
    assert len(rows) == 100 and all(r["translation"].lower().startswith("đèn lồng xxx") and r["translation"].endswith(str(r["text_id"])) for r in rows)
    assert kept < 50_000


def test_first_glosses_are_those_of_the_segments(spark, entries_of, monkeypatch):
    e = entries_of(("harbour", [(N, ["chỗ trú " + "x" * 2_000, "hải cảng"]), (N, ["bến tàu"])]), ("set up", [(V, ["dựng"])]))
    rows = spark.createDataFrame([*((i, f"harbour {i} set up, set") for i in range(60)), (60, None), (61, ""), (62, "harbour 1 set up, set")], "sentence_id int, sentence string")
    table = spark.createDataFrame([("harbour", "bến", 1, 30000), ("harbour", "tàu", 2, 20000)], "e string, f string, rank int, q int")
    kept, got = _kept(monkeypatch, lambda: gloss.first_glosses(rows, e, lexicon=table))
    segments = {r["sentence_id"]: r["segments"] for r in gloss.gloss_sentences(rows, e, lexicon=table).collect()}
    wanted = [(i, n, s["source"], s["kind"], s["candidates"][0]["gloss"] if s["candidates"] else None) for i, ss in segments.items() for n, s in enumerate(ss)]
    assert sorted(map(tuple, got)) == sorted(wanted) and (1, 0, "harbour", "WORD", "bến tàu") in wanted and len(segments) == 63
    assert kept < 50_000

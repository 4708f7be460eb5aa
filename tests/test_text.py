import unicodedata

from pyspark.sql import functions as F

from lexiloom.functions import segment, text
from lexiloom.operators import subword
from lexiloom.sources import files


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normalize(spark):
    assert values(spark, text.normalize_headword, "\ufeff En_plein  Air\t", None, "Đồng", unicodedata.normalize("NFD", "Đồng")) == ["en plein air", "", "đồng", "đồng"]
    assert values(spark, text.remove_diacritics, "Đông chăm sóc", None, "é") == ["Dong cham soc", "", "e"]
    assert values(spark, text.gloss_alternatives, "cho, biếu; (cũ) tặng [x]", " , ") == [["cho", "biếu", "tặng"], []]
    assert values(spark, text.trigrams, "go", "") == [["$$g", "$go", "go$", "o$$"], []]
    assert values(spark, text.looks_vietnamese, "Chăm", "café", None) == [True, False, False]


def test_lemmas(spark):
    got = values(spark, text.lemma_candidates, "carries", "swimming", "baked", "sang", "worse", "roses", "ox", "boldly", "thinnest")
    assert got[0][0] == "carry" and got[1][:3] == ["swim", "swimm", "swimme"] and "bake" in got[2] and got[3] == ["sing"]
    assert got[4][0] == "bad" and got[5][:2] == ["ros", "rose"] and got[6] == [] and got[7] == ["bold", "bolde"] and got[8][0] == "thin"
    assert values(spark, text.is_past_form, "sang", "baked", "bed", "swim") == [True, True, False, False]
    assert values(spark, text.lemma, "sang", "carries", "lantern") == ["sing", "carry", "lantern"]
    assert values(spark, text.irregular, "sang", "carries") == ["sing", None]
    assert values(spark, text.contains_letter, "12 - 3", "a", None) == [False, True, False]


def test_other_text_functions(spark):
    assert values(spark, text.shorten, "(cũ) đèn, nến", " [x] ", None) == ["đèn", "[x]", ""]
    assert values(spark, text.normalize_vietnamese, " Đèn Lồng\t") == ["den long"]
    assert values(spark, text.paste_normalize, "a \r\n  b") == ["a b"]
    assert values(spark, text.subtitle_clean, "{\\an8}- Come in", "Stop!") == ["Come in.", "Stop!"]
    assert values(spark, lambda t: text.set_jaccard(text.trigrams(t), text.trigrams(F.lit("ab"))), "ab", "zz", "") == [1.0, 0.0, 0.0]
    assert values(spark, text.looks_like_sentence, "one two three four", "one") == [True, False]


def test_tokens_are_lossless():
    for s in ("She rowed past the pier.", "see https://pier.example/x. i.e. those, can't 2.5 3,000 08:15 7/11 snow-white end-", "", "  ", "𝒜b_c"):
        assert "".join(t[0] for t in segment.tokenize(s)) == s
    assert [t[0] for t in segment.tokenize("can't 2.5, i.e. www.pier.x/y.") if t[3]] == ["can't", "2.5", "i.e.", "www.pier.x/y"]


def test_sentences():
    assert segment.split_sentences("Mr. Oak came. She ran!\nT. B. Fern sat. ok then") == ["Mr. Oak came.", "She ran!", "T. B. Fern sat. ok then"]
    assert segment.split_sentences("The rope weighs 2.5 stones. “No!” She left.") == ["The rope weighs 2.5 stones.", "“No!”", "She left."]
    assert segment.split_sentences(None) == []
    assert segment.split_long("rope, sail; mast: oars and a very long keel", 20) == ["rope, sail; mast:", "oars and a very long keel"]


def test_subwords():
    lines = ["</s>\t0", "<unk>\t0", "▁the\t-2", "▁harbour\t-3", "▁re\t-4", "paint\t-5", "able\t-5", "paintable\t-4", "▁re\t-9", "no tab", "x\t-1"]
    v = subword.read_vocabulary(lines)
    assert v["▁re"] == (4, -4.0) and v["x"][0] == 9
    assert subword.encode("the harbour", v, 1, 0) == [2, 3, 0]
    assert subword.encode("repaintable", v, 1, 0) == [4, 7, 0]
    assert subword.decode([2, 3, 0], ["</s>", "<unk>", "▁the", "▁harbour"], {0, 1}) == "the harbour"
    assert subword.repeated_ngram_bans([1, 2, 3, 1, 2], 3) == {3}


def test_vocabulary_of_a_tokenizer_file(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"model": {"type": "Unigram", "vocab": [["</s>", 0.0], ["a", -1.5]]}, "x": 1}')
    assert [tuple(r) for r in files.tokenizer_pieces(spark, str(tmp_path / "t.json")).collect()] == [(0, "</s>", 0.0), (1, "a", -1.5)]


def test_public_pieces_go_round(spark):
    lines = subword.model_lines()
    v, pieces = subword.read_vocabulary(lines), [x.rpartition("\t")[0] for x in lines]
    assert len(pieces) == 32_000 and v["<unk>"][0] == 0 and v["</s>"][0] == 2
    one = "The lantern swings above the harbour."
    made = values(spark, subword.encoder(v, 0, 2), one, "", None, "x" * 5000)
    assert subword.decode(made[0], pieces, {0, 1, 2}) == one and len(made[0]) < 15 and made[1] == made[2] == [2]
    assert made[0] == subword.encode(one, v, 0, 2) and subword.decode(made[3], pieces, {2}) == "x" * 5000

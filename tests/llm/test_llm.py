import random
import re
import unicodedata
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import canonical, consistent, mix, residue, terms, tokens

LABELS = [(1, "danh từ", "noun", "dt"), (2, "động từ", "verb", "đgt"), (3, "tính từ", "adjective", "tt"), (10, "số từ", "numeral", "st"), (11, "ngoại động từ", "transitive verb", "ngđt"), (14, "danh từ riêng", "proper noun", "dtr"), (20, "thành ngữ", "idiom", "tng")]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "pos_id int, label string, name_en string, abbr string")


# 1
def test_typed_values(spark, entries_of, labels):
    wanted = {"danh tu": 1, "Danh Từ": 1, "[dt]": 1, "danh ừt": 1, "ddanh từ": 1, "danh từ (số nhiều)": 1, "y học, danh từ": 1, "nouns": 1, "pos=noun": 1, "độngtừ": 2, "adject.": 3, "danh тừ": 1, "số ừt": 10, "trans. verb.": 11, "ngtại đuộng từ": 11, "danh từ riêng": 14, "thành ngữ": 20, "khẩu ngữ": 0, "???": 0, "12": 0, "n/a": 0, "archaic": 0, "số ít": 0}
    e = entries_of(*[("w", [(p, ["g"])]) for p in wanted], ("w", [(None, ["g"]), ("  ", ["g"]), ("danh tu", None)]), ("none", None), ("none", []))
    got = canonical.sense_labels(e.withColumn("pos", F.lit("clash")).withColumn("value", F.lit(1)), labels).collect()
    assert {r["pos"]: r["pos_id"] for r in got} == wanted and len(got) == len(wanted) + 1
    assert {r["pos"] for r in got if r["exact"]} == {"danh từ riêng", "thành ngữ"}
    assert canonical.sense_labels(e.limit(0), labels).count() == 0
    assert {r["pos_id"] for r in canonical.sense_labels(e, labels.limit(0)).collect()} == {0}


def test_similarity_join_loses_no_pair(spark):
    rng = random.Random(3)
    sets = lambda n: {f"s{i}": sorted({rng.choice("abcdefghij") for _ in range(rng.randint(0, 7))}) for i in range(n)}
    a, b = sets(60), sets(50)
    df = lambda d: spark.createDataFrame(list(d.items()), "id string, tokens array<string>")
    for t in (0.3, 0.5, 0.8):
        got = {(r["left_id"], r["right_id"]) for r in canonical.set_similarity_join(df(a), df(b), t).collect()}
        brute = {(i, j) for i, x in a.items() for j, y in b.items() if x and y and len({*x} & {*y}) / len({*x} | {*y}) >= t}
        assert got == brute


# 2 and 5
def test_counters_and_scores_against_brute_force(spark, entry_rows, entry_schema):
    rng = random.Random(1)
    vocab = ["a", "b", "cộng", "dе", "ｅ", "f²", "g", "h1i"]
    rows = entry_rows(*[(rng.choice(vocab), None if rng.random() < 0.1 else [("n", [None if rng.random() < 0.1 else " ".join(rng.choices(vocab, k=rng.randint(0, 8))) for _ in range(3)])]) for _ in range(80)])
    rows.append(rows[0])
    e = spark.createDataFrame(rows, entry_schema).repartition(5).withColumn("term", F.lit("clash"))
    find = lambda s: re.findall(r"[^\W\d_²]+", consistent.consistent(s).lower())
    docs = [[t for s in r[7] or () for g in s[1] if g for t in find(g)] for r in rows]
    occ, rec = Counter(t for d in docs for t in d), Counter(t for d in docs for t in {*d})
    got = {r["term"]: r for r in terms.gloss_term_counts(e, rare=2, common=0.5).collect()}
    assert {t: (r["occurrences"], r["records"]) for t, r in got.items()} == {t: (occ[t], rec[t]) for t in occ}
    assert {t: r["mark"] for t, r in got.items()} == {t: "rare" if rec[t] <= 2 else "common" if rec[t] > 0.5 * len(rows) else None for t in rec}
    whole = [find(r[3]) + d for r, d in zip(rows, docs, strict=True)]
    cf, df, total = Counter(t for d in whole for t in d), Counter(t for d in whole for t in {*d}), sum(map(len, whole))
    for r in terms.distinctive_terms(e).collect():
        d = whole[r["entry_id"] - 1]
        k11, k12 = r["tf"], cf[r["term"]] - r["tf"]
        k21, k22 = len(d) - k11, total - len(d) - k12
        g = sum(2 * k * log(k * total / (a * b)) for k, a, b in ((k11, k11 + k21, k11 + k12), (k12, k12 + k22, k11 + k12), (k21, k11 + k21, k21 + k22), (k22, k12 + k22, k21 + k22)) if k)
        assert r["tf"] == d.count(r["term"]) and r["records"] == df[r["term"]] and abs(abs(r["score"]) - g) < 1e-6
    scored = terms.distinctive_terms(e)
    assert {(r["entry_id"], r["term"]) for r in terms.distinctive_terms(e, min_score=3.0).collect()} == {(r["entry_id"], r["term"]) for r in scored.filter("score >= 3").collect()} != set()
    assert terms.gloss_term_counts(e.limit(0)).count() == 0 and terms.distinctive_terms(e.limit(0)).count() == 0


def test_terms_that_an_entry_dwells_on_are_found_by_the_ratio(spark, entries_of):
    rows = [("w" + "abcdefghij"[i % 10], [("n", ["trâu trâu trâu" if i in (3, 90) else "bò ngựa"])]) for i in range(120)]
    e = entries_of(*rows)
    found = terms.distinctive_terms(e, min_tf=3, min_records=2, max_share=0.02, min_score=terms.CRITICAL)
    assert {(r["entry_id"], r["term"]) for r in found.collect()} == {(4, "trâu"), (91, "trâu")}
    assert "ln(" in (plan := found._jdf.queryExecution().optimizedPlan().toString().lower()) or "log(" in plan


def test_counters_flush_between_records(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(terms, "COUNTERS", 2)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 2]), pa.array([["a b a"], ["a c d"], None], pa.list_(pa.string()))], names=["entry_id", "texts"])
    out = Counter()
    for b in terms._last_seen(iter([batch])):
        for r in b.to_pylist():
            out[r["term"], "o"] += r["occurrences"]
            out[r["term"], "r"] += r["records"]
    assert (out["a", "o"], out["a", "r"], out["d", "r"]) == (3, 2, 1)


# 6
@pytest.mark.parametrize(
    ("text", "wanted"),
    [("ngườі", "người"), ("сһo kéο", "cho kéo"), ("λόγoς", "λόγος"), ("(chữ Nga: сосна)", "(chữ Nga: сосна)"), ("m² CO₂ ½ hoà hòa", "m² CO₂ ½ hoà hòa"), ("Ðến ӑn", "Đến ăn"), ("oﬀ deg­o​rk﻿", "off degork"), ("a b　c\td\n", "a b c\td\n"), ("ｔừ（ｃũ）", "từ(cũ)"), ("dіtсһ-nаіl", "ditch-nail"), ("sɑil /ʌɡɑ/", "sail /ʌɡɑ/"), (unicodedata.normalize("NFD", "được"), "được"), ("", ""), ("🙂 — “x”", "🙂 — “x”"),
     ("kadın", "kadın"), ("Ðað er", "Ðað er"), ("Ðồng", "Đồng"), ("Ðo đường", "Đo đường"), ("ΠΡИВЕТ", "ПРИВЕТ"), ("ьad", "bad"), ("ca\u217cl", "call"), ("ꓡove", "Love"), ("hᴇllo", "hello"), ("Ⅳ", "Ⅳ"),],
)
def test_consistent_form(text, wanted):
    assert consistent.consistent(text) == wanted
    assert consistent.consistent(wanted) == wanted
    assert (text == wanted) or re.search(consistent.SUSPECT, text)


def test_inconsistent_texts(spark, entries_of):
    e = entries_of(("sеt", [("n", ["ổn", None, "một hai", ""])]), ("ok", None), ("​" + "a" * 100_000, []))
    got = {(r["entry_id"], r["field"], r["sense_no"], r["item_no"]) for r in consistent.inconsistent_texts(e.withColumn("text", F.lit("clash"))).collect()}
    assert got == {(1, "headword", -1, -1), (1, "gloss", 0, 2), (3, "headword", -1, -1)}
    assert consistent.consistent_texts(e).filter("changed").count() == 3
    assert consistent.inconsistent_texts(e.limit(0)).count() == 0


def test_whole_script_confusables_are_reported(spark, entries_of):
    # Cyrillic look-alikes throughout; Russian; mixed, so respelled; both
    e = entries_of(("сор", [("n", ["сосна", "сeт", "ok", "сeт сор"])]), (None, None))
    got = {(r["field"], r["item_no"]): (r["consistent"], r["changed"], r["confusable"]) for r in consistent.consistent_texts(e).collect()}
    assert got == {("headword", -1): ("сор", False, True), ("gloss", 0): ("сосна", False, False), ("gloss", 1): (got["gloss", 1][0], True, False), ("gloss", 2): ("ok", False, False), ("gloss", 3): (got["gloss", 3][0], True, True)}
    assert {(r["item_no"], r["confusable"]) for r in consistent.inconsistent_texts(e).collect()} == {(1, False), (3, True)}
    assert consistent.consistent_texts(e.limit(0)).count() == 0
    words = {(r["field"], r["item_no"]): r["words"] for r in consistent.confusable_texts(e.withColumn("words", F.lit("clash"))).collect()}
    assert words == {("headword", -1): ["сор"], ("gloss", 3): ["сор"]}
    assert consistent.confusable_texts(e.limit(0)).count() == 0


# 7
def reference_ids(texts):
    return tokens.encoder(tokens.TOKENIZER_DIR, tokens.TOKENIZER)(texts)


def test_joins_are_exact_at_any_cut():
    rng = random.Random(2)
    alphabet = ["'", "s", "re", " ", "  ", "\n", "\t", "ả", "é", "1", "22", "!", "<|endoftext|>", " ", "​", "\x1c", "中", "'ll", "\r\n", "𝒜", "_", "word", " the"]
    encode = tokens.encoder(tokens.TOKENIZER_DIR, tokens.TOKENIZER)
    joiner = tokens.Joiner(encode)
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 40)))
        parts, i = [], 0
        while i < len(text):
            j = i + rng.randint(1, 9)
            parts.append(text[i:j])
            i = j
        whole = encode([text])[0]
        assert joiner.join(list(zip(parts, encode(parts), strict=True))) == whole == joiner.whole(text)


def test_chunks_are_content_defined():
    rng = random.Random(4)
    body = "".join(rng.choices("abc déf\n", k=6000))
    a, b = tokens.chunks(body), tokens.chunks("another beginning " + body)
    assert "".join(a) == body and len({*a} & {*b}) > len(a) / 2
    assert all(len(c.encode()) <= tokens.LONGEST for c in a) and tokens.chunks("") == []


def test_token_ids(spark):
    rng = random.Random(6)
    shared = "".join(rng.choices("xyz áê ", k=3000))
    texts = [None, "", " ", "a", shared, shared + "!", "é" * 30_000, "<|endoftext|> x", shared]
    df = spark.createDataFrame([*enumerate(texts), (4, shared), (4, "other")], "doc_id long, text string").withColumn("key", F.lit("clash"))
    assert len(tokens.shared_chunks(df.select("text").filter("length(text) > 0"), tokens.TOKENIZER_DIR, tokens.TOKENIZER)) > 5
    small = sorted((r["doc_id"], list(r["ids"])) for r in tokens.token_ids(df, table=1000).collect())
    got = sorted((r["doc_id"], list(r["ids"])) for r in tokens.token_ids(df).collect())
    want = sorted([*((i, reference_ids([t])[0] if t else []) for i, t in enumerate(texts)), (4, reference_ids([shared])[0]), (4, reference_ids(["other"])[0])])
    assert got == want == small  # whatever has room in the table
    sizes = tokens.token_counts(df.withColumn("ids", F.lit("clash")), ["doc_id", "ids"])
    assert sorted(map(tuple, sizes.select("doc_id", "n_tokens").collect())) == sorted((i, len(x)) for i, x in want)
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_chunks_are_taken_from_slices_and_don_t_see_their_neighbours():
    import pyarrow as pa

    rng = random.Random(8)
    texts = ["".join(rng.choices("abc déf xy", k=rng.choice([0, 5, 300, 4000]))) for _ in range(40)] + [None, ""]
    alone = [tokens.column_chunks(pa.array([t]))[0] for t in texts]
    assert tokens.column_chunks(pa.array(texts)) == alone and tokens.column_chunks(pa.array(texts).slice(3, 9)) == alone[3:12]
    assert [b"".join(c).decode() for c in alone] == [t or "" for t in texts] and tokens.column_chunks(pa.array([], pa.string())) == []


# 8
def test_mix(spark):
    rng = random.Random(7)
    docs = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 50)) for i in range(3000)] + [(5000 + i, "small", 30) for i in range(20)] + [(9000, "untargeted", 9)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("small", 0.06, 3), ("absent", 0.04, 2)], "source string, target_share double, max_repeats int")
    got = mix.mix(sized, targets, total=20_000.0)
    rows = got.collect()
    report = {r["source"]: r for r in mix.mix_report(got, sized, targets).collect()}
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows) and all(0 <= r["position"] <= 1 for r in rows)
    assert report["small"]["most_copies"] <= 3 and report["untargeted"]["mixed_tokens"] == 0 and report["absent"]["mixed_tokens"] == 0
    demand = mix.demands({"a": sum(n for _, s, n in docs if s == "a"), "b": sum(n for _, s, n in docs if s == "b"), "small": 600}, [("a", 0.5, 1), ("b", 0.4, 2), ("small", 0.06, 3), ("absent", 0.04, 2)], 20_000.0)
    for s, d in demand.items():
        assert abs(report[s]["mixed_tokens"] - d) <= 50
    exact = mix.mix_report(mix.mix(sized, targets), sized, targets).collect()
    live = {r["source"]: r["actual_share"] for r in exact if r["mixed_tokens"]}
    assert abs(live["a"] / live["b"] - 1.25) < 0.02
    assert mix.mix(sized.limit(0), targets).count() == 0 and mix.mix(sized, targets.limit(0)).count() == 0


def test_schedules_are_inverted(spark):
    segments = mix.integrate([(0.0, 2.0), (0.5, 0.0), (1.0, 2.0)])
    rows = spark.createDataFrame([(x / 20, [dict(zip(("t0", "t1", "w0", "w1", "done"), s, strict=True)) for s in segments]) for x in range(21)], "share double, g array<struct<t0:double,t1:double,w0:double,w1:double,done:double>>")
    for r in rows.withColumn("t", mix.invert(F.col("share"), F.col("g"))).collect():
        done = sum((min(r["t"], b) - a) * (v + (v + (w - v) * (min(r["t"], b) - a) / (b - a))) / 2 for a, b, v, w, _ in segments if r["t"] > a)
        assert abs(done - r["share"]) < 1e-6
    with pytest.raises(ValueError):
        mix.integrate([(0.0, 0.0), (1.0, 0.0)])


# 9
FOUND = [
    "Dear {{headword}}, welcome.", "* danh từ\n- __headword__", "= ${headword} + %(name)s", "- [TODO: MEANING]", "- (điền nghĩa vào đây)", "set /{{ ipa }}/", "Error 404\nNot Found", "HTTP 503 - Service Unavailable", "502 Bad Gateway",
    "Xin lỗi, không thể tải phần ví dụ.", "Sorry, we were unable to open this entry right now.", "Please enable JS to view this page.", "To read this entry, allow active content and refresh.", "Trang này cần JavaScript để hiển thị.", "Ordinary text.\n\nComing soon!",
    "Lorem ipsum dolor sit amet, velitas minim.", "asdf asdf asdf asdf asdf", "Item 1\nDescription of item 1\nItem 2\nDescription of item 2", "Traceback (most recent call last):\n  File \"a.py\", line 3, in f", "* danh từ\n- TBD", "sjahhlfgk dg;ha dhfdafkh  sskakhaskgsfh", unicodedata.normalize("NFD", "Xin lỗi, không thể tải phần ví dụ."),
]
KEPT = [
    "placeholder (danh từ): phần giữ chỗ. In a template, a name in double braces such as {{ipa}} stands for a value.", "In a shell the name is written ${HEADWORD} and in a format string %s or {0}; manuals write it so.", 'The sentence "Please enable JavaScript" is translated as "Vui lòng bật JavaScript"; the name itself is never translated.',
    "Something went wrong. - Đã có lỗi xảy ra.", "Error 404 (cụm danh từ): mã lỗi do máy chủ trả về.", "Sorry, we could not carry the barrel.", "The bridge is still under construction, so the ferry runs.", "The kettle costs 404 coins.", 'JSON (danh từ riêng): ví dụ {"a": 1}.', "Anh ấy không tìm thấy trang sách bị rách.",
    "Use `{{name}}` in your file.", "```\n${x} = {{y}}\n```\nThat is all.", "", "   ", "A long text: " + " ".join(f"w{i}" for i in range(50_000)),
]


def test_residue_kinds():
    assert [t for t in FOUND if not residue.residue(t)] == []
    assert [t[:60] for t in KEPT if residue.residue(t)] == []


def test_residue_texts(spark):
    df = spark.createDataFrame([*enumerate(FOUND + KEPT), (0, FOUND[0]), (777, None)], "doc_id long, text string").withColumn("kind", F.lit("clash"))
    assert sorted(r["doc_id"] for r in residue.residue_texts(df).collect()) == sorted([*range(len(FOUND)), 0])
    assert residue.clean_texts(df).count() == len(KEPT) + 1
    assert residue.residue_texts(df.limit(0)).count() == 0

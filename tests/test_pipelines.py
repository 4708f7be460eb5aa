import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import history, lexicon, packed, parse_rows
from lexiloom.sources import files, marker
from lexiloom.streaming import history as live


def test_packed_values(entries_of, spark):
    glosses = ["a, b", "một; hai;; ba", '"x, y"', "(cũ, hiếm) a", "2,5 lít", "90 km/h", "1. a 2. b", "(1) a; (2) b", '["a", "nói \\"b\\", c"]', 'a;"nói ""b"", c"', "- a\n- b", "a / b,c", " ", None, "a |", "x · y\tz", "11\" cỡ, b", "“a; b”; c", ", a"]
    e = entries_of(("w", [("n", glosses)]), ("none", None), ("empty", []))
    got = {}
    for r in packed.packed_glosses(e.withColumn("value", F.lit(1))).orderBy("gloss_no", "value_pos").collect():
        got.setdefault(r["gloss_no"], []).append(r["value"])
    assert got == {0: ["a", "b"], 1: ["một", "hai", "ba"], 6: ["a", "b"], 7: ["a", "b"], 8: ["a", 'nói "b", c'], 9: ["a", 'nói "b", c'], 10: ["a", "b"], 11: ["a", "b", "c"], 15: ["x", "y", "z"], 16: ['11" cỡ', "b"], 17: ["a; b", "c"]}
    assert packed.packed_glosses(e.limit(0)).count() == 0


def test_skeletons_have_a_sign_a_token(spark):
    rng = random.Random(1)
    signs = ["km", "h", "/", "m", " ", "  ", "a", "từ", "12", "345", "1.", "(", ")", ",", ";", "\u00a0", '"', "\n", "KM", "\ufdd3", "x/m", "l"]
    df = spark.createDataFrame([("".join(rng.choices(signs, k=rng.randint(1, 14))),) for _ in range(5000)], "t string")
    tokens, skeleton = packed.tokens_of(F.col("t")), packed.skeleton_of(F.col("t"))
    assert df.filter((F.size(tokens) != F.length(skeleton)) | (F.array_join(tokens, "") != F.col("t"))).count() == 0
    one = spark.createDataFrame([("chạy nhanh  90 km/h trong 3 giờ",)], "t string")
    assert one.select(skeleton).first()[0] == "w 1 u/u w 1 w"


@pytest.mark.parametrize("most", [0, 1, 20_000])
def test_rules_are_the_same_wherever_resolved(spark, monkeypatch, most):
    monkeypatch.setattr(packed, "BROADCAST_RULES", most)
    df = spark.createDataFrame([(i, t) for i in range(6) for t in ("a, b", "một hai; ba", None, "x")] + [(9, "a; " * 400)], "id int, t string")
    got = sorted((r["id"], r["value_pos"], r["value"]) for r in packed.packed_values(df, ["id"], "t").collect())
    assert got == sorted([*((i, k, v) for i in range(6) for vs in (["a", "b"], ["một hai", "ba"], ["x"]) for k, v in enumerate(vs)), *((9, k, "a") for k in range(400))])


def test_packed_values_of_very_long_text(spark):
    df = spark.createDataFrame([(1, "; ".join(f"v{i}" for i in range(20000)))], "id int, t string")
    rows = packed.packed_values(df, ["id"], "t")
    assert rows.count() == 20000 and rows.filter("value_pos = 19999").first()["value"] == "v19999"


def brute_reason(line):
    if line is None:
        return None
    s = line.removeprefix("﻿")
    s = s[:-1] if s.endswith("\r") else s
    if not s.strip() or s.startswith("#"):
        return None
    fields, i = [], 0
    while True:
        if s[i : i + 1] == '"':
            j = i + 1
            while (k := s.find('"', j)) >= 0 and s[k + 1 : k + 2] == '"':
                j = k + 2
            if k < 0 or s[k + 1 : k + 2] not in ("", "\t"):
                return "broken_quote"
            fields.append(s[i + 1 : k].replace('""', '"'))
            i = k + 1
        else:
            k = s.find("\t", i)
            k = len(s) if k < 0 else k
            fields.append(s[i:k])
            i = k
        if i >= len(s):
            break
        i += 1
    if len(fields) not in (2, 3):
        return "column_count"
    for n, v in enumerate(fields[:2]):
        if not any(c.isalnum() for c in v) or any((unicodedata.category(c) == "Cc" and c != "\t") or c == "�" for c in v):
            return "bad_value"
        if n and (v.strip().lower() in parse_rows.MARKS_ANY_CASE or v.strip() in parse_rows.MARKS):
            return "bad_value"
    return None


def test_parse_rows_against_brute_force(spark):
    rng = random.Random(5)
    parts = ['"', '""', "\t", "a", "ô", "1", " ", "﻿", "\r", "#", "NULL", "-", "\x07", "N/A", "�"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(6000)] + [None, "", "a\tb", "a\tb", '"a\tb', "#a\tb", 'a\t"x\ty"\tn']
    df = spark.createDataFrame(list(enumerate(lines)), "line_id int, raw_line string")
    got = {r["line_id"]: r["row_reason"] for r in parse_rows.failed_rows(df).collect()}
    assert [(x, got.get(i)) for i, x in enumerate(lines) if got.get(i) != brute_reason(x)] == []
    valid = {r["line_id"]: (r["headword"], r["gloss"], r["pos"]) for r in parse_rows.valid_rows(df).collect()}
    assert valid[len(lines) - 1] == ("a", "x\ty", "n") and valid[6002] == ("a", "b", None)


def test_parse_rows_long_lines_and_clashing_names(spark):
    df = spark.createDataFrame([(1, '"' + '""' * 50000 + 'a"\tb', "mine"), (2, "a\t" * 50000, "x"), (3, '"a\tb', None)], "line_id int, raw_line string, gloss string")
    rows = {r["line_id"]: r for r in parse_rows.failed_rows(df).collect()}
    assert rows[2]["row_reason"] == "column_count" and rows[3]["row_reason"] == "broken_quote" and rows[3]["row_field"] == 1 and 1 not in rows
    assert parse_rows.valid_rows(df).first()["gloss"] == "b"
    assert parse_rows.failed_rows(df.limit(0)).count() == 0


def test_lexicon_by_hand(spark):
    pairs = spark.createDataFrame([(1, "the house", "nhà"), (2, "the book", "sách"), (3, "book", "sách"), (3, "book", "sách"), (4, "", "x"), (5, None, None)], "line_no long, en string, vi string")
    t = {(r["e"], r["f"]): r["t"] for r in lexicon.train(pairs, 4).collect()}
    assert t["book", "sách"] > 0.99 and t["house", "nhà"] > t["the", "nhà"] and abs(t["the", "nhà"] + t["the", "sách"] - 1) < 1e-9
    top = lexicon.format_translations(lexicon.top_translations(lexicon.train(pairs, 4))).filter("e = 'book'").first()["translations"]
    assert top.startswith("sách(")


def test_history(spark, tmp_path):
    log = spark.createDataFrame([(1, "word", "a"), (2, "word", "a"), (3, "word", "b\tc"), (4, "word", "a"), (5, None, "x"), (6, "word", " "), (7, "fuzzy", "a"), (7, "fuzzy", "a")], "epoch_second long, mode string, query string")
    clean = history.clean_log(log)
    assert clean.count() == 6
    assert [(r["mode"], r["query"]) for r in history.latest_per_key(clean).collect()] == [("fuzzy", "a"), ("word", "a"), ("word", "b c")]
    assert [r["epoch_second"] for r in history.drop_repeats(clean).orderBy("epoch_second").collect()] == [1, 3, 4, 7]
    mixed = spark.createDataFrame([(1, "word", "a"), (2, "sentence", "b"), (3, "word", "a"), (4, "word", "a")], clean.schema)
    assert [r["epoch_second"] for r in history.drop_repeats(mixed).orderBy("epoch_second").collect()] == [1, 2, 3]
    rng = random.Random(3)
    many = sorted((t, rng.choice("xy"), rng.choice("ab")) for t in range(400))
    kept = [x for x, y in zip(many, [None, *many], strict=False) if y is None or x[1:] != y[1:]]
    assert sorted(map(tuple, history.drop_repeats(spark.createDataFrame(many, clean.schema).repartition(7)).collect())) == kept
    assert history.drop_repeats(clean.limit(0)).count() == 0
    assert history.explicit(log.withColumn("trigger", F.when(F.col("epoch_second") == 1, "mode"))).count() == log.count() - 1
    shown = history.described(spark.createDataFrame([(0, "word", "x " * 100)], clean.schema), 2024).first()
    assert shown["time"] == "01/01/1970 00:00" and len(shown["preview"]) == 111
    files.append_history(clean, str(tmp_path / "kept"))
    files.rewrite_history(history.compact(log, 2, 3), str(tmp_path / "kept"), str(tmp_path / "fresh"))
    assert files.read_history(spark, str(tmp_path / "kept")).count() == 2
    assert history.retain(clean, 2, 3).count() == 2 and history.retain(clean, 2, 100).count() == 6
    gone = spark.createDataFrame([("word", "a")], "mode string, query string")
    assert history.remove_keys(clean, gone).count() == 3
    log.write.parquet(str(tmp_path / "log"))
    stream = live.first_lookups(live.read_log(spark, str(tmp_path / "log")))
    q = stream.writeStream.format("memory").queryName("lookups").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from lookups").first()[0] == 5


def test_marker_format(spark, tmp_path):
    (tmp_path / "d.txt").write_text(
        "\ufeffrubbish\n@ember /'embə/\n*danh từ\n- than hồng\n=the ember is warm+than còn ấm\n- tàn lửa\n!ember and ash\n- (văn học) dấu vết cũ\n*động từ\n- âm ỉ\n+ coal\n?odd\n@en_plein_air /an plen/ (x) /y/\n- ngoài trời\n@in/out\n",
        encoding="utf-8",
    )
    lines = marker.read_lines(spark, str(tmp_path / "d.txt"), 7)
    got = {r["headword"]: r for r in marker.entries(lines).collect()}
    assert set(got) == {"ember", "en plein air", "in/out"}
    ember = got["ember"]
    assert ember["ipa"] == "'embə" and [s["pos"] for s in ember["senses"]] == ["danh từ", "động từ"] and ember["cross_refs"] == ["coal"]
    assert ember["senses"][0]["glosses"] == ["than hồng", "tàn lửa"] and ember["senses"][0]["examples"][0]["vi"] == "than còn ấm"
    assert [i["phrase"] for i in ember["idioms"]] == ["ember and ash"] and got["en plein air"]["variant"] == "x"
    assert got["en plein air"]["senses"][0]["pos"] is None and got["in/out"]["senses"] == []
    assert {r["line"].lstrip("\ufeff") for r in marker.bad_lines(lines).collect()} == {"rubbish", "?odd"}
    assert marker.bad_line_report(lines, 1)[0] == 2 and len(marker.bad_line_report(lines, 1)[1]) == 1


def test_lines_are_numbered_across_splits_and_files(spark, tmp_path):
    (tmp_path / "en").mkdir()
    (tmp_path / "vi").mkdir()
    rows = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    (tmp_path / "en" / "a.txt").write_text("\n".join(rows[:2000]) + "\n")
    (tmp_path / "en" / "b.txt").write_text("\n".join(rows[2000:]) + "\n")
    (tmp_path / "vi" / "whole.txt").write_text("\n".join(rows[:2990]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        one = marker.read_lines(spark, str(tmp_path / "vi"), 0)
        assert one.rdd.getNumPartitions() > 3
        assert [r["line"] for r in one.orderBy("line_no").collect()] == rows[:2990] and one.agg(F.max("line_no")).first()[0] == 2990
        pairs = files.read_pairs(spark, str(tmp_path / "en"), str(tmp_path / "vi"))
        assert pairs.count() == 2990 and pairs.filter(F.col("en") != F.col("vi")).count() == 0
        # an entry that goes on over many splits
        (tmp_path / "d.txt").write_text("@big\n" + "- gloss\n" * 3000 + "@next\n- x\n")
        got = {r["headword"]: len(r["senses"][0]["glosses"]) for r in marker.entries(marker.read_lines(spark, str(tmp_path / "d.txt"), 1)).collect()}
        assert got == {"big": 3000, "next": 1}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tsv_store_and_catalog(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# name: X\nno-tab-here\n\nkettle\tấm nước\n\t\nyes\tvâng, dạ\ttừ\n", encoding="utf-8")
    rows = files.read_tsv(spark, str(tmp_path / "t.tsv"), 3)
    assert files.tsv_can_read("x.tsv", ["# c", "a\tb"]) and not files.tsv_can_read("x.tsv", ["@a"]) and not files.tsv_can_read("x.csv", ["a\tb"])
    assert {(r["headword"], r["senses"][0]["glosses"][0], r["senses"][0]["pos"]) for r in rows.collect()} == {("kettle", "ấm nước", None), ("yes", "vâng, dạ", "từ")}
    assert files.display_name("t.tsv", ["# name: X"]) == "X" and files.display_name("t.tsv", []) == "t"
    (tmp_path / "c.tsv").write_text("# c\n0\tA\ttsv\ta\t5\t1\t0\nshort\n", encoding="utf-8")
    assert files.read_catalog(spark, str(tmp_path / "c.tsv")).first()["name"] == "A"
    (tmp_path / "h.log").write_text("1\tword\ta\tb\nx\tword\ta\n2\t\tq\nbroken\n", encoding="utf-8")
    assert [r["query"] for r in files.read_history(spark, str(tmp_path / "h.log")).collect()] == ["a\tb"]

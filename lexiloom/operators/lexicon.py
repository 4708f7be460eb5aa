"""Word-translation probabilities from a parallel corpus by expectation-maximisation."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from operator import add
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions.text import dequantize, english_tokens, gloss_alternatives, quantize, split_tokens
from lexiloom.operators.ordered import numbered
from lexiloom.operators.skew import lookup
from lexiloom.session import checkpointed

NULL_WORD = ""
#: Between the tokens of a line, of which none has it.
SEPARATOR = "\n"
#: Text of lines that are packed together.
CHUNK_BYTES = 16 << 20
#: Word pairs that are worked on at once, and lines from which on a word is taken by itself.
BATCH, FREQUENT = 1 << 20, 50


def usable_pairs(pairs: DataFrame, most_tokens: int | None = 20) -> DataFrame:
    """``(line_no, en, vi)`` as tokens; sides that are empty, or too long if there is a limit, are left out."""
    tokens = pairs.select("line_no", english_tokens(F.col("en")).alias("en"), split_tokens(F.col("vi")).alias("vi"))
    tokens = tokens.filter((F.size("en") > 0) & (F.size("vi") > 0))
    return tokens if most_tokens is None else tokens.filter((F.size("en") <= most_tokens) & (F.size("vi") <= most_tokens))


def stride_sample(pairs: DataFrame, most: int, most_tokens: int = 20) -> DataFrame:
    """Every n-th line of the corpus, n such that about ``most`` lines are looked at."""
    lines = pairs.agg(F.max("line_no")).first()[0] or 0
    stride = max(1, lines // max(1, most))
    return usable_pairs(pairs.filter((F.col("line_no") - 1) % stride == 0), most_tokens).orderBy("line_no").limit(most)


def _pack(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(part, packed)``: for each part of the ``f`` words the lines that have one.

    Of a line its words ``e`` as codes of a dictionary and those of its ``f`` that belong to the
    part; equal lines of a chunk are one with their number. Thus a pair is nowhere a row.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            lines = chunk.group_by(["en", "vi"]).aggregate([([], "count_all")]).combine_chunks()
            (en, e_code, e_len), (vi, f_code, f_len) = coded(lines["en"]), coded(lines["vi"])
            times, starts, row = lines["count_all"].to_numpy(), np.cumsum(e_len) - e_len, np.repeat(np.arange(len(e_len)), f_len)
            part_of = np.array([crc32(w.encode()) % parts for w in vi], "i8")[f_code]
            for part in np.unique(part_of).tolist():
                mine = part_of == part
                rows, f_row = np.unique(row[mine], return_inverse=True)
                words, codes = np.unique(e_code[spans(starts[rows], e_len[rows])], return_inverse=True)
                f_words, f_codes = np.unique(f_code[mine], return_inverse=True)
                e_small, f_small = codes.astype("u2" if len(words) < 1 << 16 else "i4"), f_codes.astype("u2" if len(f_words) < 1 << 16 else "i4")
                said = ([en[i] for i in words], [vi[i] for i in f_words], e_small, e_len[rows].astype("i4"), times[rows].astype("i4"), f_row.astype("i4"), f_small)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "packed": pa.array([squeezed(pickle.dumps(said, 5))], pa.binary())})

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) > CHUNK_BYTES:
                yield pa.Table.from_batches(held)
                held = []
        if held:
            yield pa.Table.from_batches(held)

    def squeezed(raw: bytes) -> bytes:
        return pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)

    def coded(texts: pa.ChunkedArray) -> tuple[list[str], np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pa.chunked_array(texts.chunks, pa.string()).combine_chunks(), SEPARATOR)
        words = lists.flatten().dictionary_encode()
        return words.dictionary.to_pylist(), words.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype("i8")

    return pack


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class _Part:
    """The lines of a part, put together from its packed chunks."""

    def __init__(self, packed: list[bytes]) -> None:
        known_e: dict[str, int] = {}
        known_f: dict[str, int] = {}
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        n = 0
        for x in packed:
            en, vi, codes, lengths, times, f_row, f_code = pickle.loads(pa.CompressedInputStream(pa.py_buffer(x), "zstd").read())  # noqa: S301
            e_id = np.array([known_e.setdefault(w, len(known_e)) for w in en], "i4")
            f_id = np.array([known_f.setdefault(w, len(known_f)) for w in vi], "i4")
            for column, values in zip(columns, (e_id[codes], lengths, times, f_row + n, f_id[f_code]), strict=True):
                column.append(values)
            n += len(lengths)
        self.en, self.vi = list(known_e), list(known_f)
        self.codes, lengths, times, self.f_row, self.f = map(np.concatenate, columns)
        self.lengths, self.times = lengths.astype("i8"), times.astype("f8")
        self.starts = np.cumsum(self.lengths) - self.lengths

    def first_totals(self) -> np.ndarray:
        """The counts of each ``e`` in the first iteration, where all are alike."""
        share = np.bincount(self.f_row, minlength=len(self.lengths)) * self.times / self.lengths
        return np.bincount(self.codes, np.repeat(share, self.lengths), len(self.en))

    def counts(self, totals: list[dict[str, float]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(e, f, count)`` of the iteration after those whose ``totals`` are given.

        What an ``f`` needs of the iterations before are its own counts and the totals, so it
        goes through them all by itself. Frequent words are taken one by one, rare ones together.
        """
        by_e = [np.array([t[w] for w in self.en]) for t in totals]
        order = np.argsort(self.f, kind="stable")
        rows, f_of = self.f_row[order], self.f[order]
        # cut where a frequent word begins or ends, and rare ones at every BATCH pairs
        often = np.bincount(self.f, minlength=len(self.vi)) >= FREQUENT
        before = np.cumsum(self.lengths[rows]) // BATCH
        edge = np.flatnonzero(np.diff(f_of) != 0) + 1
        cuts, last = [0], 0
        for i in edge.tolist():
            if often[f_of[i]] or often[f_of[i - 1]] or before[i] != last:
                cuts.append(i)
                last = before[i]
        cuts.append(len(f_of))
        place = np.zeros(len(self.en), "i4")
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield self._counts_of(rows[a:b], f_of[a:b], by_e, place)

    def _counts_of(self, rows: np.ndarray, f_of: np.ndarray, by_e: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = self.lengths[rows]
        pieces = np.searchsorted(np.cumsum(lengths), np.arange(BATCH, lengths.sum(), BATCH)) + 1
        pieces = np.unique([0, *pieces, len(rows)])
        # a word of many lines goes through them piece by piece
        one = f_of[0] == f_of[-1]
        if one:
            seen = np.zeros(len(self.en), bool)
            for a, b in zip(pieces, pieces[1:], strict=False):
                seen[self.codes[spans(self.starts[rows[a:b]], lengths[a:b])]] = True
            e = np.flatnonzero(seen)
            f = np.full(len(e), f_of[0])
            place[e] = np.arange(len(e))
        else:
            pieces = pieces[[0, -1]]
            keys, met = np.unique(np.repeat(f_of.astype("i8"), lengths) * len(self.en) + self.codes[spans(self.starts[rows], lengths)], return_inverse=True)
            f, e = np.divmod(keys, len(self.en))
        made = None

        def prepared(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            n = lengths[a:b]
            return (place[self.codes[spans(self.starts[rows[a:b]], n)]] if one else met), np.cumsum(n) - n

        made = prepared(pieces[0], pieces[1]) if len(pieces) == 2 else None
        t = np.ones(len(e))
        for i in range(len(by_e) + 1):
            t = t if i == 0 else c / by_e[i - 1][e]  # noqa: F821
            c = np.zeros(len(e))
            for a, b in zip(pieces, pieces[1:], strict=False):
                at, first = made or prepared(a, b)
                share = self.times[rows[a:b]] / np.add.reduceat(t[at], first)
                c += np.bincount(at, np.repeat(share, lengths[a:b]), len(e))
            c *= t
        return e, f, c


def _parts(rows: Iterable[Row]) -> Iterator[_Part]:
    held: dict[int, list[bytes]] = {}
    for r in rows:
        held.setdefault(r["part"], []).append(r["packed"])
    while held:
        yield _Part(held.popitem()[1])


def _totals(packed: RDD, before: list[dict[str, float]]) -> dict[str, float]:
    """The sum of each ``e``'s counts in the iteration after those of ``before``: a number a word."""
    known = packed.context.broadcast(before)

    def sums(rows: Iterable[Row]) -> Iterator[tuple[str, float]]:
        for part in _parts(rows):
            if known.value:
                total = np.zeros(len(part.en))
                for e, _, c in part.counts(known.value):
                    total += np.bincount(e, c, len(part.en))
            else:
                total = part.first_totals()
            yield from zip(part.en, total.tolist(), strict=True)

    return packed.mapPartitions(sums).reduceByKey(add).collectAsMap()


def _table(packed: RDD, totals: list[dict[str, float]]) -> DataFrame:
    """``(e, f, t)`` after the iterations whose ``totals`` are given."""
    known = packed.context.broadcast(totals)

    def tables(rows: Iterable[Row]) -> Iterator[tuple[bytes]]:
        for part in _parts(rows):
            en, vi = pa.array(part.en, pa.string()), pa.array(part.vi, pa.string())
            last = np.array([known.value[-1][w] for w in part.en])
            for e, f, c in part.counts(known.value[:-1]):
                made = pa.RecordBatch.from_pydict({"e": en.take(pa.array(e)), "f": vi.take(pa.array(f)), "t": c / last[e]})
                yield (made.serialize().to_pybytes(),)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("e", pa.string()), ("f", pa.string()), ("t", pa.float64())])
        for b in batches:
            for made in b["made"]:
                yield pa.ipc.read_record_batch(made.as_buffer(), schema)

    return SparkSession.active().createDataFrame(packed.mapPartitions(tables), "made binary", verifySchema=False).mapInArrow(rows_of, "e string, f string, t double")


def english_vocabulary(entries: DataFrame) -> DataFrame:
    """``(word)``: the words of headwords and idioms, of letters a to z and apostrophes."""
    phrases = F.concat(F.array("headword_norm"), F.transform(F.coalesce("idioms", F.array()), lambda i: i["phrase"]))
    words = entries.select(F.explode(F.flatten(F.transform(phrases, lambda p: english_tokens(F.coalesce(p, F.lit("")))))).alias("word"))
    return words.filter(F.col("word").rlike("^[a-z']{1,30}$")).distinct()


def vietnamese_vocabulary(entries: DataFrame) -> DataFrame:
    """``(word)``: the syllables of all glosses."""
    of = lambda xs: F.flatten(F.transform(F.coalesce(xs, F.array()), lambda x: F.coalesce(x["glosses"], F.array().cast("array<string>"))))
    glosses = F.concat(of(F.col("senses")), of(F.col("idioms")))
    return entries.select(F.explode(F.flatten(F.transform(glosses, lambda g: split_tokens(F.coalesce(g, F.lit("")))))).alias("word")).distinct()


def vocabulary_ids(words: DataFrame) -> DataFrame:
    """``(word, id)``: ids from 1 in the order of the words; 0 is any other word."""
    return numbered(words.select("word").distinct(), ["word"], "id").select("word", (F.col("id") + 1).alias("id"))


def restricted(pairs: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """Tokenized pairs whose ``column`` has the empty word for each word not in ``words``.

    Frequent words meet a bounded broadcast. Repeated line numbers stay lines of their own.
    """
    rows = checkpointed(pairs.withColumn("_row", F.monotonically_increasing_id()))
    tokens = rows.select("_row", F.posexplode(column).alias("_at", "word"))
    known = tokens.groupBy("word").agg(F.count("*").alias("n")).join(words.select("word").distinct(), "word", "left_semi")
    mapped = lookup(tokens, checkpointed(known).withColumn("known", F.col("word")), "word", ["known"], ["_row", "_at"], "n")
    lists = mapped.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("known", F.lit(NULL_WORD)).alias("w")))), lambda x: x["w"]).alias("_mapped"))
    return rows.join(lists, "_row").withColumn(column, F.col("_mapped")).drop("_row", "_mapped")


def train(pairs: DataFrame, iterations: int = 4, most_tokens: int | None = 20, english: DataFrame | None = None, vietnamese: DataFrame | None = None) -> DataFrame:
    """``(e, f, t)`` after some iterations over all lines of at most ``most_tokens`` (None: any) a side.

    The lines are packed by parts of the ``f`` words once; an iteration moves a number an
    ``e`` word only, by which its counts become probabilities everywhere.

    With vocabularies, words outside of them are one word on either side: on the English
    side they share the empty word's row, on the Vietnamese side they are dropped at the
    end.
    """
    lines = usable_pairs(pairs, most_tokens)
    for column, words in (("en", english), ("vi", vietnamese)):
        lines = lines if words is None else restricted(lines, column, words)
    parts = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = lines.select(F.array_join(F.concat(F.array(F.lit(NULL_WORD)), "en"), SEPARATOR).alias("en"), F.array_join("vi", SEPARATOR).alias("vi"))
    # as an RDD its shuffle is made once and read by every iteration
    packed = texts.mapInArrow(_pack(parts), "part int, packed binary").repartition(parts, "part").rdd
    totals: list[dict[str, float]] = []
    for _ in range(iterations):
        totals.append(_totals(packed, totals))
    return _table(packed, totals).filter(F.col("f") != NULL_WORD)


def top_translations(table: DataFrame, k: int = 16, least: float = 0.005) -> DataFrame:
    """The likeliest translations of each word: ``(e, f, rank, q)``, q of 65,535 parts."""
    p = table.withColumn("p", F.round("t", 6)).filter((F.col("p") >= least) & (F.col("e") != NULL_WORD))
    order = Window.partitionBy("e").orderBy(F.col("p").desc(), "f")
    ranked = p.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("e", "f", "rank", quantize(F.col("p")).alias("q")).filter(F.col("q") > 0)


def score_glosses(glosses: DataFrame, lexicon: DataFrame) -> DataFrame:
    """How likely a gloss translates a word: sum of probabilities over root of its length.

    ``glosses`` is ``(id, en, gloss)``; the best of the gloss's synonyms counts.
    """
    # of a word's at most 16 translations each gloss takes its own within the row
    table = lexicon.groupBy("e").agg(F.map_from_entries(F.collect_list(F.struct("f", dequantize(F.col("q")).alias("p")))).alias("known"))
    rows = glosses.select("id", F.lower("en").alias("e"), "gloss").join(table, "e")

    def score(alt: Column) -> Column:
        tokens = split_tokens(alt)
        met = F.filter(F.transform(tokens, lambda f: F.try_element_at("known", f)), lambda p: p.isNotNull())
        return F.when(F.size(met) > 0, F.aggregate(met, F.lit(0.0), lambda x, p: x + p) / F.sqrt(F.size(tokens)))

    best = F.array_max(F.transform(gloss_alternatives(F.col("gloss")), score))
    return rows.select("id", best.alias("s")).filter(F.col("s").isNotNull()).groupBy("id").agg(F.round(F.max("s"), 6).alias("score"))


def probabilities(asked: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``asked`` = ``(en, vi)`` with the probability ``p`` of each pair, 0 where unknown."""
    table = lexicon.select(F.col("e").alias("_e"), F.col("f").alias("_f"), dequantize(F.col("q")).alias("_p"))
    out = asked.join(table, (F.lower("en") == F.col("_e")) & (F.col("vi") == F.col("_f")), "left")
    return out.select(*asked.columns, F.coalesce("_p", F.lit(0.0)).alias("p"))


def format_translations(lexicon: DataFrame) -> DataFrame:
    """One line a word: ``token(0.123)`` in order."""
    shown: Column = F.format_string("%s(%.3f)", "f", dequantize(F.col("q")))
    return lexicon.groupBy("e").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", shown.alias("s")))), lambda x: x["s"]), " ").alias("translations"))

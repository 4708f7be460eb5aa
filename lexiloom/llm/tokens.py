"""Encoding of a whole collection with a public tokenizer, shared chunks once.

Method. A rolling hash cuts texts into content-defined chunks, so that equal passages
of different documents become equal chunks wherever they stand. Eight bytes a chunk are
shuffled to count them. The chunks that save most by being shared (times their length)
are encoded once and handed to all workers as a table of bounded size; everything else,
which is what occurs once and what the table has no room for, is encoded where it
stands. No text and no ids are shuffled, whatever the size of the collection.

The ids of a document are put together from shared chunks and the stretches between
them, and every join is checked: where the two sides don't agree as they stand, it is
repaired. The pieces around it are encoded again, further and further, until the
tokenizer's own cuts in the joined text agree with those in the next part. From such a
cut on the part's ids are those of the whole text.

Why that is exact: the byte-level tokenizer first cuts a text into pieces from left to
right, and merges never cross a piece. Whether a piece ends somewhere depends on at most
two characters after it, and nothing before it. So pieces that end two characters
before a part's end stay, and two scans that cut at one place agree after it.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import spread

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.json"

#: Bytes that a chunk has at least and at most; of the clean places for a cut, one in
#: ``1 << BITS`` is taken.
SHORTEST, LONGEST, BITS = 96, 2048, 5
WINDOW = 16
#: Bytes of text that the table of shared chunks holds at most (its ids: at most four
#: bytes for each of them). A last chunk shorter than ``SHORTEST`` is not worth a place,
#: so the table has at most ``TABLE // SHORTEST`` chunks.
TABLE = 16 << 20
#: Chunk keys that a task counts before it hands the counts on.
COUNTERS = 200_000
#: Bytes of text of an output batch, or a single longer text.
BATCH = 1 << 20
#: Pieces whose ids a task keeps, before it starts over.
KNOWN = 200_000

_BLANKS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE, _SOLID = f"[{_BLANKS}]", f"[^{_BLANKS}"
#: The byte-level tokenizer's pieces, with white space spelled out.
PIECE = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?{_SOLID}\p{{L}}\p{{N}}]+|{_SPACE}+(?!{_SOLID}])|{_SPACE}+")

#: Bytes of which each is a visible character by itself.
_INK = np.zeros(256, dtype=bool)
_INK[0x21:0x7F] = True

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def _cache() -> types.ModuleType:
    """Where a Python worker keeps what it loaded, beyond one task."""
    return sys.modules.setdefault("_lexiloom_tokens", types.ModuleType("_lexiloom_tokens"))


def tokenizer(folder: str, name: str):
    """The tokenizer, loaded once per worker; special tokens' strings are plain text."""
    cache, key = _cache(), f"{folder}/{name}"
    if key not in cache.__dict__:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        t = Tokenizer.from_file(os.path.join(folder, name))
        t.encode_special_tokens = True
        cache.__dict__[key] = t
    return cache.__dict__[key]


def cuts(data: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last ``WINDOW`` bytes asks for a cut (before a byte).

    Only places where the tokenizer itself cuts in any surroundings are asked for: before
    a single space between two visible characters.
    """
    at = np.flatnonzero(data[WINDOW:-1] == 0x20) + WINDOW
    at = at[_INK[data[at - 1]] & _INK[data[at + 1]]]
    h = np.zeros(len(at), dtype=np.uint32)
    for k in range(WINDOW):  # the byte k before the last is shifted k times
        h += _GEAR[data[at - 1 - k]] << np.uint32(k)
    return at[(h >> np.uint32(32 - BITS)) == 0]


def column_chunks(texts: pa.Array) -> list[list[bytes]]:
    """The content-defined chunks of each text of a column; joined they are the text.

    The column's bytes are hashed in one go. A window that reaches into the text before
    asks for no cut, so that a text's chunks don't depend on its neighbours.
    """
    column = texts.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    first = int(bounds[0]) if len(bounds) else 0
    raw = data.slice(first, int(bounds[-1]) - first).to_pybytes() if data is not None and len(column) else b""
    wanted = cuts(np.frombuffer(raw, dtype=np.uint8)) if len(raw) > WINDOW else np.zeros(0, dtype=np.int64)
    ends = (bounds - first).tolist()
    mine = np.searchsorted(wanted, bounds - first).tolist()
    wanted = wanted.tolist()
    out: list[list[bytes]] = []
    for row, (start, stop) in enumerate(zip(ends, ends[1:], strict=False)):
        found: list[bytes] = []
        i, until = mine[row], mine[row + 1]
        while i < until and wanted[i] < start + WINDOW:
            i += 1
        while start < stop:
            while i < until and wanted[i] < start + SHORTEST:
                i += 1
            end = wanted[i] if i < until else stop
            if end - start > LONGEST:
                end = start + LONGEST
                while (raw[end] & 0xC0) == 0x80:
                    end -= 1
            found.append(raw[start:end])
            start = end
        out.append(found)
    return out


def chunks(text: str) -> list[str]:
    return [c.decode() for c in column_chunks(pa.array([text]))[0]]


def clean_join(before: str, after: str) -> bool:
    """Whether the two sides agree on the cut between them as they stand."""
    return after[0] == " " and "!" <= after[1:2] <= "~" and "!" <= before[-1] <= "~"


def chunk_key(chunk: bytes) -> int:
    """A signed 64-bit key. Equal keys of different chunks cost a place in the table only:
    ids are found by the chunk itself."""
    k = xxhash.xxh3_64_intdigest(chunk)
    return k - (1 << 64) if k >= 1 << 63 else k


def encoder(folder: str, name: str):
    """Ids of a list of texts, without special tokens."""

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer(folder, name).encode_batch_fast(texts, add_special_tokens=False)]

    return encode


class Joiner:
    """Puts a text's ids together from its parts, repairing each join."""

    def __init__(self, encode) -> None:
        self.encode = encode
        self.known: dict[str, list[int]] = {}

    def ids(self, pieces: list[str]) -> list[int]:
        """The ids of whole pieces, each different one encoded by itself."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if new:
            if len(self.known) > KNOWN:
                self.known.clear()
                new = list(dict.fromkeys(pieces))
            self.known.update(zip(new, self.encode(new), strict=True))
        return list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def whole(self, text: str) -> list[int]:
        """The ids of a text by its pieces, of which most have been met before."""
        return self.ids(PIECE.findall(text))

    def join(self, parts: list[tuple[str, list[int]]]) -> list[int]:
        """The ids of the joined texts of ``parts`` = (text, its own ids)."""
        out: list[int] = []
        run = [parts[0]]
        for part in parts[1:]:
            if clean_join(run[-1][0], part[0]):
                out += self._repair(run)
                run = [part]
            else:
                run.append(part)
        return out + self._repair(run)

    def _repair(self, parts: list[tuple[str, list[int]]]) -> list[int]:
        if len(parts) == 1:
            return parts[0][1]
        out: list[int] = []
        pending = ""  # text whose pieces the next part may still change
        for text, ids in parts:
            own = [m.span() for m in PIECE.finditer(text)]
            last = max((e for _, e in own if e <= len(text) - 2), default=0)
            repaired, meet = self._meet(pending, text, own, last) if pending else ([], 0)
            if meet is None or meet >= last:
                pending += text  # no agreement inside this part: go on with the next
                continue
            head = len(self.ids([text[a:b] for a, b in own if b <= meet]))
            tail = len(self.ids([text[a:b] for a, b in own if a >= last]))
            out += self.ids(repaired)
            out += ids[head : len(ids) - tail]
            pending = text[last:]
        return out + self.whole(pending)

    @staticmethod
    def _meet(pending: str, text: str, own: list[tuple[int, int]], last: int) -> tuple[list[str], int | None]:
        """The first place in ``text`` where both scans cut, and the pieces before it."""
        shift, pieces = len(pending), []
        ends = {0, *(e for _, e in own if e <= last)}
        for m in PIECE.finditer(pending + text):
            pieces.append(m[0])
            if m.end() - shift in ends:
                return pieces, m.end() - shift
            if m.end() - shift > last:
                break
        return [], None


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, n, bytes)``: how often a task met each chunk, counted before any shuffle."""
    counts: dict[int, list[int]] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int64()), pa.array([n for n, _ in counts.values()], pa.int32()), pa.array([b for _, b in counts.values()], pa.int32())],
            names=["key", "n", "bytes"],
        )
        counts.clear()
        return out

    for batch in batches:
        for row in column_chunks(batch.column(0)):
            for chunk in row:
                if len(chunk) < SHORTEST:
                    continue
                c = counts.get(key := chunk_key(chunk))
                if c is None:
                    counts[key] = [1, len(chunk)]
                else:
                    c[0] += 1
        if len(counts) > COUNTERS:
            yield flush()
    yield flush()


def shared_chunks(texts: DataFrame, folder: str, name: str, table: int = TABLE) -> dict[bytes, np.ndarray]:
    """The chunks that occur twice or more, with their ids, each encoded once.

    Where they don't all fit into ``table`` bytes, those that save least (occurrences
    beyond the first, times bytes) are left to be encoded where they stand. What reaches
    the driver is bounded by ``table``, not by the collection.
    """
    counts = texts.mapInArrow(_count_chunks, "key long, n int, bytes int")
    often = counts.groupBy("key").agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes")).filter(F.col("n") >= 2)
    gain = ((F.col("n") - 1) * F.col("bytes")).desc()
    best = often.orderBy(gain, "key").limit(table // SHORTEST).select("key", "bytes").toPandas()
    keys = np.sort(best["key"].to_numpy()[best["bytes"].cumsum().to_numpy() <= table])
    if not len(keys):
        return {}
    known = texts.sparkSession.sparkContext.broadcast(keys)
    encode = encoder(folder, name)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = set(known.value.tolist()), set()
        for batch in batches:
            out: dict[int, bytes] = {}
            for row in column_chunks(batch.column(0)):
                for chunk in row:
                    if len(chunk) >= SHORTEST and (key := chunk_key(chunk)) in wanted and key not in seen:
                        out[key] = chunk
                        seen.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["key", "chunk"])

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = encode([c.decode() for c in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["chunk", "ids"])

    # of chunks that share a key one is taken, the same in every run
    once = texts.mapInArrow(pick, "key long, chunk binary").groupBy("key").agg(F.min("chunk").alias("chunk")).select("chunk")
    found = once.mapInArrow(encode_chunks, "chunk binary, ids array<int>").toArrow()
    return {c: np.asarray(i, dtype=np.int32) for c, i in zip(found.column("chunk").to_pylist(), found.column("ids").to_pylist(), strict=True)}


def parts_of(text: str, row: list[bytes], table: dict[bytes, np.ndarray]) -> list[tuple[str, np.ndarray | None]]:
    """A text as shared chunks with their ids, and the stretches between without."""
    if not any(map(table.__contains__, row)):
        return [(text, None)]
    out: list[tuple[str, np.ndarray | None]] = []
    for shared, run in groupby(row, key=table.__contains__):
        out += [(c.decode(), table[c]) for c in run] if shared else [(b"".join(run).decode(), None)]
    return out


def encode_texts(texts: pa.Array, table: dict[bytes, np.ndarray], joiner: Joiner) -> list[list[int]]:
    """The ids of whole texts; empty lists of null and empty ones."""
    values = texts.to_pylist()
    rows = column_chunks(texts) if table else [()] * len(values)
    out = []
    for text, row in zip(values, rows, strict=True):
        parts = parts_of(text, row, table) if text else []
        out.append(joiner.join([(p, joiner.whole(p) if ids is None else ids.tolist()) for p, ids in parts]) if parts else [])
    return out


def encoded(documents: DataFrame, keep: list[str], lengths: bool = False, folder: str = TOKENIZER_DIR, name: str = TOKENIZER, table: int = TABLE) -> DataFrame:
    """The columns ``keep`` and the ``ids`` of every text, or their number ``n_tokens``.

    Null and empty texts have none. Every row comes out once, repeated rows and repeated
    ids too; a text of any length is encoded whole. A passage that a third of the
    documents share is encoded once.
    """
    docs = spread(documents.select(*keep, "text"))
    texts = documents.select("text").filter(F.length("text") > SHORTEST // 4)
    shared: Broadcast = documents.sparkSession.sparkContext.broadcast(shared_chunks(texts, folder, name, table))
    encode = encoder(folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner(encode)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                before = int(sizes[start - 1]) if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, before + BATCH, "right")))
                part = batch.slice(start, end - start)
                ids = encode_texts(part.column(part.num_columns - 1), shared.value, joiner)
                made = pa.array([len(x) for x in ids], pa.int64()) if lengths else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*keep, "n_tokens" if lengths else "ids"])
                start = end

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{kinds}, {'n_tokens long' if lengths else 'ids array<int>'}")


def token_ids(documents: DataFrame, folder: str = TOKENIZER_DIR, name: str = TOKENIZER, table: int = TABLE) -> DataFrame:
    """``(doc_id, ids)``: the ids of every text, without special tokens.

    Null and empty texts have an empty list. Repeated rows and repeated ``doc_id`` come
    out as often as they came in.
    """
    return encoded(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], False, folder, name, table)


def token_counts(documents: DataFrame, keep: list[str], folder: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` of every row and ``n_tokens``, by the same encoder."""
    return encoded(documents, keep, True, folder, name)

"""Unigram subword encoding with a scored vocabulary, and guards of generation."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import chain
from math import log

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A public model of scored pieces.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_SCORE = -100.0
MARK = "▁"


def read_vocabulary(lines: list[str]) -> dict[str, tuple[int, float]]:
    """Pieces of ``piece TAB score`` lines; ids count the lines that have a tab."""
    out: dict[str, tuple[int, float]] = {}
    number = 0
    for line in lines:
        piece, tab, score = line.rpartition("\t")
        if tab:
            out.setdefault(piece, (number, float(score)))
            number += 1
    return out


def model_lines(path: str = MODEL) -> list[str]:
    """The scored pieces of a public model as lines, in the order of their ids.

    A model of merges scores its pieces by their rank, below the score of an unknown
    character; by Zipf's law the logarithm of the rank stands for that of the frequency.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    scores = [model.get_score(i) for i in range(model.get_piece_size())]
    if min(scores) < UNKNOWN_SCORE:
        scores = [-log(1 - x) for x in scores]
    return [f"{model.id_to_piece(i)}\t{x}" for i, x in enumerate(scores)]


def word_encoder(vocabulary: dict[str, tuple[int, float]], unknown: int) -> Callable[[str], tuple[int, ...]]:
    """The ids of a word's best-scoring pieces; words met before are remembered."""
    longest = max(map(len, vocabulary), default=1)

    @lru_cache(maxsize=100_000)
    def run(word: str) -> tuple[int, ...]:
        s = MARK + word
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)]  # score, start of the last piece, its id
        for j in range(1, len(s) + 1):
            options = [(best[i][0] + vocabulary[s[i:j]][1], i, vocabulary[s[i:j]][0]) for i in range(max(0, j - longest), j) if s[i:j] in vocabulary]
            if (j - 1, j) not in {(i, j) for _, i, _ in options}:
                options.append((best[j - 1][0] + UNKNOWN_SCORE, j - 1, unknown))
            best.append(max(options, key=lambda o: o[0]))
        pieces, j = [], len(s)
        while j > 0:
            _, i, piece = best[j]
            pieces.append(piece)
            j = i
        return tuple(reversed(pieces))

    return run


def encode(text: str | None, vocabulary: dict[str, tuple[int, float]], unknown: int, end: int) -> list[int]:
    """The ids of the best-scoring pieces of each word, and the end mark."""
    one = word_encoder(vocabulary, unknown)
    return [*chain.from_iterable(map(one, (text or "").split())), end]


def decode(ids: list[int], pieces: list[str], skip: set[int]) -> str:
    return "".join(pieces[i] for i in ids if 0 <= i < len(pieces) and i not in skip).replace(MARK, " ").strip()


def repeated_ngram_bans(ids: list[int], n: int = 3) -> set[int]:
    """The ids that would repeat an n-gram of what is generated already."""
    if len(ids) < n - 1:
        return set()
    tail = ids[len(ids) - n + 1 :]
    return {ids[i + n - 1] for i in range(len(ids) - n + 1) if ids[i : i + n - 1] == tail}


def encoder(vocabulary: dict[str, tuple[int, float]], unknown: int, end: int) -> Callable:
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        one = word_encoder(vocabulary, unknown)
        return texts.map(lambda t: [*chain.from_iterable(map(one, (t or "").split())), end])

    return run

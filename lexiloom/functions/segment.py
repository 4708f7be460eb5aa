"""Cutting text into tokens, sentences and pieces: sequential, hence Arrow functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.tables import ABBREVIATIONS

# A link; e.g. and i.e.; a word with inner marks and numbers with inner separators; the rest.
_TOKEN = re.compile(
    r"(?P<link>(?:https?://|www\.)\S*)"
    r"|(?P<short>(?i:e\.g\.|i\.e\.)(?![^\W_]))"
    r"|(?P<word>[^\W_](?:[^\W_]|(?<=\d)[.,:/](?=\d)|['’-](?=[^\W_]))*)"
    r"|(?P<gap>(?:[\W_])+)"
)
_TRAILING = ".,;:!?)\"'”’"


def tokenize(text: str | None) -> list[tuple[str, int, int, bool]]:
    """Tokens ``(text, start, end, is_word)`` that tile the text without loss."""
    out: list[tuple[str, int, int, bool]] = []
    at, text = 0, text or ""
    while at < len(text):
        m = _TOKEN.match(text, at)
        end = m.end()
        if m.lastgroup == "link":
            while end > at + 1 and text[end - 1] in _TRAILING:
                end -= 1
        out.append((text[at:end], at, end, m.lastgroup != "gap"))
        at = end
    return out


_STOP = re.compile(r"[.!?…][.!?…\"')\]”’]*(?=\s+(\S))|\n")
_OPENING = "\"'([“‘"


def split_sentences(text: str | None) -> list[str]:
    """Sentences in order, stripped. A line end always ends one.

    Marks end a sentence if white space and an opening follow: a capital, a digit, a
    quote or bracket. A full stop doesn't after an abbreviation or a lone capital.
    """
    out, start, s = [], 0, (text or "").strip()
    for m in _STOP.finditer(s):
        if m[0] != "\n":
            following = m[1]
            if not (following.isupper() or following.isdigit() or following in _OPENING):
                continue
            if m[0][0] == ".":
                word = re.split(r"\s", s[start : m.start()])[-1].lstrip("\"'([“‘")
                if (len(word) == 1 and word.isupper()) or word.lower() in ABBREVIATIONS:
                    continue
        out.append(s[start : m.end()].strip())
        start = m.end()
    return [p for p in (*out, s[start:].strip()) if p]


def split_long(sentence: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters, cut after a comma, semicolon or colon."""
    out, rest = [], sentence.strip()
    while len(rest) > most:
        places = [m.start() for m in re.finditer(r"[,;:](?=\s)", rest[: most + 2]) if most // 2 < m.start() <= most]
        if not places:
            break
        out.append(rest[: places[-1] + 1].strip())
        rest = rest[places[-1] + 1 :].strip()
    return [*out, rest] if rest else out


TOKEN_TYPE = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("is_word", T.BooleanType())]))


@F.pandas_udf(TOKEN_TYPE)
def tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("text", "start", "end", "is_word"), x, strict=True)) for x in tokenize(t)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(texts: pd.Series) -> pd.Series:
    return texts.map(split_sentences)


def pieces(most: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else split_long(t, most))

    return run

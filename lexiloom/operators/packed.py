"""Several values packed in one field, split into one value per row.

A field's *skeleton* is its text with every run of words masked, blanks between them
included. Fields that are packed alike share a skeleton, so how to split is resolved once
per distinct skeleton. The frequent skeletons' rules are broadcast (a bounded number of
bounded size); a field of another skeleton has its rule resolved where it stands, once
per worker. So no field is ever shuffled, however often its skeleton occurs. The values
are then taken by position.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.session import checkpointed, spread

#: Characters that can separate, wrap, escape or number values.
SPECIAL = r",;/|·•\t\n\r\"'“”«»‘’()\[\]{}（）［］【】\\*\-–—.:=，；、／｜；"
BLANK = r" \u00a0\u2000-\u200a\u202f\u205f\u3000"
_WORD = rf"[^{SPECIAL}\p{{N}}{BLANK}]"
#: Fields without any of these hold one value at most.
SEPARATES = r"[,;/|·•\t\n\r，；、／｜]|\d[.)]|\]\s*\[|(?:^|\s)[-*–—]\s"
#: The commonest units. One beside a slash is a token of its own.
UNIT = "km|m|cm|mm|dm|g|kg|mg|l|ml|h|s|min|ha|lít|giờ|phút|giây|đồng|usd|vnd|v|w|kw|hz|pa"
_SLASH = "[/／]"
_UNIT = rf"(?iu:(?<!{_WORD})(?:{UNIT})(?={_SLASH})|(?<={_SLASH})(?:{UNIT})(?!{_WORD}))"
#: A token is a unit beside a slash, a run of words, digits or blanks, or one special character.
TOKEN = rf"([\p{{N}}]+|[{BLANK}]+|[{SPECIAL}]|{_WORD}+(?:[{BLANK}]+{_WORD}+)*)"
_TOKEN_BY_SLASH = rf"({_UNIT}|[\p{{N}}]+|[{BLANK}]+|[{SPECIAL}]|{_WORD}+(?:[{BLANK}]+(?!{_UNIT}){_WORD}+)*)"

#: Most skeletons whose rules are broadcast, and the longest of them: a skeleton has at most
#: half as many values as characters, so that the broadcast stays under 64 MB.
BROADCAST_RULES, BROADCAST_LENGTH = 20_000, 200
#: Rows that a skeleton has at least to be broadcast.
FREQUENT = 4

OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】"}
QUOTES = {'"': '"', "“": "”", "«": "»"}
HARD = set(";|·•\t\n\r；｜、,，/／")


def tokens_of(text: Column) -> Column:
    some = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(text.rlike(_SLASH), some(_TOKEN_BY_SLASH)).otherwise(some(TOKEN))


def skeleton_of(text: Column) -> Column:
    """One character per token: ``w`` words, ``u`` unit, ``9`` number, blank, or itself.

    A run of one or two digits may number an item: it is ``1``, longer ones are ``9``.
    """
    # stand-ins that are no text's own, so that what is masked isn't masked again
    out = F.translate(text, "\ufdd3\ufdd4\ufdd5", "\ufdd6\ufdd6\ufdd6")
    out = F.when(text.rlike(_SLASH), F.regexp_replace(out, _UNIT, "\ufdd3")).otherwise(out)
    word = rf"[^{SPECIAL}\p{{N}}{BLANK}\ufdd3]+"
    out = F.regexp_replace(out, rf"{word}(?:[{BLANK}]+{word})*", "w")
    out = F.regexp_replace(F.regexp_replace(out, r"\p{N}{3,}", "\ufdd4"), r"\p{N}{1,2}", "\ufdd5")
    return F.translate(F.regexp_replace(out, rf"[{BLANK}]+", " "), "\ufdd3\ufdd4\ufdd5", "u91")


def _matching(s: str) -> dict[int, int]:
    """Where each opening bracket or quote that is closed is closed; escapes aside."""
    out: dict[int, int] = {}
    stack: list[int] = []
    i = 0
    while i < len(s):
        c = s[i]
        if c == '"':
            if i and s[i - 1] == "\\":  # escaped
                i += 1
                continue
            end = _quote_end(s, i)
            if end is not None:
                out[i] = end
                i = end + 1
                continue
        elif c in QUOTES:
            end = s.find(QUOTES[c], i + 1)
            if end > 0:
                out[i] = end
                i = end + 1
                continue
        elif c in OPEN:
            stack.append(i)
        elif stack and c == OPEN[s[stack[-1]]]:
            out[stack.pop()] = i
        elif stack and c in OPEN.values():
            for k in range(len(stack) - 1, -1, -1):
                if OPEN[s[stack[k]]] == c:
                    out[stack[k]] = i
                    del stack[k:]
                    break
        i += 1
    return out


def _quote_end(s: str, start: int) -> int | None:
    """The closing quote of one that opens at ``start``; doubled and escaped ones pass."""
    if start and s[start - 1] not in " ,;/|·•\t\n\r([{*-–—，；、／｜." and s[start - 1] != "\\":
        return None  # in the middle of a word: an inch mark or the like
    i = start + 1
    while i < len(s):
        if s[i] == "\\" and i + 1 < len(s):
            i += 2
        elif s[i] == '"':
            if i + 1 < len(s) and s[i + 1] == '"':
                i += 2
                continue
            return i
        else:
            i += 1
    return None


_MARK = re.compile(r"[ \t]*(?:(?:[(\[]?1[)\].]|[*•·–—-])(?=[ \t\w\"“«(\[])[ \t]*)+")
_NUMBERED = re.compile(r"(?:(?<=^)|(?<=[\s;,；，/|]))(?:\(1\)|\[1\]|1[.)])(?= )")


def resolve(s: str) -> list[tuple[int, int, str]]:
    """The values of a skeleton: ``(first token, end token, how it is unescaped)``.

    ``how`` is ``""``, ``doubled`` (``""`` is a quote) or ``backslash``. Empty values are
    left out. Separators in brackets, quotes, numbers or units don't separate.
    """
    lo, hi = _strip(s, 0, len(s))
    matching = _matching(s)
    # a list in brackets: its items are the values
    if lo < hi and s[lo] in "[［【" and matching.get(lo) == hi - 1 and ('"' in s[lo:hi] or re.search(r"[,;|]", s[lo:hi])):
        inner = _split(s, lo + 1, hi - 1, matching)
        if len(inner) > 1:
            return [v for v in (_value(s, a, b, matching) for a, b in inner) if v]
    return [v for v in (_value(s, a, b, matching) for a, b in _split(s, 0, len(s), matching)) if v]


def _strip(s: str, a: int, b: int) -> tuple[int, int]:
    while a < b and s[a] in " \t\n\r":
        a += 1
    while b > a and s[b - 1] in " \t\n\r":
        b -= 1
    return a, b


def _split(s: str, a: int, b: int, matching: dict[int, int]) -> list[tuple[int, int]]:
    """The stretches between separators at the top level."""
    numbered = {m.start() for m in _NUMBERED.finditer(s, a, b)}
    # inline list numbers separate if there are several, or one after a separator
    if len(numbered) < 2:
        numbered = set()
    bullets = {m.start(1) for m in re.finditer(r"(?:^|(?<=[ \n\r\t]))([•*])(?= )", s[a:b])}
    out, start, i = [], a, a
    while i < b:
        if i in numbered and i > start:
            out.append((start, i))
            start = i
        c = s[i]
        if i in matching and i not in numbered:
            i = matching[i] + 1
            continue
        if c in HARD and not _inside(s, i):
            out.append((start, i))
            start = i + 1
        elif c == "*" and i - a in bullets and i > start:
            out.append((start, i))
            start = i
        i += 1
    return [*out, (start, b)]


def _inside(s: str, i: int) -> bool:
    """Whether the sign at ``i`` belongs to a number or a unit."""
    before, after = s[i - 1] if i else "", s[i + 1] if i + 1 < len(s) else ""
    if s[i] in ",/／，" and before in "19" and after in "19" and before and after:
        return True
    if s[i] in "/／" and before and after and (before in "u19") and (after in "u"):
        return True
    return False


def _value(s: str, a: int, b: int, matching: dict[int, int]) -> tuple[int, int, str] | None:
    """A stretch without what is around its value; None where nothing is left."""
    how = ""
    while True:
        old = (a, b)
        a, b = _strip(s, a, b)
        m = _MARK.match(s, a, b)
        if m and m.end() > a and m.end() < b:
            a = m.end()
        if a < b and matching.get(a) == b - 1:
            if s[a] == '"':
                inner = s[a + 1 : b - 1]
                how = "backslash" if '\\"' in inner else "doubled" if '""' in inner else how
                a, b = a + 1, b - 1
            elif s[a] in QUOTES or s[a] in OPEN:
                a, b = a + 1, b - 1
        if (a, b) == old:
            break
    a, b = _strip(s, a, b)
    if a >= b or not any(c in "wu19" for c in s[a:b]):
        # a value of signs alone is one only if it isn't a mark or separator
        if not any(c not in " \t\n\r*•·–—-.,;/|\"" for c in s[a:b]):
            return None
    return a, b, how


_RULE = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("how", T.StringType())]))


@lru_cache(maxsize=50_000)
def _rule(skeleton: str) -> list[dict]:
    return [{"a": a, "b": b, "how": h} for a, b, h in resolve(skeleton)]


@F.pandas_udf(_RULE)
def _rules(skeletons: pd.Series) -> pd.Series:
    return skeletons.map(_rule, na_action="ignore").astype(object)


def extract(tokens: Column, rule: Column) -> Column:
    """The values of a field by its skeleton's rule."""

    def one(r: Column) -> Column:
        raw = F.array_join(F.slice(tokens, r["a"] + 1, r["b"] - r["a"]), "")
        return F.when(r["how"] == "doubled", F.replace(raw, F.lit('""'), F.lit('"'))).when(r["how"] == "backslash", F.regexp_replace(raw, r"\\(.)", "$1")).otherwise(raw)

    return F.transform(rule, one)


def packed_values(fields: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``(*keys, value_pos, value, n_values)``: one row per value of ``fields[column]``.

    Null and blank fields have no values and give no rows; a field without separators
    gives one. Repeated rows are kept. Fields of any length are split whole.
    """
    texts = spread(fields).filter(F.col(column).rlike(r"\S")).select(*keys, F.col(column).alias("_text")).withColumn("_skeleton", skeleton_of(F.col("_text")))
    short = texts.filter(F.length("_skeleton") <= BROADCAST_LENGTH)
    often = short.groupBy("_skeleton").agg(F.count("*").alias("_n")).filter(F.col("_n") >= FREQUENT).orderBy(F.col("_n").desc(), "_skeleton").limit(BROADCAST_RULES)
    # a bounded number of rows, resolved once and kept in the shared folder
    rules = checkpointed(often.select(F.col("_skeleton").alias("_known"), _rules("_skeleton").alias("_common")))
    both = texts.join(F.broadcast(rules), F.col("_skeleton") == F.col("_known"), "left")
    rare = _rules(F.when(F.col("_known").isNull(), F.col("_skeleton")))
    # a column of its own, lest the tokens are made anew for each value
    both = both.select(*keys, F.coalesce("_common", rare).alias("_rule"), tokens_of(F.col("_text")).alias("_tokens"))
    values = extract(F.col("_tokens"), F.col("_rule"))
    return both.select(*keys, F.size("_rule").alias("n_values"), F.posexplode(values).alias("value_pos", "value")).select(*keys, "value_pos", "value", "n_values")


def gloss_fields(entries: DataFrame) -> DataFrame:
    """``(entry_id, sense_no, gloss_no, gloss)`` of all senses."""
    senses = entries.select("entry_id", F.posexplode("senses").alias("sense_no", "s"))
    return senses.select("entry_id", "sense_no", F.posexplode("s.glosses").alias("gloss_no", "gloss"))


def packed_glosses(entries: DataFrame) -> DataFrame:
    """The values of the glosses that hold two or more."""
    fields = gloss_fields(entries).filter(F.col("gloss").rlike(SEPARATES))
    return packed_values(fields, ["entry_id", "sense_no", "gloss_no"], "gloss").filter(F.col("n_values") >= 2)

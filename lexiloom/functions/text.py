"""Text functions as column expressions; none of them leaves the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.tables import IRREGULAR, PAST_FORMS, VIETNAMESE_LETTERS

#: White space, without the no-break kinds (U+00A0, U+2007, U+202F).
SPACES = r"[\s\x1C-\x1F\p{Z}&&[^\u00A0\u2007\u202F]]+"


def _fold_table() -> tuple[str, str]:
    """Every precomposed letter that is a base letter with marks, and that letter."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        base = unicodedata.normalize("NFC", base)
        if len(base) == 1 and base != ch:
            source.append(ch)
            target.append(base)
    return "".join(source) + "đĐ", "".join(target) + "dD"


FOLD_FROM, FOLD_TO = _fold_table()


def collapse_spaces(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, r"^\x{FEFF}", "")


#: Marks that compose with a letter: a text without any is in NFC already, but for a few
#: letters that decompose on their own.
MARKS = r"[\u0300-\u036f\u0653-\u0655\u093c\u09be\u09d7\u1100-\u11ff\u3099\u309a\u212a\u212b\u2126\u0340-\u0344]"


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """With precomposed letters; only texts that hold marks leave the JVM."""
    return F.coalesce(_nfc(F.when(text.rlike(MARKS), text)), text)


def normalize_headword(raw: Column, composed: bool = False) -> Column:
    """The form under which headwords are looked up, in NFC; null gives the empty text.

    ``composed``: the text is known to be in NFC.
    """
    text = F.regexp_replace(strip_bom(F.coalesce(raw, F.lit(""))), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    out = F.lower(collapse_spaces(F.replace(text, F.lit("_"), F.lit(" "))))
    return out if composed else nfc(out)


def remove_diacritics(text: Column) -> Column:
    """Without accents, đ as d; marks that stand alone are dropped; null gives empty."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Mn}+", ""), FOLD_FROM, FOLD_TO)


def normalize_vietnamese(text: Column) -> Column:
    return remove_diacritics(F.lower(F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")))


def split_tokens(text: Column) -> Column:
    """Maximal runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))


def english_tokens(text: Column) -> Column:
    """Corpus words of the English side: letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}']+)"), F.lit(1))


def gloss_alternatives(gloss: Column) -> Column:
    """The synonyms of a gloss line, without bracketed remarks."""
    bare = F.regexp_replace(F.regexp_replace(gloss, r"\([^)]*\)", " "), r"\[[^\]]*\]", " ")
    return F.filter(F.transform(F.split(bare, "[,;]"), collapse_spaces), lambda a: a != "")


def shorten(gloss: Column) -> Column:
    """The first synonym, or the collapsed line; null gives empty."""
    return F.coalesce(F.get(gloss_alternatives(gloss), F.lit(0)), collapse_spaces(gloss), F.lit(""))


def is_junk_gloss(gloss: Column) -> Column:
    return gloss.isNull() | ~gloss.rlike(r"\S") | gloss.contains("<")


def looks_vietnamese(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(f"[{VIETNAMESE_LETTERS}]"), F.lit(False))


def looks_like_sentence(text: Column, least: int = 4) -> Column:
    return F.size(F.split(F.trim(text), r"\s+")) >= least


def word_count(norm: Column) -> Column:
    return F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1)


def trigrams(text: Column) -> Column:
    """All letter triples of the padded text, repeated ones too; empty gives none."""
    padded = F.concat(F.lit("$$"), text, F.lit("$$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(F.length(text) > 0, grams).otherwise(F.array().cast("array<string>"))


def set_jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25(idf: Column, tf: Column, length: Column, average: Column, k1: float = 1.2, b: float = 0.2) -> Column:
    """Term score; ``b`` is low since dictionary entries of many senses aren't verbose."""
    return idf * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / average))


def bm25_boost(whole_gloss: Column, in_primary: Column, single_word: Column, headword_length: Column) -> Column:
    """Factors for a hit that is a whole gloss, in the first gloss, of one short word."""
    out = F.lit(1.0)
    for holds, factor in ((whole_gloss, 3.0), (in_primary, 1.8), (single_word, 1.4), (headword_length <= 6, 1.2)):
        out = out * F.when(holds, F.lit(factor)).otherwise(F.lit(1.0))
    return out


def quantize(p: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(65535), F.round(p * F.lit(65535.0)))).cast("int")


def dequantize(q: Column) -> Column:
    return q / F.lit(65535.0)


def sanitize_query(text: Column, most: int = 5000) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"[\t\r\n]+", " ")), F.lit(most))


def paste_normalize(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*[\r\n]+\s*", " ")


def describe_time(epoch: Column, this_year: int) -> Column:
    ts = F.timestamp_seconds(epoch)
    return F.when(F.year(ts) == this_year, F.date_format(ts, "dd/MM HH:mm")).otherwise(F.date_format(ts, "dd/MM/yyyy HH:mm"))


def subtitle_clean(text: Column) -> Column:
    """Without style tags and the dash of a dialogue line, with a full stop at the end."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"\{\\[^}]*\}", ""), r"^\s*[-–—]\s*", ""))
    return F.when(bare.rlike(r"[.!?…]$") | (bare == ""), bare).otherwise(F.concat(bare, F.lit(".")))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _stems(stem: Column) -> Column:
    """What a word may come from once its ending is cut: undoubled, bare, with an e."""
    last, before = F.substring(stem, -1, 1), F.substring(stem, -2, 1)
    doubled = (F.length(stem) >= 3) & (last == before) & ~last.rlike("[aeiouyslfz]")
    some = F.when(doubled, F.array(stem.substr(F.lit(1), F.length(stem) - 1), stem, F.concat(stem, F.lit("e")))).otherwise(F.array(stem, F.concat(stem, F.lit("e"))))
    return F.when(F.length(stem) >= 2, some).otherwise(F.array().cast("array<string>"))


def lemma_candidates(word: Column) -> Column:
    """Base forms a word may have, likeliest first, the word itself left out."""
    w = F.lower(word)
    n = F.length(w)
    none = F.array().cast("array<string>")

    def cut(k: int, tail: str = "") -> Column:
        return F.concat(w.substr(F.lit(1), n - k), F.lit(tail))

    # ending, least length, what it gives
    rules = (
        (w.endswith("ies") & (n > 4), F.array(cut(3, "y"))),
        (w.endswith("ied") & (n > 4), F.array(cut(3, "y"))),
        (w.endswith("ing"), _stems(cut(3))),
        (w.endswith("ed"), F.concat(_stems(cut(2)), F.array(cut(1)))),
        (w.endswith("es") & (n > 3), F.array(cut(2), cut(1))),
        (w.endswith("s") & ~w.endswith("ss") & (n > 3), F.array(cut(1))),
        (w.endswith("ly") & (n > 4), F.array(cut(2), cut(2, "e"))),
        (w.endswith("est") & (n > 5), _stems(cut(3))),
        (w.endswith("er") & (n > 4), _stems(cut(2))),
    )
    known = irregular(w)
    found = F.concat(F.when(known.isNotNull(), F.array(known)).otherwise(none), *[F.when(c, v).otherwise(none) for c, v in rules])
    return F.when(n >= 3, F.array_remove(F.array_distinct(found), w)).otherwise(none)


def irregular(word: Column) -> Column:
    """The base form of an irregular word; null of others."""
    return F.element_at(_map(IRREGULAR), F.lower(word))


def lemma(word: Column) -> Column:
    """The base form: the irregular one, else the first candidate, else the word itself."""
    return F.coalesce(irregular(word), F.get(lemma_candidates(word), F.lit(0)), F.lower(word))


def contains_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def is_past_form(word: Column) -> Column:
    w = F.lower(word)
    return (F.length(w) >= 3) & (w.isin(sorted(PAST_FORMS)) | (w.endswith("ed") & (F.length(w) > 3)))


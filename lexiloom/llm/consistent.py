"""Visually identical text with different characters.

Every text is brought to one *consistent form*: precomposed accents (NFC), ordinary
letters of the word's own script, ordinary spaces, nothing invisible.

Method. Each letter resolves to the set of scripts in which something that looks like
it exists. The sets are intersected over a word: a word that mixes scripts is respelled
in the script that is left (the one that dominates the text if several are). A word
wholly of one script is kept, even where each of its letters has a look-alike
elsewhere; column ``confusable`` reports those. What remains is normalized:
full-width and ligature forms, spaces, invisible characters, accents.

Texts made of ordinary characters only (one JVM regular expression decides) never
reach Python; of the others each distinct word is resolved once per worker.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters, by what confusables lists (Unicode Technical Standard 39)
# agree on. Each string pair lists letters of one script over the Latin letters that they
# look like, in the same order; the last lists Greek letters over Cyrillic ones that no
# Latin letter looks like.
CYRILLIC = ("аекорстухіјѕһԁԛԝѵгьӏ" + "АВЕКМНОРСТУХІЈЅҺԀԚԜѴҮӀ", "aekopctyxijshdqwvrbl" + "ABEKMHOPCTYXIJSHDQWVYI")
GREEK = ("αιοκνρυχγτσωηϳϲ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "aiokvpuxytownjc" + "ABEZHIKMNOPTYXCJ")
ARMENIAN = ("օսհոցզյԁ" + "ՕՍԼՏ", "ouhngqjd" + "OULS")
CHEROKEE = ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃᎡᏔ", "ABCDEGHJKLMPRSTVWZRW")
LISU = ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU")
GREEK_CYRILLIC = ("φπκΓΛΠΦ", "фпкГЛПФ")
# Odd letters of the Latin script over the ordinary ones; the second kind
# belongs to other languages and is odd in Vietnamese text only.
LATIN_ODD = {"ɑ": "a", "ɡ": "g"}
LATIN_FOREIGN = {"ı": "i", "ſ": "s", "ɩ": "i", "ꞵ": "ß", "Ð": "Đ", "Ɖ": "Đ", "ð": "đ", "ɖ": "đ"}
# Ignorable code points outside the general category Cf.
IGNORABLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)}

MARKS = r"\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff"
WORD = re.compile(rf"(?:[^\W\d_][{MARKS}]*)+")
#: Compatibility forms of these kinds are ordinary characters in another dress.
FORMS = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")

#: Characters that never need work: a text of these alone is in the consistent form.
PLAIN = (
    r"\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u00cf\u00d1-\u0130\u0134-\u013e\u0141-\u0148\u014a-\u017e"
    r"\u01a0\u01a1\u01af\u01b0\u1ea0-\u1ef9\u2010\u2012-\u2015\u2018-\u2022\u2026\u2030\u2032\u2033"
    r"\u2070-\u209c\u20ab\u2122\u2150-\u215f"
)
SUSPECT = rf"[^{PLAIN}]"


def _classes() -> dict[str, dict[str, str]]:
    """Per letter the letters that look like it, by script."""
    twins: dict[str, dict[str, str]] = {}
    for script, (theirs, ours) in {"CYRILLIC": CYRILLIC, "GREEK": GREEK, "ARMENIAN": ARMENIAN, "CHEROKEE": CHEROKEE, "LISU": LISU}.items():
        for t, o in zip(theirs, ours, strict=True):
            look = twins.setdefault(o, {"LATIN": o})
            look.setdefault(script, t)
            twins[t] = look
    for g, c in zip(*GREEK_CYRILLIC, strict=True):
        if g in twins or c in twins:
            continue  # by way of their Latin letter
        twins[g] = twins[c] = {"GREEK": g, "CYRILLIC": c}
    return twins


TWINS = _classes()
#: The Latin letter that a letter of another script looks like.
LATIN = {c: look["LATIN"] for c, look in TWINS.items() if look.get("LATIN", c) != c}
#: Letters with marks that Vietnamese alone uses.
VIETNAMESE = re.compile("[ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệịỉĩọỏốồổỗộớờởỡợụủũứừửữựỵỷỹ]", re.IGNORECASE)


@lru_cache(maxsize=65536)
def script_of(ch: str) -> str:
    """The script of a letter, read from its Unicode name."""
    name = unicodedata.name(ch, "")
    if "SMALL CAPITAL" in name and "\u1d00" <= ch <= "\u1d22":
        return "SMALL CAPITAL"
    return "LATIN" if name.startswith(("LATIN", "MODIFIER LETTER")) else name.split(" ", 1)[0] if name else "?"


def spellings(ch: str) -> dict[str, str]:
    """The resolved script set of a base letter: script -> how it is spelled there."""
    out = {script_of(ch): ch}
    form = unicodedata.decomposition(ch)
    if unicodedata.category(ch) == "Nl" and form.startswith("<compat>"):  # a numeral made of a letter
        out["LATIN"] = unicodedata.normalize("NFKC", ch)
    if "SMALL CAPITAL" in unicodedata.name(ch, "") and len(name := unicodedata.name(ch).split()[-1]) == 1:
        out["LATIN"] = name.lower()
    for script, letter in TWINS.get(ch, {}).items():
        out.setdefault(script, letter)
    return out


def _ipa(word: str) -> bool:
    """Whether a word is a phonetic transcription, in which odd letters are meant."""
    return any(("ɐ" <= c <= "ʯ" and c not in "ɑɡɩɖ") or c in "ˈˌː" for c in word)


@lru_cache(maxsize=200_000)
def respell(word: str, dominant: str, vietnamese: bool = False) -> str:
    """A word (letters with marks) in its own script; ``dominant`` settles ties.

    In a text that is ``vietnamese``, and in a word that mixed scripts, letters of other
    languages' Latin are odd, too.
    """
    base = unicodedata.normalize("NFD", word)
    letters = [c for c in base if unicodedata.category(c)[0] != "M"]
    scripts = Counter(script_of(c) for c in letters)
    mixed = len(scripts) > 1
    if mixed:
        sets = [spellings(c) for c in letters]
        common = set(sets[0]).intersection(*sets[1:])
        if not common:  # no script fits all: the commonest one takes what it can
            common = {max(scripts, key=lambda s: (scripts[s], s == "LATIN", s))}
        target = dominant if dominant in common else max(common, key=lambda s: (scripts[s], s == "LATIN", s))
        base = "".join(c if unicodedata.category(c)[0] == "M" else spellings(c).get(target, c) for c in base)
    if not _ipa(base):
        # before composing, for a letter such as a dotless i carries its own marks
        odd = LATIN_ODD | LATIN_FOREIGN if mixed or vietnamese or VIETNAMESE.search(unicodedata.normalize("NFC", base)) else LATIN_ODD
        base = "".join(odd.get(c, c) for c in base)
    return unicodedata.normalize("NFC", base)


@lru_cache(maxsize=65536)
def _fold(ch: str) -> str:
    """A character without its dress; empty where it is invisible."""
    code, kind = ord(ch), unicodedata.category(ch)
    if ch in "\t\n\r ":
        return ch
    if kind == "Zs":
        return " "
    if kind in ("Zl", "Zp") or ch in "\x0b\x0c\x85":
        return "\n"
    if kind in ("Cf", "Cc") or code in IGNORABLE:
        return ""
    form = unicodedata.decomposition(ch)
    if form.startswith(FORMS) or (form.startswith("<compat>") and kind in ("Ll", "Lu", "Lt")):
        return "".join(_fold(c) for c in unicodedata.normalize("NFKC", ch))
    return ch


def consistent(text: str | None) -> str | None:
    """The consistent form of a text; null stays null."""
    if text is None:
        return None
    folded = unicodedata.normalize("NFC", "".join(map(_fold, text)))
    if folded.isascii():
        return folded
    # letters that could be Latin in disguise say nothing about the text's own script
    scripts = Counter(script_of(c) for c in unicodedata.normalize("NFD", folded) if c.isalpha() and c not in LATIN)
    dominant = max(scripts, key=lambda s: (scripts[s], s == "LATIN", s)) if scripts else "LATIN"
    vietnamese = VIETNAMESE.search(folded) is not None
    return unicodedata.normalize("NFC", WORD.sub(lambda m: m[0] if m[0].isascii() else respell(m[0], dominant, vietnamese), folded))


def whole_script_confusable(word: str) -> bool:
    """Whether a word wholly of a script other than Latin could be read as Latin."""
    letters = [c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c)[0] != "M"]
    own = {script_of(c) for c in letters}
    return len(own) == 1 and own != {"LATIN"} and all(c in LATIN for c in letters)


def has_confusable(text: str) -> bool:
    """Whether any word of a text is a whole-script confusable."""
    return any(whole_script_confusable(m[0]) for m in WORD.finditer(text) if not m[0].isascii())


@F.pandas_udf(T.BooleanType())
def _confusable_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t is not None and has_confusable(t)).astype(bool)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [m[0] for m in WORD.finditer(consistent(t)) if not m[0].isascii() and whole_script_confusable(m[0])], na_action="ignore").astype(object)


#: Not repeated by the optimizer where a filter and a projection use the same result.
_confusable_words = _words_udf.asNondeterministic()


@F.pandas_udf(T.StringType())
def _consistent_udf(texts: pd.Series) -> pd.Series:
    return texts.map(consistent, na_action="ignore")


#: Not repeated by the optimizer where a filter and a projection use the same result.
_consistent_once = _consistent_udf.asNondeterministic()


def suspect(text: Column) -> Column:
    """Whether a text holds any character outside the plain set (null: false)."""
    return F.coalesce(text.rlike(SUSPECT), F.lit(False))


def consistent_form(text: Column) -> Column:
    """Column form: plain texts stay in the JVM, only suspect ones reach Python."""
    return F.coalesce(_consistent_udf(F.when(suspect(text), text)), text)


def _confusable(text: Column) -> Column:
    return F.coalesce(_confusable_udf(F.when(suspect(text), text)), F.lit(False))


def entry_texts(entries: DataFrame) -> DataFrame:
    """``headword``, ``senses.glosses`` and ``senses.examples.vi`` one row per text.

    ``(entry_id, field, sense_no, item_no, text)``; null texts give no row, null arrays
    count as empty. Extra columns of the input are not carried.
    """
    e = entries.select("entry_id", "headword", "senses")
    texts = F.array(F.struct(F.lit("headword").alias("field"), F.lit(-1).alias("sense_no"), F.lit(-1).alias("item_no"), F.col("headword").alias("text")))

    def items(field: str, values):
        return F.flatten(
            F.transform(
                F.coalesce(F.col("senses"), F.array()),
                lambda s, i: F.transform(
                    F.coalesce(values(s), F.array()),
                    lambda x, j: F.struct(F.lit(field).alias("field"), i.cast("int").alias("sense_no"), j.cast("int").alias("item_no"), (x["vi"] if field == "vi" else x).alias("text")),
                ),
            )
        )

    everything = F.concat(texts, items("gloss", lambda s: s["glosses"]), items("vi", lambda s: s["examples"]))
    return e.select("entry_id", F.inline(F.filter(everything, lambda x: x["text"].isNotNull())))


def consistent_texts(entries: DataFrame) -> DataFrame:
    """All texts of ``entry_texts`` with their consistent form and whether it differs.

    ``confusable``: a word of that form is wholly of look-alikes of Latin letters.
    """
    out = entry_texts(entries).withColumn("consistent", consistent_form(F.col("text")))
    return out.withColumn("changed", F.col("text") != F.col("consistent")).withColumn("confusable", _confusable(F.col("consistent")))


def inconsistent_texts(entries: DataFrame) -> DataFrame:
    """Only the texts that are not in the consistent form, with that form.

    The plain texts are filtered out in the JVM before anything is sent to Python.
    Nulls, empty texts and empty tables give no rows; repeated rows are kept.
    """
    hard = entry_texts(entries).filter(suspect(F.col("text")))
    return hard.withColumn("consistent", _consistent_once("text")).filter(F.col("text") != F.col("consistent")).withColumn("confusable", _confusable(F.col("consistent")))


def confusable_texts(entries: DataFrame) -> DataFrame:
    """The texts with a word that is wholly of look-alikes of Latin letters, and those words.

    ``(entry_id, field, sense_no, item_no, words)``. Such a word belongs to its own script
    and stays as it is in the consistent form; only a reader can be deceived by it. Plain
    texts don't reach Python; null and empty texts give no rows.
    """
    hard = entry_texts(entries).filter(suspect(F.col("text")))
    found = hard.withColumn("words", _confusable_words(F.col("text")))
    return found.filter(F.size("words") > 0).select("entry_id", "field", "sense_no", "item_no", "words")

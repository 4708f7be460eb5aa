"""Rows that fail to parse, set apart with the reason while the valid rows are loaded.

A schema generates one anchored expression for a whole valid row. Rows that don't match
it meet expressions for ever longer prefixes of fields, and the first prefix that fails
names the broken field. All of it runs in the JVM, without groups that repeat: doubled
quotes are masked beforehand, so that lines of any length are matched in constant stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for two double quotes in masked text: a code point that no text has.
PAIR = "\ufdd0"

# What exports write for a missing or wrong value. The first are marks in
# any case, the others only as they stand.
MARKS_ANY_CASE = ("null", "none", "nan", "nil", "n/a", "#n/a", "#na", "#ref!", "#value!", "#div/0!", "#name?", "#null!", "#num!", "#error!", "#err", "undefined", "(null)", "<na>", "<null>", "[null]", "missing")
MARKS = ("NA", "\\N", "NaT", "\\\\N")


@dataclass(frozen=True)
class Field:
    """A column of a row: whether it must be there, and must hold a proper value."""

    name: str
    required: bool = True
    checked: bool = True  # needs a letter or digit, no control character, no U+FFFD
    marks: bool = False  # an export's mark is no value


DICTIONARY_ROW = (Field("headword"), Field("gloss", marks=True), Field("pos", required=False, checked=False))

# a quoted field opens with an odd quote, or is nothing but doubled ones
_QUOTED = rf"{PAIR}*+\"[^\"]*+\"|{PAIR}++"
_PLAIN = rf"(?![{PAIR}\"])[^\t]*+"
_FIELD = rf"(?:{_QUOTED}|{_PLAIN})"
_END = r"(?=\t|\z)"
_BAD = r"[\p{Cc}\x{FFFD}&&[^\t]]"


def _quoted_for_regex(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}#-&~" else c for c in text)


def field_pattern(field: Field) -> str:
    """A field as it must look in a valid row (masked text)."""
    if not field.checked:
        return _FIELD + _END
    blank = r"[ \p{Z}\x0b\f]*+"
    mark = ""
    if field.marks:
        either = "|".join([rf"(?i:{'|'.join(map(_quoted_for_regex, MARKS_ANY_CASE))})", *map(_quoted_for_regex, MARKS)])
        mark = rf"{blank}(?:{either}){blank}"
    quoted = rf"(?=[^\"]*?[\p{{L}}\p{{N}}])(?![^\"]*?{_BAD})" + (rf"(?!{mark}\")" if mark else "")
    plain = rf"(?=[^\t]*?[\p{{L}}\p{{N}}])(?![^\t]*?{_BAD})" + (rf"(?!{mark}{_END})" if mark else "")
    return rf"(?:{PAIR}*+\"{quoted}[^\"]*+\"|(?![{PAIR}\"]){plain}[^\t]*+){_END}"


def row_pattern(schema: tuple[Field, ...]) -> str:
    """The anchored expression of a whole valid row."""
    out = ""
    for i, f in enumerate(schema):
        part = ("\\t" if i else "") + field_pattern(f)
        out += part if f.required else f"(?:{part})?+"
    return rf"\A{out}\z"


def prefix_patterns(schema: tuple[Field, ...]) -> list[str]:
    """For 1, 2, ... fields: the expression of that many well-formed fields."""
    out, prefix = [], ""
    for i in range(len(schema)):
        prefix += ("\\t" if i else "") + _FIELD + _END
        out.append(rf"\A{prefix}")
    return out


def masked(line: Column) -> Column:
    """The line without byte order mark and one carriage return, doubled quotes masked."""
    text = F.regexp_replace(line, r"\A\x{FEFF}", "")
    text = F.regexp_replace(text, r"\r\z", "")
    return F.replace(F.translate(text, PAIR, "\ufdd1"), F.lit('""'), F.lit(PAIR))


def fields_of(text: Column) -> Column:
    """The fields of a masked line whose quotes are in order."""
    return F.regexp_extract_all(F.concat(F.lit("\t"), text), F.lit(rf"\G\t({_FIELD}){_END}"), F.lit(1))


def value_of(field: Column) -> Column:
    """The value of a masked field."""
    raw = F.replace(field, F.lit(PAIR), F.lit('""'))
    inner = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))
    return F.when(field.rlike(rf"\A(?:{_QUOTED})\z"), inner).otherwise(raw)


def parsed_rows(lines: DataFrame, column: str = "raw_line", schema: tuple[Field, ...] = DICTIONARY_ROW) -> DataFrame:
    """Every line with what became of it; all columns of the input are kept.

    Added: ``row_kind`` (``valid``, ``failed`` or ``skipped``), ``row_reason`` of failed
    ones, ``row_field`` (the number of the first broken field from 1, where one is to
    blame) and ``row_values`` (the values of valid rows; missing optional ones are null).

    Skipped are null and blank lines and those that start with ``#``, after a byte order
    mark. Reasons, the first that holds: ``broken_quote``, ``column_count``,
    ``bad_value``. Repeated lines are judged one by one; an empty table stays empty.
    """
    required = sum(f.required for f in schema)
    out = lines.withColumn("_text", masked(F.col(column)))
    text = F.col("_text")
    skipped = text.isNull() | ~text.rlike(r"[^\s\p{Z}]") | text.startswith("#")
    out = out.withColumn("_valid", ~skipped & text.rlike(row_pattern(schema)))
    # failures only: which prefix of well-formed fields ends first
    broken = F.lit(0)
    for i, p in reversed(list(enumerate(prefix_patterns(schema), 1))):
        broken = F.when(~text.rlike(p) & F.concat(F.lit("\t"), text).rlike(rf"\A(?:\t[^\t]*+){{{i}}}"), i).otherwise(broken)
    # fields beyond the schema: whatever an in-order scan leaves over is a broken quote
    rest = F.regexp_replace(F.concat(F.lit("\t"), text), rf"\G\t{_FIELD}{_END}", "")
    count = F.size(fields_of(text))
    out = out.withColumn("_broken", F.when(~skipped & ~F.col("_valid"), F.when(rest != "", F.when(broken > 0, broken).otherwise(len(schema) + 1)).otherwise(0)))
    out = out.withColumn("_count", F.when(~skipped & ~F.col("_valid") & (F.col("_broken") == 0), count))
    reason = F.when(F.col("_broken") > 0, "broken_quote").when((F.col("_count") < required) | (F.col("_count") > len(schema)), "column_count").when(F.col("_count").isNotNull(), "bad_value")
    first_bad = F.lit(0)
    for i, f in reversed(list(enumerate(schema, 1))):
        if f.checked:
            good = rf"\A{''.join(_FIELD + _END + chr(92) + 't' for _ in range(i - 1))}{field_pattern(f)}"
            first_bad = F.when(~text.rlike(good), i).otherwise(first_bad)
    out = out.withColumn("row_reason", reason)
    values = F.when(F.col("_valid"), F.transform(fields_of(text), value_of))
    kind = F.when(skipped, "skipped").when(F.col("_valid"), "valid").otherwise("failed")
    field = F.when(F.col("row_reason") == "broken_quote", F.col("_broken")).when(F.col("row_reason") == "bad_value", first_bad)
    return out.withColumn("row_kind", kind).withColumn("row_field", field).withColumn("row_values", values).drop("_text", "_valid", "_broken", "_count")


def valid_rows(lines: DataFrame, column: str = "raw_line", schema: tuple[Field, ...] = DICTIONARY_ROW) -> DataFrame:
    """The valid rows, one column a field beside the columns of the input.

    A field of the name of an input column replaces it.
    """
    rows = parsed_rows(lines, column, schema).filter(F.col("row_kind") == "valid")
    for i, f in enumerate(schema):
        v = F.get("row_values", F.lit(i))
        rows = rows.withColumn(f.name, v if f.required else F.when(v.rlike(r"[^\s\p{Z}]"), v))
    return rows.drop("row_kind", "row_reason", "row_field", "row_values")


def failed_rows(lines: DataFrame, column: str = "raw_line", schema: tuple[Field, ...] = DICTIONARY_ROW) -> DataFrame:
    """The failed lines with their reason and first broken field."""
    return parsed_rows(lines, column, schema).filter(F.col("row_kind") == "failed").drop("row_kind", "row_values")

"""Rows that fail to parse (problem 5).

Every field is taken as nullable text first; rules on form, casts and constraints are evaluated as columns into an array
of errors, and rows are split by whether it is empty. Everything stays in the JVM. Quotes are judged without a state
machine: after a split at the quotes, the pieces at even places lie outside of quoted fields (or, when empty, between two
quotes that stand for one), so their first and last characters tell whether a quote opens or closes where it may.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.let import once

#: The header of the source files.
HEADER = ("pmid", "title", "abstract", "specific aims", "journal", "year")
_ESCAPE, _MARK, _CUT = "\x01", "\x01\x02", "\x01\x03"
#: U+FFFD or a control character other than tab and newline.
BROKEN = r"[\x{FFFD}\x00-\x08\x0b-\x1f\x7f-\x9f]"


def _bad_quoting(pieces: Column) -> Column:
    last = F.size(pieces) - 1

    def bad(x: Column, i: Column) -> Column:
        opens = (i == 0) | x.startswith(",")
        closes = (i == last) | x.endswith(",")
        return (i % 2 == 0) & (x != "") & ~(opens & closes)

    return (F.size(pieces) % 2 == 0) | F.exists(F.transform(pieces, bad), lambda b: b)


def _fields(pieces: Column) -> Column:
    """The raw fields: commas outside of quotes become cuts, whatever characters the text holds."""
    escaped = F.transform(pieces, lambda x, i: F.when(i % 2 == 0, F.replace(F.replace(x, F.lit(_ESCAPE), F.lit(_MARK)), F.lit(","), F.lit(_CUT))).otherwise(F.replace(x, F.lit(_ESCAPE), F.lit(_MARK))))
    return F.transform(F.split(F.array_join(escaped, '"'), _CUT), lambda x: F.replace(x, F.lit(_MARK), F.lit(_ESCAPE)))


def _value(raw: Column) -> Column:
    """The text of a raw field; an empty field without quotes is null."""
    quoted = raw.startswith('"')
    return F.when(quoted, F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).when(raw != "", raw)


def _free(name: str, taken: list[str], prefix: str) -> str:
    """``name``, with the prefix while a column is called so already."""
    while name.lower() in {c.lower() for c in taken}:
        name = prefix + name
    return name


def _parsed(df: DataFrame, raw: str, header: tuple[str, ...]) -> DataFrame:
    """(row: all columns of df, fields, errors)."""
    d = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    text = F.col(f"row.`{raw}`")
    line = F.when(text.endswith("\r"), F.left(text, F.length(text) - 1)).otherwise(text)
    d = once(d, "pieces", F.split(line, '"'))
    d = once(d, "quoting", F.coalesce(_bad_quoting(F.col("pieces")), F.lit(False)))
    d = once(d, "cells", F.when(~F.col("quoting"), _fields(F.col("pieces"))))
    count = F.when(text.isNull(), 0).otherwise(F.size("cells"))
    whole = ~F.col("quoting") & (count == len(header))
    d = once(d, "fields", F.when(whole, F.struct(*[_value(F.get("cells", F.lit(i))).alias(h) for i, h in enumerate(header)])))

    def rule(fails: Column, reason: str, field: str | None, what: str) -> Column:
        return F.when(fails, F.struct(F.lit(reason).alias("reason"), F.lit(field).cast("string").alias("field"), F.lit(what).alias("rule")))

    def cast_and_form(field: str, kind: str, pattern: str, what: str) -> list[Column]:
        """A field must cast to its type; one that does must also have the form."""
        text, number = F.col(f"fields.`{field}`"), F.col(f"fields.`{field}`").try_cast(kind)
        return [rule(whole & number.isNull(), "value", field, f"no {kind}"), rule(whole & number.isNotNull() & ~text.rlike(pattern), "value", field, what)]

    def clean(field: str) -> Column:
        return rule(whole & F.coalesce(F.col(f"fields.`{field}`").rlike(BROKEN), F.lit(False)), "value", field, "broken characters")

    errors = F.array_compact(F.array(
        rule(F.col("quoting"), "quoting", None, "quotes out of place"),
        rule(~F.col("quoting") & (count != len(header)), "column_count", None, f"not {len(header)} fields"),
        *cast_and_form("pmid", "long", r"\A[0-9]{1,8}\z", "not 1 to 8 digits"),
        *cast_and_form("year", "int", r"\A(19|20)[0-9]{2}\z", "no year of 19.. or 20.."),
        clean("abstract"), clean("specific aims"),
    ))
    return once(d, "errors", errors).select("row", "fields", "errors")


def parse_records(df: DataFrame, raw: str = "raw", header: tuple[str, ...] = HEADER) -> DataFrame:
    """``df`` with ``fields`` (struct of nullable texts, null where the row can't be split) and ``errors``: one (reason, field,
    rule) for each rule that fails, in the order quoting, column_count, value; empty for a sound row. One carriage return at the very end belongs to the
    line end. A null row has no fields (column_count), an empty one a single field. Other columns stay as they are; where
    one is called fields or errors, the new one is called parsed_..."""
    d = _parsed(df, raw, header)
    return d.select(*[F.col(f"row.`{c}`") for c in df.columns], *[F.col(c).alias(_free(c, df.columns, "parsed_")) for c in ("fields", "errors")])


def split_records(df: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(loaded rows: the columns beside ``raw``, then pmid as long, the texts, year as int; rejected rows: those columns,
    ``raw``, the first ``reason`` and all ``errors``). A column of ``df`` named like a new one keeps its place and name, and
    the new one is called field_... or row_..."""
    d = _parsed(df, raw, HEADER)
    kept = [c for c in df.columns if c != raw]
    rest = [F.col(f"row.`{c}`") for c in kept]
    typed = {"pmid": "long", "year": "int"}
    cols = [(F.col(f"fields.`{h}`").try_cast(typed[h]) if h in typed else F.col(f"fields.`{h}`")).alias(_free(h.replace(" ", "_"), kept, "field_")) for h in HEADER]
    good = d.where(F.size("errors") == 0).select(*rest, *cols)
    new = [F.get("errors", F.lit(0))["reason"].alias(_free("reason", [*kept, raw], "row_")), F.col("errors").alias(_free("errors", [*kept, raw], "row_"))]
    return good, d.where(F.size("errors") > 0).select(*rest, F.col(f"row.`{raw}`"), *new)

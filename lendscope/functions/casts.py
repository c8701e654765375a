"""Lenient typing of raw text fields and null-fill / cast plans.

The source's loader never fails a row: a malformed number becomes 0 (or
NULL for a date) with a warning.  ``conform`` does the same with
``try_cast`` and counts the fields that did not convert in ``_rejects``.

Beside Spark's type names it knows the source's own: ``yymmdd`` and
``yymmdd_time`` dates, ``float32`` (a number kept in single precision, given
back as a double), ``char(n)`` (cut to n characters, trailing spaces gone) and
``varchar(n)`` (cut to n characters).  Text that is cut counts as a reject.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.functions.dates import parse_yymmdd, parse_yymmdd_time

_CUT = re.compile(r"(var)?char\((\d+)\)")
INTEGRAL = ("int", "integer", "bigint", "smallint", "long", "short", "tinyint")


def _lenient(raw: Column, type_: str) -> tuple[Column, Column]:
    """Return (typed value, rejected flag) for one raw text field."""
    t = type_.lower()
    s = F.trim(raw)
    empty = s.isNull() | (s == "")
    if t == "yymmdd":
        v = parse_yymmdd(s)
        return v, (~empty & v.isNull())
    if t == "yymmdd_time":
        v = parse_yymmdd_time(s)
        return v, (~empty & v.isNull())
    cut = _CUT.fullmatch(t)
    if cut:
        kept = F.substring(raw, 1, int(cut[2]))
        # spaces beyond the end are dropped in silence
        lost = F.length(F.rtrim(raw)) > int(cut[2])
        return (kept if cut[1] else F.rtrim(kept)), F.coalesce(lost, F.lit(False))
    if t == "float32":
        v = s.try_cast("float")
        bad = ~empty & v.isNull()
        return F.when(bad | empty, F.lit(0.0)).otherwise(v.cast("double")), bad
    if t in INTEGRAL:
        # exact for every digit of a long; '3.08' in an int column is rounded, as a
        # lenient loader does; what is no number or out of range is 0 and a reject
        v = F.coalesce(s.try_cast(t), F.round(s.try_cast("decimal(38,10)")).try_cast(t))
        bad = ~empty & v.isNull()
        return F.when(bad | empty, F.lit(0).cast(t)).otherwise(v), bad
    if t.startswith("decimal") or t in ("double", "float"):
        v = s.try_cast(t)
        bad = ~empty & v.isNull()
        return F.when(bad | empty, F.lit(0).cast(t)).otherwise(v), bad
    if t in ("string", "text"):
        return raw, F.lit(False)
    v = s.try_cast(t)
    return v, (~empty & v.isNull())


def conform(df: DataFrame, types: dict[str, str], rejects: str | None = "_rejects",
            details: str | None = None) -> DataFrame:
    """Type raw text columns leniently.

    ``types`` maps column -> Spark type name, or ``'yymmdd'`` /
    ``'yymmdd_time'`` for the source's two-digit-year date formats.  Columns
    not listed pass through unchanged.  With ``rejects`` set, a column with
    the number of fields per row that failed to convert is added; ``details``
    adds an array of their ``column`` and ``raw`` text.
    """
    out, flags, failed = [], [], []
    for name in df.columns:
        if name in types:
            v, bad = _lenient(F.col(name), types[name])
            out.append(v.alias(name))
            flags.append(F.when(bad, 1).otherwise(0))
            failed.append(F.when(bad, F.struct(F.lit(name).alias("column"), F.col(name).alias("raw"))))
        else:
            out.append(F.col(name))
    if rejects:
        total = F.lit(0)
        for f in flags:
            total = total + f
        out.append(total.cast("int").alias(rejects))
    if details:
        none = F.array().cast("array<struct<column:string,raw:string>>")
        out.append((F.filter(F.array(*failed), lambda r: r.isNotNull()) if failed else none).alias(details))
    return df.select(*out)


def fill_cast(df: DataFrame, int_cols: list[str] = (), float_cols: list[str] = (),
              fill_all: float | None = None) -> DataFrame:
    """Null-fill and cast plan over column lists.

    ``int_cols``: NULL -> 0, then integer; ``float_cols``: cast to double,
    NULL kept; ``fill_all``: afterwards fill every numeric NULL with it.
    """
    ints, floats = set(int_cols), set(float_cols)
    cols = []
    for name in df.columns:
        c = F.col(name)
        if name in ints:
            c = F.coalesce(c.cast("double"), F.lit(0.0)).cast("int")
        elif name in floats:
            c = c.cast("double")
        cols.append(c.alias(name))
    out = df.select(*cols)
    if fill_all is not None:
        out = out.fillna(fill_all)
    return out

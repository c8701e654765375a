"""Exact quantiles without gathering a column into one task.

Spark's exact ``percentile`` aggregate merges every distinct value of a
group into a single buffer, which does not scale to billions of scores, and
``percentile_approx`` is approximate.  Here every value becomes a 64-bit
integer that keeps its order (:func:`order_key`), and the integer that stands
at a wanted rank is found digit by digit: a distributed pass counts the keys
of each open window by their next digit, the digit that holds the rank
follows from those counts, and its keys are the next window.  The first pass
counts every group by its keys' top 8 bits.  A later window starts below the
bits its smallest and largest key share, and every pass settles a digit of at
least 8 bits more (up to 16 where few windows are open), so at most 8 passes
end the search for any values, however far apart or close together.  One pass
serves all groups and ranks, ``WINDOWS`` windows at a time; only counts reach
the driver, at most ``COUNTS`` of them (256 for each group in the first pass).

Order of doubles: -infinity, finite values (``-0.0`` equals ``0.0``),
infinity, NaN (as in Spark's sort).  NULL is no value.

``MAX_GROUPS`` is a guard: more groups than that raise, nothing is dropped.

Interpolation follows the usual "continuous" definition:
``pos = p * (n - 1)``; ``lo + (hi - lo) * (pos - floor(pos))``, and ``lo``
itself where both neighbours are equal (also where both are infinite).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType

MAX_GROUPS = 10_000
DIGIT, WIDEST = 8, 16
WINDOWS = 4096
COUNTS = WINDOWS << DIGIT
_KEY = "_key"
_BITS = (1 << 64) - 1
_INFINITE = 2047 << 52
_NAN = _INFINITE + 1


def order_key(df: DataFrame, value: str, out: str = _KEY) -> DataFrame:
    """Add ``out``: a long in the order of ``value``, different for different values.

    Integers are their own key.  The key of a positive double is its IEEE bit
    pattern, computed with exact double arithmetic: powers of two are exact,
    the logarithm is only a first guess of the exponent, and quotient,
    difference and product below lose nothing.  Negative ones mirror it.
    """
    kind = df.schema[value].dataType
    if isinstance(kind, IntegralType):
        return df.withColumn(out, F.col(value).cast("long"))
    if not isinstance(kind, (DoubleType, FloatType)):
        raise TypeError(f"no order-keeping integer for {kind.simpleString()}")
    # one step for each intermediate that is used twice, so that none is computed twice
    a = df.withColumn("_a", F.abs(F.col(value).cast("double")))
    two = F.lit(2.0)
    e = a.withColumn("_e", F.floor(F.log2(F.when(F.col("_a") < math.inf, F.col("_a")))))
    e = e.withColumn("_e", F.when(F.col("_a") < F.pow(two, "_e"), F.col("_e") - 1)
                     .when(F.col("_a") >= F.pow(two, F.col("_e") + 1), F.col("_e") + 1).otherwise(F.col("_e")))
    mantissa = ((F.col("_a") / F.pow(two, "_e") - 1) * F.lit(2.0 ** 52)).cast("long")
    size = (F.when(F.isnan("_a"), F.lit(_NAN)).when(F.col("_a") == math.inf, F.lit(_INFINITE))
            .when(F.col("_a") < F.lit(2.0 ** -1022), (F.col("_a") / F.lit(2.0 ** -1074)).cast("long"))
            .otherwise((F.col("_e") + 1023) * F.lit(1 << 52) + mantissa))
    signed = F.when(F.isnan("_a"), F.col("_m")).when(F.col(value) < 0, -F.col("_m")).otherwise(F.col("_m"))
    return e.withColumn("_m", size).withColumn(out, signed).drop("_a", "_e", "_m")


def key_value(key: int) -> float:
    """The double whose :func:`order_key` is ``key``."""
    if key == _NAN:
        return math.nan
    size = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -size if key < 0 else size


def _pass(keyed: DataFrame, group_cols: Sequence[str], windows: list[tuple]) -> dict[int, list[tuple]]:
    """Per window: ``(digit, count, smallest key, largest key)`` of the keys inside it, by their next digit.

    The windows of a group sit in one row of a small table that is joined on
    the group columns (null-safe), so a row meets its own group's windows only.
    """
    spark = keyed.sparkSession
    bits = max(DIGIT, min(WIDEST, (COUNTS // len(windows)).bit_length() - 1))
    by_group: dict[tuple, list[tuple]] = {}
    for i, (g, lo, hi, _, _) in enumerate(windows):
        shift = max(0, ((lo ^ hi) & _BITS).bit_length() - bits)
        by_group.setdefault(g, []).append((i, lo, hi, shift))
    wins = "array<struct<w:int,lo:bigint,hi:bigint,shift:int>>"
    if group_cols:
        kinds = [f"_g{i} {keyed.schema[c].dataType.simpleString()}" for i, c in enumerate(group_cols)]
        table = spark.createDataFrame([(*g, w) for g, w in by_group.items()], ", ".join([*kinds, f"_wins {wins}"]))
        match = F.lit(True)
        for i, c in enumerate(group_cols):
            match = match & keyed[c].eqNullSafe(F.col(f"_g{i}"))
        joined = keyed.join(F.broadcast(table), match)  # at most WINDOWS windows
    else:
        joined = keyed.withColumn("_wins", F.array(*[F.struct(
            F.lit(i).alias("w"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"),
            F.lit(s).alias("shift")) for i, lo, hi, s in by_group[()]]))
    inside = joined.select(_KEY, F.explode(F.filter("_wins", lambda w: F.col(_KEY).between(w["lo"], w["hi"]))).alias("t"))
    digit = F.call_function("shiftright", F.col(_KEY), F.col("t.shift"))
    rows = (inside.select(F.col("t.w").alias("w"), digit.alias("digit"), _KEY).groupBy("w", "digit")
            .agg(F.count(F.lit(1)).alias("n"), F.min(_KEY).alias("lo"), F.max(_KEY).alias("hi")).collect())
    out: dict[int, list[tuple]] = {}
    for r in rows:
        out.setdefault(r["w"], []).append((r["digit"], r["n"], r["lo"], r["hi"]))
    return out


def _narrowed(g: tuple, below: int, wanted: set[int], counts: list[tuple]) -> list[tuple]:
    """The digits that hold wanted ranks, as the windows of the next pass: (group, lo, hi, rows below, ranks)."""
    out = []
    for _, n, lo, hi in sorted(counts):
        held = {r for r in wanted if below <= r < below + n}
        if held:
            out.append((g, lo, hi, below, held))
        below += n
    return out


def _search(keyed: DataFrame, ranks: dict[tuple, set[int]], group_cols: Sequence[str],
            first: dict[tuple, list[tuple]]) -> dict[tuple, dict[int, int]]:
    """Keys at the wanted ranks; ``first``: the groups' counts by top digit."""
    result: dict[tuple, dict[int, int]] = {g: {} for g in ranks}
    windows = [w for g, wanted in ranks.items() for w in _narrowed(g, 0, wanted, first[g])]
    while True:
        for g, lo, hi, _, wanted in windows:
            if lo == hi:
                result[g].update(dict.fromkeys(wanted, lo))
        windows = [w for w in windows if w[1] != w[2]]
        if not windows:
            return result
        narrower = []
        for k in range(0, len(windows), WINDOWS):
            chunk = windows[k:k + WINDOWS]
            for i, counts in _pass(keyed, group_cols, chunk).items():
                g, _, _, below, wanted = chunk[i]
                narrower += _narrowed(g, below, wanted, counts)
        windows = narrower


def _first_pass(keyed: DataFrame, group_cols: Sequence[str]) -> dict[tuple, list[tuple]]:
    """Per group ``(digit, count, smallest key, largest key)`` by the top 8 bits (bounded group count)."""
    agg = (keyed.select(*group_cols, F.shiftright(_KEY, 64 - DIGIT).alias("_digit"), _KEY).groupBy(*group_cols, "_digit")
           .agg(F.count(F.lit(1)).alias("_n"), F.min(_KEY).alias("_lo"), F.max(_KEY).alias("_hi")))
    out: dict[tuple, list[tuple]] = {}
    for r in agg.limit((MAX_GROUPS << DIGIT) + 1).collect():
        out.setdefault(tuple(r[c] for c in group_cols), []).append((r["_digit"], r["_n"], r["_lo"], r["_hi"]))
    if len(out) > MAX_GROUPS:
        raise ValueError(f"too many groups for exact quantiles (> {MAX_GROUPS})")
    return out


def _keyed(df: DataFrame, value: str, group_cols: Sequence[str]) -> DataFrame:
    valued = df.select(*group_cols, F.col(value).alias("_value")).filter(F.col("_value").isNotNull())
    return order_key(valued, "_value").select(*group_cols, _KEY)


def order_statistics(df: DataFrame, value: str, ranks: dict[tuple, set[int]],
                     group_cols: Sequence[str] = ()) -> dict[tuple, dict[int, float]]:
    """Exact k-th smallest values (0-based ranks) of ``value`` per group.

    ``ranks`` maps group key tuple -> ranks wanted; ``value`` is an integer,
    float or double column.
    """
    group_cols = list(group_cols)
    keyed = _keyed(df, value, group_cols)
    found = _search(keyed, ranks, group_cols, _first_pass(keyed, group_cols))
    back = int if isinstance(df.schema[value].dataType, IntegralType) else key_value
    return {g: {r: back(k) for r, k in of.items()} for g, of in found.items()}


def _positions(n: int, p: float) -> tuple[int, int, float]:
    pos = (n - 1) * p
    lo = math.floor(pos)
    return lo, math.ceil(pos), pos - lo


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    group_cols: Sequence[str] = (), persist: bool = True
                    ) -> dict[tuple, dict[float, float | None]]:
    """Linearly interpolated quantiles of ``value`` per group.

    Returns ``{group_key: {p: quantile}}``; the key is ``()`` without groups.
    """
    group_cols = list(group_cols)
    keyed = _keyed(df.withColumn(value, F.col(value).cast("double")), value, group_cols)
    if persist:
        keyed = keyed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = _first_pass(keyed, group_cols)
        sizes = {g: sum(c[1] for c in counts) for g, counts in first.items()}
        ranks = {g: {r for p in probs for r in _positions(n, p)[:2]} for g, n in sizes.items()}
        found = _search(keyed, ranks, group_cols, first)
        out: dict[tuple, dict[float, float | None]] = {}
        for g, n in sizes.items():
            out[g] = {}
            for p in probs:
                r0, r1, d = _positions(n, p)
                lo, hi = key_value(found[g][r0]), key_value(found[g][r1])
                out[g][p] = lo if found[g][r0] == found[g][r1] else lo + (hi - lo) * d
        return out
    finally:
        if persist:
            keyed.unpersist()


def exact_quantile(df: DataFrame, value: str, p: float) -> float | None:
    """One quantile of the whole column (``None`` when it has no values)."""
    q = exact_quantiles(df, value, [p])
    return q[()][p] if () in q else None

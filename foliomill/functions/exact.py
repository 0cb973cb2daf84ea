"""Exact arithmetic: sums of doubles rounded once, and products of money rounded once.

A double is a whole number of 2**-1074.  It is cut into at most three whole numbers below 2**34, each of a place
32 bits wide; the places are added up as whole numbers, in partial sums per task, and a
group's places (66 at most) are put together and rounded once at the end.  The result is the double nearest
to the true sum, whatever the order of the rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.values import let

WIDTH, LOWEST, PLACES = 32, -1074, 66
HALF = 16
NAN, UP, DOWN = -1, -2, -3  # places of what is no number
UNITS = -LOWEST // WIDTH  # place of small whole numbers; a null or 0 is counted there, where a group's values often are
SLOTS = 128  # a slot is one place of one of the sums
CENTS = "decimal(38,2)"


def _pieces(df: DataFrame, name: str) -> tuple[DataFrame, Column, list[Column]]:
    """``df`` with helper columns of the double ``name``, its highest place, and its pieces there and in the two places below."""
    unit = F.array(*[F.lit(2.0 ** (WIDTH * j + LOWEST)) for j in range(PLACES)])
    v, top, r = F.col(name), f"{name}_top", [name, f"{name}_r1", f"{name}_r2"]
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (v != 0)
    # The logarithm may be off by one place at a border; three places hold all 53 bits all the same.
    place = F.floor((F.log2(F.abs(v)) - LOWEST) / WIDTH)
    df = df.withColumn(top, F.when(finite, F.greatest(F.lit(0), F.least(F.lit(PLACES - 1), place))).cast("int"))
    for k in range(3):
        at = F.get(unit, F.col(top) - k)
        df = df.withColumn(f"{name}_p{k}", (F.col(r[k]) / at).cast("bigint"))
        if k < 2:
            df = df.withColumn(r[k + 1], F.col(r[k]) - F.col(f"{name}_p{k}") * at)
    odd = F.when(F.isnan(v), NAN).when(v == float("inf"), UP).when(v == float("-inf"), DOWN)
    place = F.coalesce(odd, F.col(top), F.lit(UNITS))
    return df, place, [F.coalesce(f"{name}_p{k}", F.lit(0).cast("bigint")) for k in range(3)]


def rounded(places: list[tuple[int, int]]) -> float:
    """The double nearest to the sum of piece x 2**(32 place - 1074).

    NaN with a NaN or with infinities of both signs, infinite with one infinity or beyond the largest double.
    """
    odd = {place for place, _ in places if place < 0}
    if NAN in odd or {UP, DOWN} <= odd:
        return float("nan")
    if odd:
        return float("inf") if UP in odd else float("-inf")
    total = sum(piece << (WIDTH * place) for place, piece in places)
    try:
        return total / (1 << -LOWEST)
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


def sums(df: DataFrame, by: list[str], totals: dict[str, Column], counts: dict[str, Column]) -> DataFrame:
    """Per group the exact sum of each of ``totals`` (0.0 without values) and how many rows meet each of ``counts``.

    One pass with partial sums per task; a group with a large share of all rows is no problem.
    """
    names = [f"_v{i}" for i in range(len(totals))]
    df = df.select(*by, *[c.cast("double").alias(n) for n, c in zip(names, totals.values(), strict=True)], *[F.coalesce(c, F.lit(False)).cast("bigint").alias(f"_c{i}") for i, c in enumerate(counts.values())])
    items = []
    for i, name in enumerate(names):
        df, place, pieces = _pieces(df, name)
        # The first value's row carries the counts, and is there without a value, too.
        met = [(F.col(f"_c{c}") if i == 0 else F.lit(0).cast("bigint")).alias(f"_c{c}") for c in range(len(counts))]
        slot = F.lit(i * SLOTS - DOWN) + place
        given = F.lit(True) if i == 0 else (F.col(name) != 0).eqNullSafe(True)
        items.append(F.struct(F.when(given, slot).alias("slot"), *[p.alias(f"p{k}") for k, p in enumerate(pieces)], *met))
    found = F.filter(F.array(*items), lambda x: x["slot"].isNotNull())
    rows = df.select(*by, F.inline(found))
    # One row per sum and highest place is moved.  In halves, so that the sums of 2**47 rows fit 64 bits.
    halves = [half for k in range(3) for half in (F.sum(F.shiftright(f"p{k}", HALF)).alias(f"h{k}"), F.sum(F.pmod(f"p{k}", F.lit(1 << HALF))).alias(f"l{k}"))]
    n_counts = [F.sum(f"_c{c}").alias(f"_c{c}") for c in range(len(counts))]
    added = rows.groupBy(*by, "slot").agg(*halves, *n_counts)
    whole = added.groupBy(*by).agg(F.collect_list(F.struct("slot", *[f"{half}{k}" for k in range(3) for half in "hl"])).alias("_places"), *n_counts)
    n_totals = len(totals)
    columns = [f"t{i}" for i in range(n_totals)]

    @F.pandas_udf(", ".join(f"{c} double" for c in columns))
    def finish(groups: pd.Series) -> pd.DataFrame:
        out = []
        for group in groups:
            parts: dict[int, list[tuple[int, int]]] = {}
            for p in group:
                of, top = divmod(p["slot"], SLOTS)
                top += DOWN
                pieces = [(top - k, (p[f"h{k}"] << HALF) + p[f"l{k}"]) for k in range(3)] if top >= 0 else [(top, 1)]
                parts.setdefault(of, []).extend((at, piece) for at, piece in pieces if piece)
            out.append([rounded(parts.get(i, [])) for i in range(n_totals)])
        return pd.DataFrame(out, columns=columns)

    # On its way back a NaN becomes a null; a sum is never one.
    done = whole.select(*by, finish("_places").alias("_done"), *[f"_c{c}" for c in range(len(counts))])
    return done.select(*by, *[F.coalesce(f"_done.t{i}", F.lit(float("nan"))).alias(n) for i, n in enumerate(totals)], *[F.col(f"_c{i}").alias(n) for i, n in enumerate(counts)])


def product(a: Column, b: Column) -> Column:
    """a x b in whole cents, rounded once (halves away from zero); null beyond 36 digits.

    Both have at most 18 digits before the point and 10 behind it.  The product of the whole parts, the mixed ones
    and that of the fractions are exact each; only the last 20 decimals decide about a cent.
    """

    def parts(x: Column) -> Column:
        whole = F.floor(F.abs(x)).cast("decimal(18,0)")
        return F.struct(whole.alias("w"), (F.abs(x) - whole).cast("decimal(10,10)").alias("f"), (x < 0).alias("minus"))

    def multiply(p: Column) -> Column:
        return let(F.struct(parts(p["x"]).alias("x"), parts(p["y"]).alias("y")), by_parts)

    def by_parts(p: Column) -> Column:
        x, y = p["x"], p["y"]
        mixed = x["w"] * y["f"] + x["f"] * y["w"]

        def put(m: Column) -> Column:
            whole = F.floor(m)
            cents = F.round((m - whole).cast("decimal(11,10)") + x["f"] * y["f"], 2)
            size = F.try_add(F.try_add((x["w"] * y["w"]).try_cast("decimal(36,0)"), whole).try_cast("decimal(36,0)"), cents).try_cast(CENTS)
            return F.when(x["minus"] != y["minus"], -size).otherwise(size)

        return let(mixed, put)

    # Up to four decimals and 14 digits before them the plain product has all its digits.
    short_a, short_b = a.try_cast("decimal(18,4)"), b.try_cast("decimal(18,4)")
    plain = (short_a == a) & (short_b == b)
    return F.when(plain, F.round(short_a * short_b, 2).cast(CENTS)).otherwise(let(F.struct(a.alias("x"), b.alias("y")), multiply))

"""Exact sums against math.fsum, exact products against decimal arithmetic."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from foliomill.functions import exact
from foliomill.operators import line_items


def totals(spark, groups, parts=5):
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
    out = exact.sums(df, ["g"], {"total": F.col("v"), "twice": F.col("v") + F.col("v")}, {"n": F.lit(True), "values": F.col("v").isNotNull()})
    return {r.g: r for r in out.collect()}


def test_sums_equal_fsum(spark):
    rng = random.Random(11)
    groups = {
        "cents": [round(rng.uniform(-1e6, 1e6), 2) for _ in range(3000)],
        "tiny": [4e-19] * 1000,
        "tenths": [0.1] * 1000,
        "cancel": [1e300, 1.0, -1e300, 1e-300, 1e16, -1e16],
        "subnormal": [5e-324, 5e-324, 2.2e-308, -2.2e-308, 1e-310],
        "powers": [s * 2.0**e for e in range(-1074, 1020, 7) for s in (1, -1, 3) if abs(s) * 2.0**e < 1e300],
        "zeros": [0.0, -0.0, None],
        "edge": [2.0**32 - 2.0**-21, 2.0**-1042, 2.0**-1043, 2.0**32, float.fromhex("0x1.fffffffffffffp+31")],
        "half_even": [1.0, 2.0**-53, 2.0**-106],
    }
    for k in range(20):
        groups[f"r{k}"] = [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-300, 299) for _ in range(rng.randint(1, 80))]
    got = totals(spark, groups)
    for name, values in groups.items():
        given = [v for v in values if v is not None]
        assert got[name].total == math.fsum(given), name
        assert got[name].twice == math.fsum(v + v for v in given), name
        assert (got[name].n, got[name]["values"]) == (len(values), len(given))


def test_what_is_no_number(spark):
    inf, nan = float("inf"), float("nan")
    got = totals(spark, {"up": [inf, 1.0], "down": [-inf, 1e300], "both": [inf, -inf], "nan": [nan, 2.0], "none": [None], "large": [1.7e308, 1.7e308], "back": [1.7e308, 1.7e308, -1.7e308]})
    assert (got["up"].total, got["down"].total, got["none"].total, got["large"].total) == (inf, -inf, 0.0, inf)
    assert math.isnan(got["both"].total) and math.isnan(got["nan"].total)
    assert got["back"].total == 1.7e308
    assert exact.sums(spark.createDataFrame([], "g string, v double"), ["g"], {"t": F.col("v")}, {}).collect() == []


def test_products_are_rounded_once(spark):
    rng = random.Random(12)
    pairs = [("0.0049999996", "1"), ("0.005", "1"), ("-0.005", "1"), ("0.1", "0.05"), ("0.0000000001", "49999999.9999999999"), ("0.0000000001", "50000000"), ("999999999999999999.9999999999", "1"), ("-123456789.1234567891", "987654321.9876543219"), ("0", "5")]
    for _ in range(300):
        pairs.append(tuple(str(Decimal(rng.randrange(-(10 ** rng.randint(1, 20)), 10 ** rng.randint(1, 20))).scaleb(-10)) for _ in range(2)))
    # Exactly on and next to half a cent, with ten decimals on both sides.
    for k in range(1, 60, 2):
        pairs += [(f"0.{k:03d}5000000", "1.0000000000"), (f"{k}.0049999999", "1.0000000000"), (f"{k}.0000000001", "0.0050000000"), (f"0.0{k:02d}5", "-1")]
    rows = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    money = [F.col(c).cast("decimal(28,10)") for c in ("a", "b")]
    got = rows.select("a", "b", exact.product(*money).alias("p")).collect()
    with localcontext() as context:
        context.prec = 80
        for r in got:
            assert r.p == (Decimal(r.a) * Decimal(r.b)).quantize(Decimal("0.01"), ROUND_HALF_UP), r


@pytest.mark.parametrize(("qty", "price", "total", "off"), [("0.0049999996", "1", "0.00", False), ("0.0049999996", "1", "0.02", True), ("3", "0.3350000000", "1.01", False), ("3", "0.3350000000", "1.03", True)])
def test_line_totals(spark, qty, price, total, off):
    lines = spark.createDataFrame([("j", 1, "x", qty, price, total)], "job_id string, line int, description string, qty string, unit_price string, total string")
    assert line_items.with_expected(lines).first().off is off

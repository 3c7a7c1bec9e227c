"""Ranges of equal content, and exact quantiles without ordering or holding a whole group.

Splitters are quantiles from one approximate aggregate (a sketch of bounded size), so an outlying value takes
no range of its own and leaves the others as they are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import kept


def splitters(value: Column, ranges: int) -> Column:
    """Aggregate: sorted bounds (an array of at most ``ranges`` - 1 values, with repeats) of ranges of about equal content."""
    return F.percentile_approx(value, F.array(*(F.lit(k / ranges) for k in range(1, max(2, ranges)))), F.lit(4 * ranges))


def below(bounds: Column, value: Column, most: int, equal: bool = False) -> Column:
    """How many of the sorted bounds (no more than ``most``) are below the value, or not above it; by bisection."""
    steps = F.array(*(F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)))

    def step(at: Column, s: Column) -> Column:
        bound = F.try_element_at(bounds, at + s)  # null beyond the end
        return F.when(F.coalesce(bound <= value if equal else bound < value, F.lit(False)), at + s).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def range_of(bounds: Column, value: Column, ranges: int, salt: Column | None = None) -> Column:
    """Number of the range that a value falls in, rising with the value.

    A value that fills several ranges is dealt to all of these by ``salt``, a number of [0, 1): rows of one value
    stand in the order of their salts.
    """
    low = below(bounds, value, ranges)
    if salt is None:
        return low
    wide = below(bounds, value, ranges, equal=True) - low
    return low + F.coalesce(F.floor(salt * wide).cast("int"), F.lit(0))


#: Rows of one a key, of about 2 kB each, that are broadcast.
FEW = 1000


def listed(few: DataFrame) -> DataFrame:
    """Rows of one a key for joins by it, written and counted, and broadcast up to ``FEW`` keys.

    A join by a few keys would send all rows of a key to one task; with more keys it is left to Spark, which
    splits a key that outweighs the others.
    """
    few = kept(few, "few")
    return F.broadcast(few) if few.count() <= FEW else few


def with_few(rows: DataFrame, few: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows with the one row of their key, which is listed."""
    return rows.join(listed(few), key)


#: Rows of a group, as a share of one to this, that the sketch may be off by.
ACCURACY = 50_000
_SLACK = 5 / ACCURACY


def exact_quantiles(df: DataFrame, value: str, wanted: Mapping[str, float], keys: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation of each group, a column for each name of ``wanted``.

    A sketch brackets every wanted rank; values below and above the bracket are only counted, and those inside
    (a few in ``ACCURACY``) are counted by value and ranked.  Nulls do not count; a group without
    values has nulls.  A bracket that misses its rank is an error, never a wrong value.
    """
    keys = keys or []
    rows = df.select(*keys, F.col(value).alias("_v"))
    shares = [s for q in wanted.values() for s in (max(0.0, q - _SLACK), min(1.0, q + _SLACK))]
    bounds = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, shares)), F.lit(ACCURACY)).alias("_b"))
    if keys:
        bounds = kept(bounds, "bounds")  # one row a group
    each = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"), F.col("_b")[2 * k].alias("lo"), F.col("_b")[2 * k + 1].alias("hi")) for k, (name, q) in enumerate(wanted.items())))
    bracket = bounds.select(*keys, "_n", F.explode(each).alias("_w")).select(*keys, "_n", "_w.*")
    one = F.struct(*keys) if keys else F.lit(0)
    met = rows.where("_v IS NOT NULL").withColumn("_g", one).drop(*keys)
    few = bracket.withColumn("_g", one).groupBy("_g").agg(F.collect_list(F.struct("name", "lo", "hi")).alias("_w"))  # one row a group
    met = (with_few(met, few, "_g") if keys else met.crossJoin(F.broadcast(few.drop("_g")))).select("_g", "_v", F.explode("_w").alias("_w"))
    side = F.when(F.col("_v") < F.col("_w.lo"), -1).when(F.col("_v") > F.col("_w.hi"), 1).otherwise(0)
    counts = met.groupBy("_g", "_w.name", side.alias("_s"), F.when(side == 0, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    upto = Window.partitionBy("_g", "name").orderBy("_s", "_v")
    ranked = counts.withColumn("_upto", F.sum("_c").over(upto)).join(bracket.withColumn("_g", one).drop(*keys, "lo", "hi"), ["_g", "name"])
    at = F.col("q") * (F.col("_n") - 1)
    first, second = F.floor(at), F.least(F.floor(at) + 1, F.col("_n") - 1)

    def of_rank(rank: Column) -> Column:
        """The value at a rank: of the values outside of the bracket only those next to it are known."""
        known = F.when(F.col("_s") == 0, F.col("_v")).when((F.col("_s") < 0) & (rank == F.col("_upto") - 1), F.col("_hi")).when((F.col("_s") > 0) & (rank == F.col("_upto") - F.col("_c")), F.col("_lo"))
        return F.min(F.when(F.col("_upto") > rank, F.struct("_upto", known.alias("_v"))))

    found = ranked.groupBy("_g", "name").agg(of_rank(first).alias("_a"), of_rank(second).alias("_z"), F.first(at - first).alias("_f"))
    miss = F.raise_error(F.lit("a quantile lies outside of its bracket"))
    value_at = F.when(F.col("_a._v").isNull() | F.col("_z._v").isNull(), miss.cast("double")).when(F.col("_a._v") == F.col("_z._v"), F.col("_a._v").cast("double")).otherwise(F.col("_a._v") * (1 - F.col("_f")) + F.col("_z._v") * F.col("_f"))
    long = found.select("_g", "name", value_at.alias("_q"))
    wide = long.groupBy("_g").agg(*(F.max(F.when(F.col("name") == name, F.col("_q"))).alias(name) for name in wanted))
    if not keys:
        return bounds.select(F.lit(0).alias("_g")).join(wide, "_g", "left").drop("_g")
    return bounds.select(one.alias("_g")).join(wide, "_g", "left").select("_g.*", *wanted)

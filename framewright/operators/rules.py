"""Payload regions, and association rules over the items that regions turn messages into.

The fitted chain is a few small tables: regions of each id (k-means of its payloads),
groups of regions over all ids, a quantiser of their centres and bins of their bounds.
Together they name an item for each region, and scoring a message is a join by id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import kept
from . import windows as W

_DISTANCE = "sqrt(aggregate(zip_with({v}, c.centre, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v))"


def _best(v: str, *fields: str) -> Column:
    """The nearest of the centres in _c, the first region at ties."""
    named = ", ".join(f"'{f}', c.{f}" for f in fields)
    return F.expr(f"array_min(transform(_c, c -> named_struct('d', {_DISTANCE.format(v=v)}, {named})))")


def _nearest(points: DataFrame, centres: DataFrame, key: list[str]) -> DataFrame:
    """Points (key, v) with the region and distance of the nearest centre of their key; a key's centres come as one array, so no row is multiplied."""
    listed = centres.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("region", "centre"))).alias("_c"))
    joined = points.join(listed, key) if key else points.crossJoin(F.broadcast(listed))  # one row
    return joined.withColumn("_b", _best("v", "region")).withColumns({"region": F.col("_b.region"), "distance": F.col("_b.d")}).drop("_b", "_c")


def lloyd(points: DataFrame, key: list[str], k: int, rounds: int) -> DataFrame:
    """k-means within each key: points (key, v array<double>, n rows alike, _first) to (key, region, centre).

    Centres begin at the first k points in the order of (_first, v); a round is one join with the centres and
    one aggregate, whose result is written.
    """
    order = Window.partitionBy(*(key or [F.lit(0)])).orderBy("_first", "v")
    centres = points.withColumn("region", F.row_number().over(order) - 1).where(F.col("region") < k).select(*key, "region", F.col("v").alias("centre"))
    for _ in range(rounds):
        long = _nearest(points, kept(centres, "centres"), key).select(*key, "region", "n", F.posexplode("v").alias("at", "value"))
        mean = long.groupBy(*key, "region", "at").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("m"))
        centres = mean.groupBy(*key, "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda x: x.m).alias("centre"))
    return kept(centres, "centres")


def regions_fit(df: DataFrame, k: int, rounds: int = 5, first: Column | None = None) -> DataFrame:
    """Regions of the payloads of every id at once; df has can_id and payload array<double>.

    ``first`` orders the distinct payloads that centres begin with (by default a hash).  Returns can_id, region,
    centre and the 1st and 99th percentile of the members' distances.
    """
    first = F.xxhash64("payload") if first is None else first
    points = kept(df.groupBy("can_id", "payload").agg(F.count("*").alias("n")).select("can_id", F.col("payload").alias("v"), "n", first.alias("_first")), "payloads")
    centres = lloyd(points, ["can_id"], k, rounds)
    bounds = _nearest(points, centres, ["can_id"]).groupBy("can_id", "region").agg(F.percentile("distance", 0.01, F.col("n")).alias("low"), F.percentile("distance", 0.99, F.col("n")).alias("high"))
    return centres.join(bounds, ["can_id", "region"])


def regions_assign(df: DataFrame, centres: DataFrame) -> DataFrame:
    """Nearest region and distance of each message; (-1, infinity) for ids without regions."""
    listed = centres.groupBy("can_id").agg(F.array_sort(F.collect_list(F.struct("region", "centre"))).alias("_c"))
    out = df.join(listed, "can_id", "left").withColumn("_b", _best("payload", "region"))
    return out.withColumn("region", F.coalesce("_b.region", F.lit(-1))).withColumn("distance", F.coalesce("_b.d", F.lit(float("inf")))).drop("_b", "_c")


def bin_of(value: Column, edges: Column) -> Column:
    """Number of edges at or below the value, less one, held in the bins between the edges."""
    return F.least(F.size(edges) - 2, F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e <= value)) - 1))


def region_groups(regions: DataFrame, groups: int, quants: int, bins: int, rounds: int = 5) -> DataFrame:
    """The item of each region of all ids: (can_id, region, centre, grp, quant, low_bin, high_bin, item).

    ``grp`` is a k-means group of centre and bounds, over ids; ``quant`` one of the centre alone; the bins lie
    between the percentiles of all bounds.  Bounds count with nine decimals.
    """
    rows = regions.withColumns({"low": F.round("low", 9), "high": F.round("high", 9), "_first": F.md5(F.concat_ws(":", "can_id", "region")), "n": F.lit(1)})
    rows = kept(rows, "regions")

    def group(v: Column, k: int, name: str) -> DataFrame:
        points = rows.select("can_id", "region", "n", "_first", v.alias("v"))
        centres = lloyd(points.drop("can_id", "region"), [], k, rounds)
        return _nearest(points.withColumnRenamed("region", "own"), centres, []).select("can_id", F.col("own").alias("region"), F.col("region").alias(name))

    shares = F.array(*(F.lit(q / bins) for q in range(bins + 1)))
    edges = rows.select(F.explode(F.array("low", "high")).alias("b")).agg(F.transform(F.percentile("b", shares), lambda e: F.round(e, 9)).alias("_e"))
    coded = rows.join(group(F.concat("centre", F.array("low", "high")), groups, "grp"), ["can_id", "region"]).join(group(F.col("centre"), quants, "quant"), ["can_id", "region"])
    coded = coded.crossJoin(F.broadcast(edges)).withColumns({"low_bin": bin_of(F.col("low"), F.col("_e")), "high_bin": bin_of(F.col("high"), F.col("_e"))})
    item = F.concat(F.lit("R"), "grp", F.lit("_Q"), "quant", F.lit("_B"), "low_bin", F.lit("_"), "high_bin")
    return coded.select("can_id", "region", "centre", "grp", "quant", "low_bin", "high_bin", item.alias("item"))


def message_items(df: DataFrame, coded: DataFrame) -> DataFrame:
    """Messages with the item of their region; null for ids without regions."""
    listed = coded.groupBy("can_id").agg(F.array_sort(F.collect_list(F.struct("region", "centre", "item"))).alias("_c"))
    return df.join(listed, "can_id", "left").withColumn("item", _best("payload", "region", "item")["item"]).drop("_c")


def window_contents(df: DataFrame, size: int, stride: int, *columns: str) -> DataFrame:
    """(window_no, columns, n, last): rows of each kind in each count window of df (row, source_file), and their last file.

    Where the stride divides the size, rows are counted by steps of the stride first, and only the counts stand in
    several windows.
    """
    sums = lambda d, n, *by: d.groupBy(*by, *columns).agg(n.alias("n"), F.max("last").alias("last"))
    rows = df.withColumn("last", F.col("source_file"))
    if size % stride:
        return sums(W.message_count_windows(rows, size, stride), F.count("*"), "window_no")
    steps = sums(rows.withColumn("_step", F.floor(F.col("row") / stride)), F.count("*"), "_step")
    spread = steps.withColumn("window_no", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_step") - (size // stride - 1)), F.col("_step"))))
    return sums(spread, F.sum("n"), "window_no")


def window_items(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct items of each window."""
    return df.where("item IS NOT NULL").select(*keys, "item").distinct()


BITS = 64


def item_masks(items: DataFrame, key: str) -> DataFrame:
    """(chunk, item, mask): the windows of each item as bits, 64 windows a number; items may repeat in a window."""
    bit = F.expr(f"shiftleft(1L, cast(pmod({key}, {BITS}) as int))")
    return items.groupBy(F.floor(F.col(key) / BITS).alias("chunk"), "item").agg(F.bit_or(bit).alias("mask"))


def itemset_support(items: DataFrame, key: str, share: float, most: int = 3) -> DataFrame:
    """Itemsets of up to ``most`` items in at least ceil(share * windows) windows, as sorted arrays, with counts.

    Windows are bits: sets of one item more are ANDs of masks, counted by their bits.  Pairs come from the
    frequent items of a chunk; larger candidates from frequent sets that differ in their last item, if all
    their subsets are frequent.
    """
    masks = kept(item_masks(items, key), "masks")
    total = masks.groupBy("chunk").agg(F.bit_or("mask").alias("m")).agg(F.coalesce(F.sum(F.bit_count("m")), F.lit(0)).alias("n")).first().n
    need = max(1, math.ceil(share * total))
    held = lambda d: d.groupBy("items").agg(F.sum(F.bit_count("mask")).cast("long").alias("n")).where(F.col("n") >= need)
    singles = masks.select("chunk", F.array("item").alias("items"), "mask")
    counts = kept(held(singles), "frequent")
    out = counts
    singles = kept(singles.join(counts.select("items"), "items", "left_semi"), "masks")
    one = singles.select("chunk", F.col("items")[0].alias("item"), F.col("mask").alias("_m"))
    level = singles
    for size in range(2, most + 1):
        if size == 2:
            wider = level.join(one, "chunk").where(F.col("item") > F.col("items")[0])
        else:
            a, b = counts.select(F.slice("items", 1, size - 2).alias("head"), "items"), counts.select(F.slice("items", 1, size - 2).alias("head"), F.element_at("items", -1).alias("item"))
            joined = a.join(b, "head").where(F.col("item") > F.element_at("items", -1)).select("items", "item")
            for drop in range(size - 2):
                subset = F.concat(F.slice("items", 1, drop), F.slice("items", drop + 2, size), F.array("item"))
                joined = joined.withColumn("_s", subset).join(counts.select(F.col("items").alias("_s")), "_s", "left_semi").drop("_s")
            wider = level.join(joined, "items").join(one, ["chunk", "item"])
        both = F.col("mask").bitwiseAND(F.col("_m"))
        level = wider.select("chunk", F.concat("items", F.array("item")).alias("items"), both.alias("mask")).where("mask != 0")
        counts = held(level)
        if size < most:
            level = kept(level, "masks")
            counts = kept(held(level), "frequent")
        out = out.unionByName(counts)
    return out


def window_itemsets(items: DataFrame, key: str) -> DataFrame:
    """All itemsets of one or two items of each window."""
    pairs = items.alias("a").join(items.alias("b"), key).where("a.item < b.item").select(key, F.array("a.item", "b.item").alias("items"))
    return items.select(key, F.array("item").alias("items")).unionByName(pairs)


def chi_square_shift(windows_ids: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Per window: sum (o - e)^2 / e over all known ids (absent ones count 0) and whether it exceeds 3.84 max(k - 1, 1).

    Absent ids contribute just their expected count, so only ids that occur are
    joined: sum over present (o - e)^2 / e + n (1 - share of the present).
    """
    known = windows_ids.join(baseline, "can_id")
    n = F.sum("o")
    per = known.groupBy(key).agg(n.alias("n"), F.collect_list(F.struct("o", "share")).alias("x"), F.sum("share").alias("covered"))
    k = baseline.agg(F.count("*").alias("k"))
    present = F.expr("aggregate(x, 0D, (s, v) -> s + power(v.o - n * v.share, 2) / (n * v.share))")
    out = per.withColumn("chi2", present + F.col("n") * (1 - F.col("covered"))).crossJoin(F.broadcast(k))
    return out.select(key, "chi2", (F.col("chi2") > 3.84 * F.greatest(F.col("k") - 1, F.lit(1))).alias("shifted"))


def legal_counts(items: DataFrame, legal: DataFrame, key: str) -> DataFrame:
    """(key, found): how many of the legal sets of one or two items each window holds; pairs are ANDs of masks."""
    masks = kept(item_masks(items, key), "masks")
    ones = legal.where(F.size("items") == 1).select(F.col("items")[0].alias("item"))
    twos = legal.where(F.size("items") == 2).select(F.col("items")[0].alias("item"), F.col("items")[1].alias("_b"))
    second = masks.select("chunk", F.col("item").alias("_b"), F.col("mask").alias("_m"))
    pairs = masks.join(twos, "item").join(second, ["chunk", "_b"]).select("chunk", F.col("mask").bitwiseAND(F.col("_m")).alias("mask"))
    found = masks.join(ones, "item", "left_semi").select("chunk", "mask").unionByName(pairs)
    bits = F.expr(f"filter(sequence(0, {BITS - 1}), b -> getbit(mask, b) = 1)")
    return found.select("chunk", F.explode(bits).alias("bit")).groupBy((F.col("chunk") * BITS + F.col("bit")).alias(key)).agg(F.count("*").alias("found"))


def rules_score(items: DataFrame, legal: DataFrame, unknown: DataFrame, shifted: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Window score: unknown id or shifted distribution 1; no items 0; else the share of its sets of one or two items that are not legal."""
    n = F.col("n_items")
    every = items.groupBy(key).agg(F.count_distinct("item").alias("n_items")).withColumn("sets", n + n * (n - 1) / 2)
    share = every.join(legal_counts(items, legal, key), key, "left").select(key, ((F.col("sets") - F.coalesce("found", F.lit(0))) / F.col("sets")).alias("missing"))
    out = windows.select(key).distinct().join(share, key, "left").join(unknown.select(key).distinct().withColumn("_u", F.lit(True)), key, "left").join(shifted.where("shifted").select(key, F.lit(True).alias("_s")), key, "left")
    return out.select(key, F.when(F.col("_u") | F.col("_s"), 1.0).otherwise(F.coalesce("missing", F.lit(0.0))).alias("score"))

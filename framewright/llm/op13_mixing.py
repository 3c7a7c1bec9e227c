"""Mixing sources to target weights by Sainte-Lague apportionment.  DataFrame functions only.

1. Targets.  Sources in the order of their code points, null last, have the
   weights in turn and share all words by weight.  A target ends at ``REPEATS``
   times its source's words; the excess is shared again by weight until none is
   above (some rounds of one aggregate over the sources).
2. Blocks.  A source's documents are dealt to shards of about ``SHARD_ROWS`` by a
   hash of id and size.  A shard's words, in seeded order of its documents, are
   cut in equal blocks of about ``BLOCK`` words.
3. Apportionment.  A seat is a block taken once.  Sources win seats by the highest
   quotients votes / (2k + 1) of their targets, counted in their own blocks; then
   the seats of a source go to its shards in the same way, by their blocks.  The
   divisor of all seats lies between bounds known from the sums, so quotients above
   them are counted and only those within, at most about two a party, are ranked.
   A source whose target is its limit has every block taken ``REPEATS`` times.
4. Seeded selection.  A quota takes all n blocks quota // n times, and those first
   in the shard's seeded order once more: block j is (a j + b) mod n-th, a prime to n.

Ranks among all sources come from ranges of the order and running counts of the
ranges, so no task holds all of them.  Only (id, source, size) is shuffled.

Defined cases: null text has no words; a null source is a source of its own, the
last one; documents without words, and all of a table without words, take 0; equal
(id, size) rows of a source stand side by side, in any order; equal quotients go to
the smaller source or shard; texts of any length count whole; an empty table gives no rows;
other columns are ignored.  Equal seeds give equal results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_col, written

WEIGHTS, REPEATS, BLOCK, SHARD_ROWS, SEED = (5, 2, 1), 3, 16, 20_000, "mix"


def draw(*parts: str | Column) -> Column:
    """A number below 2**32 from an MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts))), 1, 8), 16, 10).cast("long")


def div(a: Column, b: Column) -> Column:
    """Whole division of whole numbers."""
    return F.call_function("div", a, b)


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """The rows with their place in an order, from 0: places within ranges of the order, behind the ranges before."""
    held = written(rows.withColumn("_by", F.struct(*order)).repartitionByRange(F.col("_by")).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_by")) - 1
    return held.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_place")).cast("long")).drop("_by", "_range", "_place", "_before")


def share(sources: DataFrame, weights: Sequence[int], repeats: int) -> DataFrame:
    """(source, size, rank) with weight, target, and whether the target is the limit; the targets add up to all sizes."""
    of_rank = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = written(sources.withColumn("weight", of_rank.cast("long")), "sources")
    limit = F.col("size") * repeats
    whole = F.lit(0).cast("decimal(38,0)")
    rest, open_weight, before = 0, 0, None
    full = F.lit(False)
    while True:
        sums = rows.agg(F.sum("size").alias("all"), F.sum(F.when(full, limit)).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count_if(full).alias("n")).first()
        rest, open_weight = int(sums.all or 0) - int(sums.fixed or 0), int(sums.open or 0)
        if sums.n == before:
            break
        before = sums.n
        # above or at the limit by shares of what is left; limits once reached stay reached
        full = F.col("weight") * (whole + rest) >= limit * (whole + open_weight) if open_weight else F.lit(True)
    target = F.when(full, limit.cast("double")).otherwise((F.col("weight") * F.lit(rest)).cast("double") / F.lit(open_weight or 1))
    return rows.select("source", "size", "rank", full.alias("full"), target.alias("target"))


def apportion(parties: DataFrame, seats: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sainte-Lague: the seats of each group go to the highest quotients votes / (2k + 1) of its parties.

    ``parties`` has (grp, votes, and more), ``seats`` (grp, seats); equal quotients go to the first in ``order``.
    Adds quota.
    """
    sums = parties.groupBy("grp").agg(F.sum("votes").alias("_votes"), F.count("*").alias("_parties"))
    bounds = sums.join(seats, "grp").select(
        "grp", F.col("seats"), (F.col("_votes") / (2 * F.col("seats") + F.col("_parties")) * (1 - 1e-9)).alias("_low"),
        F.when(2 * F.col("seats") > F.col("_parties"), F.col("_votes") / (2 * F.col("seats") - F.col("_parties")) * (1 + 1e-9)).alias("_high"),
    )
    won = lambda t: F.floor((F.col("votes") / t + 1) / 2)  # noqa: E731  (quotients of at least t)
    rows = parties.join(bounds, "grp", "left").withColumn("_sure", F.coalesce(won(F.col("_high")), F.lit(0))).withColumn("_most", F.greatest("_sure", F.coalesce(won(F.col("_low")), F.lit(0))))
    rows = written(rows, "bounds")
    left = rows.groupBy("grp").agg((F.first("seats") - F.sum("_sure")).alias("_left"))
    offers = rows.where("_most > _sure").select("grp", *order, "votes", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("k"))
    ranked = numbered(offers, [F.col("grp"), (-F.col("votes") / (2 * F.col("k") + 1)).alias("q"), *(F.col(c) for c in order), F.col("k")], "place")
    first = ranked.groupBy("grp").agg(F.min("place").alias("_first"))
    more = ranked.join(first, "grp").join(left, "grp").where("place - _first < _left").groupBy("grp", *order).agg(F.count("*").alias("_more"))
    return rows.join(more, ["grp", *order], "left").withColumn("quota", F.col("_sure") + F.coalesce("_more", F.lit(0))).drop("_low", "_high", "_sure", "_most", "_more", "seats")


def prime_to(n: Column, seed: Column) -> Column:
    """A number below n (1 if n < 3) that shares no divisor with n: the first of the candidates behind a seeded one."""
    start = F.pmod(seed, n)
    divisor = lambda a: F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(a.alias("x"), n.alias("y")), lambda s, _: F.struct(F.when(s.y == 0, s.x).otherwise(s.y).alias("x"), F.when(s.y == 0, F.lit(0).cast("long")).otherwise(s.x % s.y).alias("y"))).x
    found = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.pmod(start + k, n)), lambda a: divisor(a) == 1)
    return F.coalesce(F.get(found, F.lit(0)), F.lit(1).cast("long"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, with its source."""
    size = F.size(F.array_remove(F.split(text_col(), r"[ \t-\r]+"), "")).cast("long")
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    ranked = numbered(per_source, [F.col("source").isNull().alias("last"), F.col("source")], "rank")
    ranked = written(ranked, "ranked")
    targets = written(share(ranked.select("source", "size", "rank"), weights, repeats), "targets")
    shards = ranked.select("source", "rank", F.ceil(F.col("n") / shard_rows).alias("shards"))
    of_source = F.broadcast if ranked.count() <= 500_000 else (lambda df: df)
    dealt = rows.join(of_source(shards), rows.source.eqNullSafe(shards.source)).select("doc_id", "rank", "size", F.pmod(draw(seed, "shard", F.col("doc_id"), F.col("size")), F.col("shards")).alias("shard"))
    dealt = written(dealt, "dealt")

    cut = dealt.where("size > 0").groupBy("rank", "shard").agg(F.sum("size").alias("words")).withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("words") / block)).cast("long"))
    cut = written(cut, "shards")
    blocks = cut.groupBy("rank").agg(F.sum("blocks").alias("blocks"))
    parties = targets.join(blocks, "rank").select(F.lit(0).alias("grp"), "rank", "full", (F.col("target") * F.col("blocks") / F.col("size")).alias("votes"))
    seats = parties.groupBy("grp").agg(F.round(F.sum(F.col("votes").cast("decimal(28,6)"))).cast("long").alias("seats"))
    of_sources = written(apportion(parties, seats, ["rank"]).select("rank", "full", "quota"), "quotas")
    of_shards = apportion(cut.select(F.col("rank").alias("grp"), "shard", "words", "blocks", F.col("blocks").cast("double").alias("votes")), of_sources.select(F.col("rank").alias("grp"), F.col("quota").alias("seats")), ["shard"])
    limit = F.col("blocks") * repeats
    quota = F.when(F.col("full"), limit).otherwise(F.least("quota", limit))
    plan = of_shards.withColumnRenamed("grp", "rank").join(of_sources.select("rank", "full"), "rank").select(
        "rank", "shard", "words", "blocks", div(quota, F.col("blocks")).alias("times"), (quota % F.col("blocks")).alias("more"),
        prime_to(F.col("blocks"), draw(seed, "a", F.col("rank"), F.col("shard"))).alias("a"), F.pmod(draw(seed, "b", F.col("rank"), F.col("shard")), F.col("blocks")).alias("b"),
    )
    plan = written(plan, "plan")

    line = Window.partitionBy("rank", "shard").orderBy(draw(seed, F.col("doc_id"), F.col("size")), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.where("size > 0").withColumn("end", F.sum("size").over(line)).join(plan, ["rank", "shard"])
    words, n = F.col("words"), F.col("blocks")
    begin, end = F.col("end") - F.col("size"), F.col("end")
    of_word = lambda p: div((p + 1) * n - 1, words)
    edge = lambda j: div(j * words, n)
    chosen = F.filter(F.sequence(of_word(begin), of_word(end - 1)), lambda j: F.pmod(F.col("a") * j + F.col("b"), n) < F.col("more"))
    extra = F.aggregate(chosen, F.lit(0).cast("long"), lambda s, j: s + F.least(edge(j + 1), end) - F.greatest(edge(j), begin))
    taken = placed.select("doc_id", "rank", "size", (F.col("times") * F.col("size") + F.when(F.col("more") > 0, extra).otherwise(0)).alias("taken"))
    taken = taken.unionByName(dealt.where("size = 0").select("doc_id", "rank", "size", F.lit(0).cast("long").alias("taken")))
    return taken.join(of_source(targets.select("rank", "source", F.col("size").alias("source_size"), "target")), "rank").select("doc_id", "size", "source_size", "target", "taken", "source")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: all documents, weights 5, 2, 1 in turn, at most three times each."""
    return mix(table(spark, sf_dir, "documents")).drop("source")


def _draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5({" || ':' || ".join(parts)}), 1, 8) AS BIGINT)"


_ID = "coalesce(CAST(doc_id AS VARCHAR), '-')"

SQL = {
    "op13_mixing": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, CAST(ceil(count(*) / {SHARD_ROWS}) AS BIGINT) AS shards, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, {list(WEIGHTS)}[rank % {len(WEIGHTS)} + 1] AS weight, {REPEATS} * size AS lim FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY lim / weight, rank) AS pos FROM w),
l AS (SELECT *, (SELECT sum(size) FROM w) - sum(lim) OVER (ORDER BY pos) + lim AS rest, sum(weight) OVER (ORDER BY pos DESC) AS open FROM o),
f AS (SELECT min(pos) AS pos FROM l WHERE lim * open > weight * rest),
t AS (
  SELECT source, rank, size, shards, (f.pos IS NULL OR l.pos < f.pos) AS whole,
         CASE WHEN f.pos IS NULL OR l.pos < f.pos THEN CAST(lim AS DOUBLE) ELSE CAST(weight * (SELECT rest FROM l, f WHERE l.pos = f.pos) AS DOUBLE) / (SELECT open FROM l, f WHERE l.pos = f.pos) END AS target
  FROM l, f
),
x AS (SELECT r, doc_id, rank, d.size, {_draw("'mix'", "'shard'", _ID, "d.size")} % shards AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT rank, shard, CAST(sum(size) AS BIGINT) AS words, CAST(greatest(1, round(sum(size) / {BLOCK})) AS BIGINT) AS blocks FROM x WHERE size > 0 GROUP BY rank, shard),
v AS (SELECT rank, whole, target * sum(blocks) / t.size AS votes FROM c JOIN t USING (rank) GROUP BY rank, whole, target, t.size),
n AS (SELECT CAST(round(sum(CAST(votes AS DECIMAL(28, 6)))) AS BIGINT) AS seats FROM v),
u AS (SELECT rank, row_number() OVER (ORDER BY votes / (2 * k + 1) DESC, rank, k) AS place FROM (SELECT rank, votes, unnest(range(CAST(2 * votes + 9 AS BIGINT))) AS k FROM v)),
q AS (SELECT rank, whole, count(place) AS seats FROM v LEFT JOIN (SELECT rank, place FROM u, n WHERE place <= seats) USING (rank) GROUP BY rank, whole),
y AS (SELECT rank, shard, row_number() OVER (PARTITION BY rank ORDER BY CAST(blocks AS DOUBLE) / (2 * k + 1) DESC, shard, k) AS place FROM (SELECT rank, shard, blocks, unnest(range(4 * blocks + 9)) AS k FROM c)),
z AS (SELECT rank, shard, count(*) AS won FROM y JOIN q USING (rank) WHERE place <= seats GROUP BY rank, shard),
p AS (
  SELECT rank, shard, words, blocks, CASE WHEN whole THEN {REPEATS} * blocks ELSE least({REPEATS} * blocks, coalesce(won, 0)) END AS quota,
         {_draw("'mix'", "'a'", "rank", "shard")} AS a, {_draw("'mix'", "'b'", "rank", "shard")} % blocks AS b
  FROM c JOIN q USING (rank) LEFT JOIN z USING (rank, shard)
),
g AS (SELECT * REPLACE (coalesce(list_filter(list_transform(range(64), lambda k: (a % blocks + k) % blocks), lambda k: gcd(k, blocks) = 1)[1], 1) AS a) FROM p),
e AS (SELECT r, rank, shard, size, sum(size) OVER (PARTITION BY rank, shard ORDER BY {_draw("'mix'", _ID, "size")}, doc_id NULLS FIRST, size, r) AS until FROM x WHERE size > 0),
b AS (SELECT r, e.rank, e.shard, size, until - size AS a0, until AS b0, unnest(range(CAST(((until - size + 1) * blocks - 1) // words AS BIGINT), CAST((until * blocks - 1) // words + 1 AS BIGINT))) AS j FROM e JOIN g ON e.rank = g.rank AND e.shard = g.shard),
k AS (
  SELECT r, sum(least((j + 1) * words // blocks, b0) - greatest(j * words // blocks, a0)) AS extra
  FROM b JOIN g USING (rank, shard) WHERE (a * j + b) % blocks < quota % blocks GROUP BY r
)
SELECT doc_id, x.size, t.size AS source_size, target, CAST(CASE WHEN x.size = 0 THEN 0 ELSE quota // blocks * x.size + coalesce(extra, 0) END AS BIGINT) AS taken
FROM x JOIN t USING (rank) LEFT JOIN g USING (rank, shard) LEFT JOIN k USING (r)
"""
}

"""Filter interaction audit from failing-id relations.

Every filter has a table of the ids that fail it.  What a filter does at a step
depends on the set of filters before it, so the relations are computed for sets
and read for orders:

1. Survivors: ``(prefix, id)`` starts with the empty prefix and is doubled filter
   by filter; the prefixes that hold a filter are those without it, left-anti
   joined with the filter's id table.  Rows that fail no filter survive every
   prefix: they are counted per part and stay out of the joins.
2. Removals: the survivors of a prefix, left-semi joined with the next filter's id
   table.
3. Redundancies: the filter's id table for every prefix, left-anti joined with the
   removals.  Unique failures are the removals behind all other filters.
4. Label losses: the removals, left-semi joined with the ids of each label.

Survivors and removals are written to the shared folder; what comes after are
counts of at most (filters * prefixes) rows a part.

Defined cases: a null text is empty and a null lang an empty part; a null id has
no smaller one and no label; ids may repeat, because rows are named by numbers of
their own; a label counts if any of an id's label rows has it; texts of any
length are judged whole; texts are compared by SHA-256; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, spread_join, table, text_col, written

FILTERS = "ABCDE"
SPACES = r"[ \t-\r]+"


def conditions() -> dict[str, Column]:
    """What fails each filter that looks at one text (columns text, words)."""
    n, kinds = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return {"A": n < 100, "B": 100 * kinds < 80 * n, "C": 100 * capitals > 10 * F.length("text"), "D": F.col("text").rlike("[#$%&*|]")}


def failing_ids(docs: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(row, doc_id, part) of every document, and for each filter the (row, part) of those that fail it."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_col().alias("text"))
    source = source.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    alone = conditions()
    fails = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in alone.items())))
    rows = written(source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), fails.alias("fails")), "rows")
    repeated = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = spread_join(rows.select("row", "part", "doc_id", "key"), written(repeated, "repeated"), ["key"], "n", rows.count(), "inner").where("doc_id > least")
    each = rows.select("row", "part", F.explode("fails").alias("filter")).unionByName(copies.select("row", "part", F.lit("E").alias("filter")))
    each = written(each, "failing")
    return rows.select("row", "doc_id", "part"), {name: each.where(F.col("filter") == name).select("row", "part") for name in FILTERS}


def audit(rows: DataFrame, failing: Mapping[str, DataFrame], labels: Mapping[str, DataFrame]) -> DataFrame:
    """Every part, order and step of the filters.

    ``rows`` has (row, part) of all rows, ``failing`` the (row, part) that fail each filter, by names of one
    letter, ``labels`` the (row) that carry each label, whose losses become columns of their names.
    """
    names = list(failing)
    bit = {name: 1 << k for k, name in enumerate(names)}
    every = (1 << len(names)) - 1
    touched = None
    for ids in failing.values():
        touched = ids if touched is None else touched.unionByName(ids)
    spark, folder = rows.sparkSession, shared_dir(rows.sparkSession, "survivors")
    found = touched.distinct().withColumn("prefix", F.lit(0))
    for level, name in enumerate(["", *names]):
        if name:
            found = alive.join(failing[name].select("row"), "row", "left_anti").withColumn("prefix", F.col("prefix") + bit[name])
        found.write.parquet(f"{folder}/level={level}")
        alive = spark.read.schema("row long, part string, prefix int, level int").parquet(folder).drop("level")

    removed = redundant = None
    for name, ids in failing.items():
        before = alive.where(F.col("prefix").bitwiseAND(F.lit(bit[name])) == 0)
        gone = before.join(ids.select("row"), "row", "left_semi").withColumn("filter", F.lit(name))
        removed = gone if removed is None else removed.unionByName(gone)
        others = F.array(*(F.lit(s) for s in range(every + 1) if not s & bit[name]))
        all_prefixes = ids.select("row", "part", F.explode(others).alias("prefix"), F.lit(name).alias("filter"))
        redundant = all_prefixes if redundant is None else redundant.unionByName(all_prefixes)
    removed = written(removed, "removed")
    redundant = redundant.join(removed.select("row", "prefix", "filter"), ["row", "prefix", "filter"], "left_anti")

    kinds = {"removed": removed, "redundant": redundant} | {name: removed.join(ids.select("row"), "row", "left_semi") for name, ids in labels.items()}
    counted = None
    for kind, found in kinds.items():
        part = found.groupBy("part", "filter", "prefix").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        counted = part if counted is None else counted.unionByName(part)
    counts = counted.groupBy("part", "filter", "prefix").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in kinds))
    left = alive.groupBy("part", F.col("prefix").alias("after")).agg(F.count("*").alias("left"))
    clean = rows.groupBy("part").agg(F.count("*").alias("rows")).join(alive.where("prefix = 0").groupBy("part").agg(F.count("*").alias("touched")), "part", "left")

    steps = []
    for order in permutations(names):
        prefix = 0
        for k, name in enumerate(order):
            steps.append({"filter_order": "".join(order), "step": k + 1, "filter": name, "prefix": prefix, "after": prefix | bit[name]})
            prefix |= bit[name]
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:string,prefix:int,after:int>>")
    out = clean.select("part", (F.col("rows") - F.coalesce("touched", F.lit(0))).alias("clean"), F.explode(listed).alias("s")).select("part", "clean", "s.*")
    out = out.join(counts, ["part", "filter", "prefix"], "left").join(left, ["part", "after"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    own = Window.partitionBy("part", "filter")  # one row an order
    alone = F.max(F.when(F.col("prefix") == F.lit(every) - F.element_at(F.create_map(*(F.lit(x) for pair in bit.items() for x in pair)), F.col("filter")), F.col("removed")))
    return out.select(
        "part", "filter_order", "step", (F.col("clean") + zero(F.col("left"))).alias("kept"), zero(F.col("removed")).alias("removed"), zero(F.col("redundant")).alias("redundant"),
        zero(alone.over(own)).alias("unique_fails"), *(zero(F.col(name)).alias(name) for name in labels), zero(F.sum("removed").over(own)).alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters of the contract in all orders, per lang, with losses of good and of toxic documents."""
    rows, failing = failing_ids(docs)
    known = rows.where(F.col("doc_id").isNotNull()).select("row", "doc_id")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    losses = {name: written(known.join(marked.where(F.col(column) == 1).select("doc_id"), "doc_id", "left_semi").select("row"), name) for name, column in (("good_lost", "quality"), ("toxic_lost", "toxic"))}
    return audit(rows.select("row", "part"), failing, losses)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: all documents, all 120 orders of five filters."""
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = {
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * list_unique(w) < 80 * len(w) THEN 2 ELSE 0 END
       + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
       + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
       + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m,
       CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS good,
       CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END AS toxic
  FROM d
),
g AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, m),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b)),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM l a, l b, l c, l d, l e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31
),
s AS (SELECT filter_order, k AS step, bits[k] AS b, list_sum([0] || bits[:k-1]) AS p FROM o, range(1, 6) r(k)),
x AS (
  SELECT part, filter_order, step, b,
         sum(CASE WHEN m & (p | b) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & p = 0 AND m & b > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN m & p > 0 AND m & b > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = b THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN m & p = 0 AND m & b > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN m & p = 0 AND m & b > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, (SELECT filter_order, step, b, CAST(p AS INTEGER) AS p FROM s) GROUP BY part, filter_order, step, b
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
FROM x
"""
}

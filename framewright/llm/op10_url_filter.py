"""URL filters as a sort-merge range join.

A host becomes its labels in reverse order, each followed by a dot
(``www.example.com`` is ``com.example.www.``), so a rule's host and all its
subdomains are one interval of keys: those that start with the rule's key.
Pages are range-partitioned and sorted by (key, path, page_id), so that the
pages of one hot host spread over partitions; a sweep over the sorted pages
keeps the stack of rules whose intervals hold the present key.  Intervals nest,
so a rule leaves the stack once a key no longer starts with its key.  Of the
active rules whose path starts the url's path, the one with the longest
``host + path`` wins (then the longer host).

Rules go to the tasks in blocks of at most ``RULE_BYTES``; with more rules the
same sorted pages are swept once a block, keeping the better rule by the same
order, so block sizes change nothing.

Defined cases: a null url or one without ``://`` has empty host and path and no
rule; very long urls are judged whole; a rule without a host or null takes no
part; repeated rules act once, and of equal rules with different verdicts the
first verdict in the alphabet holds; repeated pages give repeated rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: host, path, verdict; the values of the contract
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
RULE_BYTES = 16 << 20
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path and the canonical key of the host."""
    at = F.instr(F.col("url"), "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return (
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
        .select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
        .select("page_id", F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), UPPER, LOW).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
        .withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")))
    )


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def _blocks(rules: list[tuple[str, str, str]], limit: int):
    """Rules sorted by key, in blocks of bounded size."""
    rows = sorted({(host_key(h), h, p or "", v) for h, p, v in rules if h})
    block, held = [], 0
    for r in rows:
        if block and held + len(r[0]) + len(r[2]) + 64 > limit:
            yield block
            block, held = [], 0
        block.append(r)
        held += len(r[0]) + len(r[2]) + 64
    yield block


def _sweep(block: list[tuple[str, str, str, str]]):
    keys = [r[0] for r in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[int] = []
        active: list[int] = []
        nxt, last = 0, None
        for batch in batches:
            rule, verdict, of_host = (batch.column(k).to_pylist() for k in (4, 5, 6))
            for n, (key, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if key != last:
                    while nxt < len(keys) and keys[nxt] <= key:  # intervals that have begun
                        while stack and not keys[nxt].startswith(keys[stack[-1]]):
                            stack.pop()
                        stack.append(nxt)
                        nxt += 1
                    while stack and not key.startswith(keys[stack[-1]]):
                        stack.pop()
                    active, last = sorted(stack, key=lambda k: (len(block[k][1]) + len(block[k][2]), len(block[k][1])), reverse=True), key
                for k in active:
                    if path.startswith(block[k][2]):
                        mine = block[k][1] + block[k][2]
                        if rule[n] is None or (len(mine), len(block[k][1])) > (len(rule[n]), of_host[n]):
                            rule[n], verdict[n], of_host[n] = mine, block[k][3], len(block[k][1])
                        break
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(of_host, pa.int32())], names=batch.schema.names)

    return run


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow", rule_bytes: int = RULE_BYTES) -> DataFrame:
    """page_id, host, path, the winning rule (``host + path``) and the verdict; without a rule the default holds."""
    none = F.lit(None).cast("string")
    rows = url_parts(pages).select("page_id", "key", "host", "path", none.alias("rule"), none.alias("verdict"), F.lit(None).cast("int").alias("of_host"))
    rows = rows.repartitionByRange("key", "path", "page_id").sortWithinPartitions("key", "path", "page_id")
    for block in _blocks(rules, rule_bytes):
        rows = rows.mapInArrow(_sweep(block), rows.schema)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: a verdict on every page."""
    return judge_urls(table(spark, sf_dir, "pages"))


SQL = {
    "op10_url_filter": rf"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
),
u AS (
  SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOW}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
),
rules(h, pre, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
best AS (
  SELECT r, arg_max(h || pre, length(h || pre)) AS rule, arg_max(v, length(h || pre)) AS verdict
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY r
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN best USING (r)
"""
}

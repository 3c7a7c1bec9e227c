"""MinHash near-dedup from bottom-k sketches of one hash function.

A document's set is its distinct shingles of ``words`` words (the whole word
sequence if it has fewer).  Documents with equal sets form a class at once; all
further work is on one text a class.

1. Sketch: the ``KEEP`` smallest hashes of the set.
2. Inverted lists of the retained values, over all classes.  A class publishes
   its values from the rarest list on.  Two sets of similarity 0.8 share at
   least ``SHARED`` of ``KEEP`` retained values (for sketches that hold the whole
   set the bound is exact), so sharing one of the first
   ``KEEP - SHARED + 1`` published values is necessary.  Values of a passage
   that very many documents share come last and are seldom published.
3. Lists of up to ``LIST_ROWS`` members generate pairs; the similarity estimated
   from the bottom-k sketch of the union must reach ``SHARED / KEEP``, too.  Longer
   lists, which only near copies of one text form, link every member with the
   smallest.  Values of the union's sketch in both sets are in both sketches, so
   one chance covers both bounds: at similarity 0.8, 27 or fewer of 64 have a
   chance of 3.4e-11 a pair (binomial).
4. Connected candidates are brought together by their texts.  Buckets of bounded
   size search all links among their members on full sets, by exact Jaccard, with
   shingles told apart by their words and not by hashes.
   Candidates beyond ``GROUP_SHINGLES`` are cut in blocks; every pair of blocks
   is searched, so no link is lost, and the components are joined afterwards.

Hashes of words and shingles depend on a secret seed of the job; classes of equal
sets are told apart by their sizes and two 64-bit sums of such hashes.

Defined cases: null or wordless texts have an empty set and are linked with
nothing; a null doc_id never names a component that has another id and is never
kept; repeated rows are linked; very long texts and words are taken whole; equal
hashes of a sketch are one value, and equally rare lists are published in the order
of their values; an empty table gives no rows; other columns are ignored.
``connected`` raises an error if components have not settled after 30 rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _P2, LOWER, NONSPACE, draw_seed, expand, flat, mix, pieces, return_arrays, sequence_hashes, small_side, table, text_col, word_array, words, written

SHINGLE, NUM, DEN = 4, 80, 100
KEEP, SHARED, LIST_ROWS = 64, 28, 48
BUCKET_SHINGLES, GROUP_SHINGLES = 400_000, 1_500_000


def _places(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, number of words) of the shingles of rows of words."""
    n = np.diff(rows)
    row, nth = expand(np.where(n >= size, n - size + 1, np.minimum(n, 1)))
    return row, rows[:-1][row] + nth, np.minimum(n[row], size)


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of a piece, by row and hash; hashes depend on the seed of the job."""
    return_arrays()
    _, _, h, rows = words(LOWER[buf], offs, NONSPACE, seed)
    row, start, n = _places(rows, size)
    return _distinct(row, sequence_hashes(h, start, n, seed) >> np.uint64(1))


def exact_sets(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the distinct shingles of all texts of a bucket, numbered by their words themselves."""
    return_arrays()
    spelled, rows = [], [np.zeros(1, np.int64)]
    for i, j in pieces(offs):
        low = LOWER[buf[offs[i] : offs[j]]]
        starts, ends, _, own = words(low, offs[i : j + 1] - offs[i], NONSPACE)
        spelled.append(word_array(low, NONSPACE[low], starts, ends))
        rows.append(own[1:] + rows[-1][-1])
    distinct = pa.concat_arrays(spelled).dictionary_encode()
    word = np.append(distinct.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, 0)
    row, start, n = _places(np.concatenate(rows), size)
    value = word[start] if len(start) else np.zeros(0, np.int64)
    for k in range(1, size):
        both = value << 32 | np.where(n > k, word[np.minimum(start + k, len(word) - 1)], 0)
        value = np.unique(both, return_inverse=True)[1].astype(np.int64)
    return _distinct(row, value)


def sketches(docs: DataFrame, size: int, keep: int, seed: int) -> DataFrame:
    """doc_id, key (of the text), number of shingles, hashes of the set, bottom-k sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = flat(batch.column(2))
            for i, j in pieces(offs):
                row, value = shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], size, seed)
                n = np.bincount(row, minlength=j - i)
                edge = np.append(0, np.cumsum(n))
                sums = [np.append(np.uint64(0), np.cumsum(mix(value + np.uint64(s)))) for s in (1, _P2)]
                c1, c2 = ((s[edge[1:]] - s[edge[:-1]]).view(np.int64) for s in sums)
                held = np.minimum(n, keep)
                group, nth = expand(held)
                sketch = value[edge[:-1][group] + nth].astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), pa.array(sketch))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(c1), pa.array(c2), lists], names=["doc_id", "key", "n", "c1", "c2", "sketch"])

    return docs.mapInArrow(run, "doc_id long, key binary, n long, c1 long, c2 long, sketch array<long>")


def connected(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 30) -> DataFrame:
    """node, root: components of a graph by alternating large and small stars, each round written to the shared folder."""
    e = edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).where(F.col("a") != F.col("b")).distinct()
    e, before = written(e, "edges"), None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        large = both.where("b > a").join(low, both.a == low.u).select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(low, large.b == low.u).select("m", "a", "b").select("m", F.explode(F.array("a", "b")).alias("b")).where("m != b").select(F.col("m").alias("a"), "b").distinct()
        e = written(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def link_components(row: np.ndarray, value: np.ndarray, n_rows: int, num: int, den: int) -> np.ndarray:
    """Component number of each set of a bucket, by exact Jaccard; every set is expanded against the unvisited ones."""
    sizes = np.bincount(row, minlength=n_rows)
    edge = np.append(0, np.cumsum(sizes))
    comp = np.full(n_rows, -1, np.int64)
    _, token = np.unique(value, return_inverse=True)

    def lists(open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = open_[row]
        t, r = token[keep], row[keep]
        order = np.argsort(t, kind="stable")
        first = np.append(0, np.cumsum(np.bincount(t, minlength=token.max(initial=-1) + 1)))
        return r[order], first

    open_ = np.ones(n_rows, bool)
    members, first = lists(open_)
    listed, left, label = n_rows, n_rows, 0
    for seed in range(n_rows):
        if comp[seed] >= 0:
            continue
        comp[seed], open_[seed] = label, False
        left -= 1
        queue = [seed]
        while queue:
            x = queue.pop()
            if left * 2 < listed:
                members, first = lists(open_)
                listed = left
            own = token[edge[x] : edge[x + 1]]
            counts = first[own + 1] - first[own]
            if not left or not counts.sum():
                continue
            group, nth = expand(counts)
            other = members[first[own][group] + nth]
            other = other[open_[other]]
            if not len(other):
                continue
            near, both = np.unique(other, return_counts=True)
            near = near[den * both >= num * (sizes[x] + sizes[near] - both)]
            comp[near], open_[near] = label, False
            left -= len(near)
            queue += near.tolist()
        label += 1
    return comp


def _search(size: int, num: int, den: int):
    def run(rows: pa.Table) -> pa.Table:
        buf, offs = flat(rows["text"])
        row, value = exact_sets(buf, offs, size)
        comp = link_components(row, value, len(offs) - 1, num, den)
        keys = rows["key"].combine_chunks()
        _, lead = np.unique(comp, return_index=True)
        return pa.table([keys, keys.take(pa.array(lead[comp]))], names=["key", "root"])

    return run


def near_components(docs: DataFrame, size: int = SHINGLE, num: int = NUM, den: int = DEN, group_shingles: int = GROUP_SHINGLES, bucket_shingles: int = BUCKET_SHINGLES, list_rows: int = LIST_ROWS, seed: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, with the key (SHA-256) of its text."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))
    made = written(sketches(source.select("doc_id", "key", "text"), size, KEEP, draw_seed() if seed is None else seed), "sketches")
    one = Window.partitionBy("key")
    classes = made.where("n > 0").groupBy("n", "c1", "c2").agg(F.min("key").alias("key"), F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"))

    values = classes.select("key", "n", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")
    ranked = values.join(shared, "v").withColumn("nth", F.row_number().over(one.orderBy("m", "v"))).withColumn("common", F.count("*").over(one))
    sketch = F.least(F.col("n"), F.lit(KEEP))
    exact = F.floor((sketch * num + den - 1) / den)  # both sketches hold their whole sets
    needed = F.when(F.col("n") * den <= KEEP * num, exact).otherwise(F.least(F.lit(SHARED), exact))
    published = ranked.where(F.col("nth") + (sketch - F.col("common")) <= sketch - needed + 1).select("v", "key")
    published = written(published, "lists")

    lists = published.groupBy("v").agg(F.count("*").alias("m"), F.min("key").alias("lead")).where("m > 1")
    long_lists = published.join(lists.where(F.col("m") > list_rows), "v").where("key != lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    short = published.join(lists.where(F.col("m") <= list_rows).select("v"), "v")
    pairs = short.select("v", F.col("key").alias("a")).join(short.select("v", F.col("key").alias("b")), "v").where("a < b").select("a", "b").distinct()
    held = classes.select("key", "sketch")
    pairs = pairs.join(held.select(F.col("key").alias("a"), F.col("sketch").alias("sa")), "a").join(held.select(F.col("key").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, KEEP)
    in_both = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    likely = pairs.where(in_both * KEEP >= F.size(union) * SHARED).select("a", "b")
    groups = written(connected(likely.unionByName(long_lists)), "groups")

    size_of = classes.select(F.col("key").alias("node"), "n")
    weighed = groups.join(size_of, "node")
    per_group = weighed.groupBy("root").agg(F.sum("n").alias("held"))
    total = per_group.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("t")).first().t
    buckets = max(1, -(-total // bucket_shingles))
    block = group_shingles // 2
    blocks = F.ceil(F.col("held") / block)
    mine = F.pmod(F.xxhash64("node"), blocks)
    others = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.struct(F.least(o, mine).alias("x"), F.greatest(o, mine).alias("y")))
    alone = F.array(F.struct(F.lit(-1).cast("long").alias("x"), F.pmod(F.xxhash64("root"), F.lit(buckets)).cast("long").alias("y")))
    # small groups share buckets; a group too large for one task goes to every pair of its blocks
    placed = (
        weighed.join(per_group, "root")
        .withColumn("at", F.explode(F.when(F.col("held") > group_shingles, others).otherwise(alone)))
        .select(F.col("node").alias("key"), F.when(F.col("at.x") < 0, F.lit(None)).otherwise(F.col("root")).alias("grp"), F.col("at.x").alias("x"), F.col("at.y").alias("y"))
    )
    # the candidates are few beside the documents: within a bound of rows their keys go to the scan, not the texts to a shuffle
    texts = source.select("key", "text").join(small_side(groups.select(F.col("node").alias("key"))), "key", "left_semi").dropDuplicates(["key"])
    searched = placed.join(texts, "key").groupBy("grp", "x", "y").applyInArrow(_search(size, num, den), "key binary, root binary")
    links = searched.where("key != root").select(F.col("root").alias("a"), F.col("key").alias("b"))
    final = connected(links)
    named = final.join(classes.select(F.col("key").alias("node"), "id"), "node")
    lowest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = named.join(lowest, "root").select(F.col("node").alias("class"), "component_id")
    known = classes.select("n", "c1", "c2", F.col("key").alias("class"), "id").join(of_class, "class", "left").select("n", "c1", "c2", F.coalesce("component_id", "id").alias("component_id"))
    out = made.select("doc_id", "key", "n", "c1", "c2").join(known, ["n", "c1", "c2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "key")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: components of all documents by four-word shingles at Jaccard 0.8."""
    return near_components(table(spark, sf_dir, "documents")).drop("key")


SQL = {
    "op5_minhash_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k+{SHINGLE - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS k FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {DEN} * shared >= {NUM} * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a),
c AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id
"""
}

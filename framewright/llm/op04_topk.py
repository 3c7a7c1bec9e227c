"""Exact top-k search by inner product: a ball tree per shard, branch and bound.

Shards.  Up to ``CENTRES`` centres are fitted on a bounded sample of rows; every
row goes to its nearest centre, and a centre with more than ``SHARD_ROWS`` rows is
dealt to several shards.  A centre and its radius bound every inner product of a
query with its rows: ``q . centre + |q| * radius``.

Search.  Each query visits the shards in the order of their bounds, in a few
rounds: the best centre first, then a few more, then all that are left.  After
each round the kth score it holds is shared with the later ones, and shards whose
bound is below it are not visited.  In a task the rows of a shard come before its
queries; they are made a ball tree (centre, radius, two children), through which
the queries stream in blocks.  Nodes go by the same bound, the larger child first,
and a query leaves a node that can't reach its current kth score.

Scores are integer inner products of ``floor(64 * x)``; ties go to the smaller
vec_id.  Where products could exceed 2**53 they are formed with unbounded
integers; a score beyond the range of a long counts as the nearest long.

Defined cases: vectors that are null, or hold null or non-finite components, and
rows without an id take no part.  Vectors of another length than the query's are
not candidates.  Of repeated rows all but the query's own one are candidates; a
repeated query gives its rows once a repetition.  An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, table, written

K, EVERY, SCALE = 20, 20, 64
SHARD_ROWS, QUERY_ROWS, LEAF_ROWS, BLOCK_ROWS = 16384, 1 << 18, 128, 1024
#: Centres, and rows of the sample that they are fitted on.
CENTRES, SAMPLE = 256, 8192
#: Shards of a query's order that a round visits up to, beside the last round of all.
ROUNDS = (1, 4)
LONG = 2**63 - 1


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, x array<double>, dim; only vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return embeddings.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).withColumn("dim", F.size("x"))


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-numbered doubles, held in the range of a long, as doubles or unbounded integers."""
    if np.abs(q).max(initial=1) * np.abs(x).max(initial=1) * q.shape[1] < 2.0**53:
        return q @ x.T
    big = lambda m: np.array([[int(c) for c in row] for row in m], object).reshape(m.shape)
    return np.clip(big(q) @ big(x).T, -LONG - 1, LONG)


class BallTree:
    """Nodes in arrays; points in the order of the leaves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF_ROWS):
        self.nodes: list[tuple[int, int, int, int]] = []  # first, end, left, right
        centers, radii = [], []
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        perm = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = x[perm[a:b]]
            c = own.mean(axis=0)
            d = np.sqrt(((own - c) ** 2).sum(axis=1))
            me = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            centers.append(c)
            radii.append(d.max() if len(d) else 0.0)
            if parent >= 0:
                p = list(self.nodes[parent])
                p[2 + side] = me
                self.nodes[parent] = tuple(p)
            if b - a > leaf and radii[-1] > 0:
                far = own[d.argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                split = np.argsort(own @ (other - far), kind="stable")
                perm[a:b] = perm[a:b][split]
                mid = (a + b) // 2
                todo += [(mid, b, me, 1), (a, mid, me, 0)]
        self.ids, self.x = ids[perm], x[perm]
        self.centers, self.radii = np.array(centers), np.array(radii)

    def search(self, q: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best k scores and ids of each query, and which of them are filled; scores below the given kth may be left out."""
        n = len(q)
        plain = np.abs(q).max(initial=1) * np.abs(self.x).max(initial=1) * q.shape[1] < 2.0**53
        best = np.full((n, k), -np.inf) if plain else np.full((n, k), -LONG - 1, object)
        who, filled = np.full((n, k), LONG), np.zeros((n, k), bool)
        kth, norm = kth.astype(np.float64), np.sqrt((q**2).sum(axis=1))
        todo = [(0, np.arange(n))]
        while todo:
            node, live = todo.pop()
            a, b, left, right = self.nodes[node]
            live = live[node_bounds(q[live], norm[live], self.centers[node : node + 1], self.radii[node : node + 1])[:, 0] >= kth[live]]
            if not len(live):
                continue
            if left < 0:
                s = exact_products(q[live], self.x[a:b]).astype(best.dtype)
                own = np.concatenate([best[live], s], axis=1)
                ids = np.concatenate([who[live], np.broadcast_to(self.ids[a:b], s.shape)], axis=1)
                real = np.concatenate([filled[live], np.ones(s.shape, bool)], axis=1)
                by = np.argsort(ids, axis=1, kind="stable")
                by = np.take_along_axis(by, np.argsort(-np.take_along_axis(own, by, 1), axis=1, kind="stable"), 1)
                if not plain:  # an empty place has the least score, and comes behind a real one of it
                    by = np.take_along_axis(by, np.argsort(~np.take_along_axis(real, by, 1), axis=1, kind="stable"), 1)
                by = by[:, :k]
                best[live], who[live], filled[live] = (np.take_along_axis(m, by, 1) for m in (own, ids, real))
                held = np.where(filled[live, -1], best[live, -1], -np.inf).astype(np.float64)
                kth[live] = np.maximum(kth[live], held - np.abs(held) * 1e-12)
            else:
                ends = [left, right]
                up = node_bounds(q[live], norm[live], self.centers[ends], self.radii[ends]).sum(axis=0)
                todo += [(left, live), (right, live)] if up[1] >= up[0] else [(right, live), (left, live)]
        return best, who, filled


def node_bounds(q: np.ndarray, norm: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products, never below the true ones by rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        reach = norm[:, None] * (np.sqrt((centers**2).sum(axis=1)) + radii)
        return np.nan_to_num(q @ centers.T + norm[:, None] * radii + 1e-6 + 1e-9 * reach, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def _matrix(col: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles; a vector without components is one zero."""
    if not dim:
        return np.zeros((len(col), 1))
    with np.errstate(over="ignore"):
        return np.floor(np.nan_to_num(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) * scale))


def _by_dim(batch: pa.RecordBatch, x: str, scale: float):
    """(dim, rows, matrix) of each vector length of a batch."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        own = np.flatnonzero(dims == dim)
        yield int(dim), own, _matrix(batch.column(x).take(pa.array(own)), int(dim), scale)


def fit_centres(rows: DataFrame, n: int, shard_rows: int, scale: float) -> dict[int, np.ndarray]:
    """Centres of each vector length from at most ``SAMPLE`` rows in the order of a hash, by two rounds of means."""
    many = min(CENTRES, -(-n // shard_rows))
    out: dict[int, np.ndarray] = {}
    if many < 2:
        return out
    sample = rows.select("dim", "x").orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    for batch in sample.to_batches(max_chunksize=SAMPLE):
        for dim, _, x in _by_dim(batch, "x", scale):
            c = x[:: max(1, len(x) // many)][:many]
            with np.errstate(over="ignore", invalid="ignore"):
                for _ in range(2):
                    own = nearest(x, c)
                    c = np.array([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
            out[dim] = np.nan_to_num(c)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((c**2).sum(axis=1) - 2 * (x @ c.T), nan=np.inf).argmin(axis=1)


POINTS = "vec_id long, x array<double>, dim int, centre int, salt int, far double"
ROUTED = "dim int, centre int, sub int, block int, uid long, vec_id long, x array<double>, kth double"
FOUND = "uid long, vec_id long, score long, own boolean"


def _place(centres: dict[int, np.ndarray], scale: float):
    """Each row's centre, its distance, and a number to deal large centres by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            centre, far = np.zeros(n, np.int32), np.zeros(n)
            for dim, own, x in _by_dim(batch, "x", scale):
                c = centres.get(dim, np.zeros((1, x.shape[1])))
                centre[own] = nearest(x, c)
                with np.errstate(over="ignore", invalid="ignore"):
                    far[own] = np.nan_to_num(np.sqrt(((x - c[centre[own]]) ** 2).sum(axis=1)), nan=np.inf, posinf=np.inf)
            salt = (mix(np.arange(seen, seen + n, dtype=np.uint64) + np.uint64(task << 32)) >> np.uint64(40)).astype(np.int32)
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centre), pa.array(salt), pa.array(far)], names=[*batch.schema.names, "centre", "salt", "far"])

    return run


def _route(shards: dict[int, tuple], centres: dict[int, np.ndarray], first: int, last: int, blocks: int, scale: float):
    """A row for each shard that a query visits in a round: those of its order from ``first`` to ``last`` whose bound reaches its kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, kth = batch.column("uid").to_numpy(), batch.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
            for dim, own, q in _by_dim(batch, "x", scale):
                centre, sub, radius = shards[dim]
                c = centres.get(dim, np.zeros((1, q.shape[1])))[centre]
                bound = node_bounds(q, np.sqrt((q**2).sum(axis=1)), c, radius)
                order = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                row, col = np.nonzero(np.take_along_axis(bound, order, 1) >= np.nan_to_num(kth[own], nan=-np.inf, neginf=-np.inf)[:, None])
                at, rows = order[row, col], own[row]
                for a in range(0, len(rows), BLOCK_ROWS):
                    s, r = at[a : a + BLOCK_ROWS], rows[a : a + BLOCK_ROWS]
                    take = batch.take(pa.array(r))
                    block = (mix(uid[r].view(np.uint64)) % np.uint64(blocks)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [take.column("dim"), pa.array(centre[s].astype(np.int32)), pa.array(sub[s].astype(np.int32)), pa.array(block), take.column("uid"), take.column("vec_id"), take.column("x"), take.column("kth")],
                        names=["dim", "centre", "sub", "block", "uid", "vec_id", "x", "kth"],
                    )

    return run


def _search(k: int, scale: float):
    """Rows sorted by shard, a shard's points (without uid) before its queries: a tree per shard, queries in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, points, tree = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("dim", "centre", "sub", "block")] + [batch.column("uid").is_valid().to_numpy(zero_copy_only=False)], axis=1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip(np.append(0, cut), np.append(cut, len(keys)), strict=True):
                if a == b:
                    continue
                if shard != tuple(keys[a, :4]):
                    shard, points, tree = tuple(keys[a, :4]), [], None
                dim, part = int(shard[0]), batch.slice(a, b - a)
                if not keys[a, 4]:
                    points.append(part.select(["vec_id", "x"]))
                    continue
                if not points:
                    continue
                if tree is None:
                    held = pa.Table.from_batches(points).combine_chunks()
                    tree = BallTree(held["vec_id"].to_numpy(), _matrix(held["x"].combine_chunks(), dim, scale))
                for i in range(0, len(part), BLOCK_ROWS):
                    yield _answers(tree, part.slice(i, BLOCK_ROWS), dim, k, scale)

    return run


def _answers(tree: BallTree, part: pa.RecordBatch, dim: int, k: int, scale: float) -> pa.RecordBatch:
    q = _matrix(part.column("x"), dim, scale)
    kth = part.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
    # each query's own row may stand among the candidates, so one more is kept until the end
    s, who, filled = tree.search(q, np.nan_to_num(kth, nan=-np.inf, neginf=-np.inf), k + 1)
    row, col = np.nonzero(filled)
    own = np.array([exact_products(v[None], v[None])[0, 0] for v in q], object).astype(s.dtype)
    same = (who[row, col] == part.column("vec_id").to_numpy()[row]) & (s[row, col] == own[row])
    score = pa.array([int(v) for v in s[row, col]], pa.int64()) if s.dtype == object else pa.array(s[row, col].astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(part.column("uid").to_numpy()[row]), pa.array(who[row, col].astype(np.int64)), score, pa.array(same.astype(bool))], names=["uid", "vec_id", "score", "own"])


def exact_topk(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row whose id is divisible by ``every``."""
    rows = whole_vectors(embeddings)
    centres = fit_centres(rows, rows.count(), shard_rows, scale)
    points = written(rows.mapInArrow(_place(centres, scale), POINTS), "points")
    # at most CENTRES rows for each length of vectors
    sizes = points.groupBy("dim", "centre").agg(F.count("*").alias("n"), F.max("far").alias("r"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()
    shards: dict[int, tuple] = {}
    for dim in {r.dim for r in sizes}:
        own = [(r.centre, sub, r.r * (1 + 1e-9)) for r in sorted(sizes, key=lambda r: r.centre) if r.dim == dim for sub in range(-(-r.n // shard_rows))]
        shards[dim] = tuple(np.array(x) for x in zip(*own, strict=True))
    most = max((len(s[0]) for s in shards.values()), default=0)
    blocks = max(1, -(-sum(r.q for r in sizes) // query_rows))
    subs = F.create_map(*(F.lit(x) for r in sizes for x in (f"{r.dim} {r.centre}", -(-r.n // shard_rows)))) if sizes else None
    parts = F.element_at(subs, F.concat_ws(" ", F.col("dim").cast("string"), F.col("centre").cast("string"))) if sizes else F.lit(1)
    dealt = points.select("dim", "centre", F.pmod("salt", parts).cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("long").alias("uid"), "vec_id", "x", F.lit(None).cast("double").alias("kth"))

    queries = points.where(F.col("vec_id") % every == 0).groupBy("vec_id", "x", "dim").agg(F.count("*").alias("times"))
    queries = written(queries.withColumn("uid", F.xxhash64("vec_id", "x")), "queries")
    found, first = None, 0
    for last in (*(r for r in ROUNDS if r < most), most):
        asked = queries.select("uid", "vec_id", "x", "dim")
        if found is None:
            asked = asked.withColumn("kth", F.lit(None).cast("double"))
        else:
            # the (k+1)th best of the rows seen can't be beaten by fewer than k+1 rows of the whole
            kth = found.groupBy("uid").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("uid", F.get("s", F.lit(k)).cast("double").alias("kth"))
            asked = asked.join(kth, "uid", "left")
        routed = asked.mapInArrow(_route(shards, centres, first, last, blocks, scale), ROUTED)
        key = ["dim", "centre", "sub", "block"]
        met = dealt.unionByName(routed).repartition(*key).sortWithinPartitions(*key, F.col("uid").isNotNull())
        new = written(met.mapInArrow(_search(k, scale), FOUND), "found")
        found = new if found is None else found.unionByName(new)
        first = last
    by = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    return (
        found.join(queries.select("uid", "times", F.col("vec_id").alias("query_id")), "uid")
        .withColumn("nth_same", F.when(F.col("own"), F.row_number().over(Window.partitionBy("uid", "own").orderBy("vec_id"))).otherwise(0))
        .where(F.col("nth_same") != 1)
        .withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: all rows whose vec_id is divisible by 20 against all rows."""
    return exact_topk(table(spark, sf_dir, "embeddings"))


SQL = {
    "op4_exact_topk": f"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0
),
k AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= {K}
"""
}

"""Suffix-array dedup with run-length indexes.

A byte is removed if a string of ``size`` bytes that covers it also starts at
any other place of any document (overlaps count; judged on the input).  Texts
are UTF-8 bytes; matches never cross documents.

Dealing.  Equal texts are joined first (copies keep their count).  In every
``size``-byte window the ``GRAM``-byte slice with the smallest hash, leftmost at
ties, is its anchor.  Equal windows have equal anchors at the same place, so
windows are grouped by their anchor's hash; consecutive windows with one anchor
are one segment.  Segments with the same bytes are counted: all windows of a
repeated segment are repeated.  Anchors with one kind of segment are then done.

Index.  What remains are the different segments of one anchor, such as the edges
of matches and the variants of near copies.  Buckets of bounded size hold whole
anchor groups.  A task concatenates the bucket's segments, sorts their suffixes,
forms the Burrows-Wheeler transform, and keeps of it only the runs, with text
positions sampled at both ends of each run and the length of the match with
the neighbouring suffix there.  Streaming over the text in order, the matching
statistic at each place follows from the last sample, less one a byte, because
within a run the neighbour's match shrinks by just one byte; the larger of the
two sides is the longest match anywhere else in the bucket.  Windows are marked
where it reaches ``size``.

Hot anchors, whose different segments exceed ``GROUP_BYTES``, are dealt again by
another hash of the slices, segment by segment, up to ``LEVELS`` times, and then
indexed like the others.  Only anchors that no hash can part (one slice in very
many different windows) are counted window by window.  Texts are told apart by
SHA-256, segments and windows by 128-bit BLAKE2 digests; anchors only deal.

Defined cases: null text is empty; texts shorter than ``size`` keep all bytes;
texts beyond ``PIECE_BYTES`` are dealt in parts that overlap by ``size - 1``;
repeated rows are copies of each other; equal hashes of slices go to the leftmost;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE_BYTES, Rolling, expand, flat, mix, pieces, spread_join, table, text_col, written

SIZE, GRAM = 400, 64
BUCKET_BYTES, GROUP_BYTES, LEVELS = 256 << 10, 4 << 20, 4
_LOW = np.uint64((1 << 24) - 1)


def _cuts(buf: np.ndarray, offs: np.ndarray, size: int):
    """(bytes, row offsets, first row, place in the first row): long rows come in parts that overlap by size - 1."""
    for i, j in pieces(offs):
        a, b = int(offs[i]), int(offs[j])
        if b - a <= 2 * PIECE_BYTES:
            yield buf[a:b], offs[i : j + 1] - a, i, 0
        else:
            for p in range(0, b - a - size + 1, PIECE_BYTES):
                part = buf[a + p : min(a + p + PIECE_BYTES + size - 1, b)]
                yield part, np.array([0, len(part)]), i, p


def segments(buf: np.ndarray, offs: np.ndarray, size: int, gram: int, level: int = 0):
    """Windows by anchor: row, first window, number of windows, anchor hash, content digest; each level has its own order of slices."""
    none = np.zeros(0, np.int64)
    if len(buf) < size:
        return none, none, none, none, pa.array([], pa.binary())
    gh = Rolling(buf).every(gram)
    if level:
        gh = mix(gh + np.uint64(level))
    low = (gh & ~_LOW) | np.arange(len(gh), dtype=np.uint64)
    w, m = size - gram + 1, 1
    while 2 * m <= w:
        low = np.minimum(low[:-m], low[m:])
        m *= 2
    n = len(buf) - size + 1
    low = np.minimum(low[:n], low[w - m : w - m + n])
    anchor = (low & _LOW).astype(np.int64)
    many = np.diff(offs) - size + 1
    own = np.flatnonzero(many > 0)
    group, nth = expand(many[own])
    start = offs[own][group] + nth
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (group[1:] != group[:-1])
    lead = np.flatnonzero(new)
    count = np.diff(np.append(lead, len(start)))
    s = start[lead]
    e = s + count - 1 + size
    return own[group[lead]], s, count, gh[anchor[lead]].view(np.int64), digests(buf, s, e)


def digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """128-bit BLAKE2 digests of slices: equal digests are taken for equal bytes."""
    data = buf.tobytes()
    return pa.array([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())


def suffix_order(text: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Suffixes of a byte array in order, by doubling; word: the 8 bytes from each place, big-endian."""
    n = len(text)
    order = np.argsort(word, kind="stable")
    new = np.ones(n, bool)
    new[1:] = word[order][1:] != word[order][:-1]
    lead = np.flatnonzero(new)
    rank = np.zeros(2 * n + 4096, np.int64)  # places after the end come first
    rank[order] = np.repeat(lead, np.diff(np.append(lead, n))) + 1
    k = 8
    while True:
        r = rank[order]
        same, tied = r[1:] == r[:-1], np.zeros(n, bool)
        tied[1:] = same
        tied[:-1] |= same
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order
        at = order[slots]
        nxt = rank[np.minimum(at + k, len(rank) - 1)]
        by = np.lexsort((nxt, rank[at]))
        at, lead_rank, nxt = at[by], rank[at][by], nxt[by]
        order[slots] = at
        new = np.ones(len(at), bool)
        new[1:] = (lead_rank[1:] != lead_rank[:-1]) | (nxt[1:] != nxt[:-1])
        lead = np.flatnonzero(new)
        rank[at] = np.repeat(slots[lead], np.diff(np.append(lead, len(at)))) + 1
        k *= 2


def _match(word: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b."""
    n = len(word)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    x, y = a.copy(), b.copy()
    while len(live):
        ok = (x < n) & (y < n)
        diff = np.where(ok, word[np.minimum(x, n - 1)] ^ word[np.minimum(y, n - 1)], np.uint64(1) << np.uint64(63))
        same = diff == 0
        ended = live[~same]
        d = diff[~same]
        lead = np.zeros(len(d), np.int64)
        for s in (56, 48, 40, 32, 24, 16, 8):
            lead += (d >> np.uint64(s)) == 0
        out[ended] += lead
        live, x, y = live[same], x[same] + 8, y[same] + 8
        out[live] += 8
    return np.minimum(out, n - np.maximum(a, b))


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a text, with samples at the ends of its runs."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        padded = np.append(text, np.zeros(8, np.uint8))
        word = np.zeros(n, np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | padded[k : k + n].astype(np.uint64)
        order = suffix_order(text, word)
        bwt = text[order - 1]
        head = np.ones(n, bool)
        head[1:] = bwt[1:] != bwt[:-1]
        whole = np.flatnonzero(order == 0)  # nothing stands before the text: its own run
        head[whole] = True
        head[(whole + 1)[whole + 1 < n]] = True
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:], n) - 1
        self.n, self.runs = n, len(heads)
        # samples: text position at run heads with the suffix before, at run tails with the suffix after
        self.before = self._sample(word, order, heads, -1)
        self.after = self._sample(word, order, tails, 1)

    @staticmethod
    def _sample(word: np.ndarray, order: np.ndarray, at: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        pos, other = order[at], at + side
        length = np.zeros(len(at), np.int64)
        inside = (other >= 0) & (other < len(order))
        length[inside] = _match(word, pos[inside], order[other[inside]])
        by = np.argsort(pos)
        return pos[by], length[by]

    def statistics(self) -> np.ndarray:
        """Streams over the text: the longest match of each suffix with any other one."""
        best = np.zeros(self.n, np.int64)
        for pos, length in (self.before, self.after):
            last = np.searchsorted(pos, np.arange(self.n), side="right") - 1
            best = np.maximum(best, length[last] - (np.arange(self.n) - pos[last]))
        return best


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


SEGMENTS = "h long, c binary, key binary, s long, n long, copied boolean"
CUT = "h long, key binary, s long, n long, settled boolean, bytes binary, hot boolean"
FINER = "h long, c binary, key binary, s long, n long, settled boolean, bytes binary"
MARKS = "key binary, a long, b long"


def _all_segments(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = flat(batch.column(1))
            copied = batch.column(2).to_numpy(zero_copy_only=False)
            for part, o, i, base in _cuts(buf, offs, size):
                row, s, n, h, c = segments(part, o, size, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), c, batch.column(0).take(pa.array(row + i)), pa.array(s - o[row] + base), pa.array(n), pa.array(copied[row + i])],
                    names=["h", "c", "key", "s", "n", "copied"],
                )

    return run


def _cut_out(size: int):
    """Bytes of the wanted segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = flat(batch.column(1))
            for r, want in enumerate(batch.column(2).to_pylist()):
                data = buf[offs[r] : offs[r + 1]].tobytes()
                key = batch.column(0)[r].as_py()
                rows = [(w["h"], key, w["s"], w["n"], w["settled"], data[w["s"] : w["s"] + w["n"] - 1 + size], w["hot"]) for w in want]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h", "key", "s", "n", "settled", "bytes", "hot"])

    return run


def _split_again(size: int, gram: int, level: int):
    """Segments of hot anchors, cut by the anchors of another level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = flat(batch.column(3))
            for i, j in pieces(offs):
                part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                row, s, n, h, c = segments(part, o, size, gram, level)
                data = part.tobytes()
                own = [data[a : a + k - 1 + size] for a, k in zip(s.tolist(), n.tolist(), strict=True)]
                at = pa.array(row + i)
                start = batch.column(1).to_numpy()[row + i] + s - o[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), c, batch.column(0).take(at), pa.array(start), pa.array(n), batch.column(2).take(at), pa.array(own, pa.binary())],
                    names=["h", "c", "key", "s", "n", "settled", "bytes"],
                )

    return run


def _index_bucket(size: int):
    def run(rows: pa.Table) -> pa.Table:
        buf, offs = flat(rows["bytes"])
        s, n = rows["s"].to_numpy(), rows["n"].to_numpy()
        settled = rows["settled"].to_numpy(zero_copy_only=False).astype(bool)
        sizes = np.diff(offs)
        text = np.full(len(buf) + len(sizes), 255, np.uint8)  # 255 is in no UTF-8 text
        group, nth = expand(sizes)
        begin = offs[:-1] + np.arange(len(sizes))
        text[begin[group] + nth] = buf
        best = RunIndex(text).statistics()
        keys, a, b = [], [], []
        names = rows["key"].to_pylist()
        for k in np.flatnonzero(~settled):
            for x, y in zip(*_runs(best[begin[k] : begin[k] + n[k]] >= size), strict=True):
                keys.append(names[k])
                a.append(int(s[k] + x))
                b.append(int(s[k] + y))
        return pa.table([pa.array(keys, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "a", "b"])

    return run


def _single_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = flat(batch.column(4))
            s, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for i, j in pieces(offs):
                part = buf[offs[i] : offs[j]]
                group, nth = expand(n[i:j])
                at = (offs[i:j] - offs[i])[group] + nth
                row = pa.array(group + i)
                yield pa.RecordBatch.from_arrays(
                    [digests(part, at, at + size), batch.column(0).take(row), pa.array(s[i:j][group] + nth), batch.column(1).take(row)],
                    names=["c", "key", "s", "settled"],
                )

    return run


OUT = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = flat(batch.column(1))
            copied = batch.column(2).to_pylist()
            n_removed, n_spans, sha = [], [], []
            for r, marks in enumerate(batch.column(3).to_pylist()):
                own = buf[offs[r] : offs[r + 1]]
                spans: list[list[int]] = []
                if copied[r] and len(own) >= size:
                    spans = [[0, len(own)]]
                elif marks:
                    for m in sorted((m["a"], m["b"] - 1 + size) for m in marks):
                        if spans and m[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], m[1])
                        else:
                            spans.append([*m])
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(own[at:a].tobytes())
                    at = b
                digest.update(own[at:].tobytes())
                n_removed.append(sum(b - a for a, b in spans))
                n_spans.append(len(spans))
                sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offs)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())],
                names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and whether anything was removed (repeats)."""
    gram = min(gram, size)
    key = F.unhex(F.sha2("text", 256))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text"))
    texts = source.groupBy(key.alias("key")).agg(F.first("text").alias("text"), (F.count("*") > 1).alias("copied"))
    seg = written(texts.where(F.octet_length("text") >= size).mapInArrow(_all_segments(size, gram), SEGMENTS), "segments")
    total = seg.count()
    kinds = seg.groupBy("h", "c").agg((F.max("copied") | (F.count("*") > 1)).alias("settled"), F.count("*").alias("m"), F.min(F.struct("key", "s", "n")).alias("at"))
    parts = [_repeated(seg.where(~F.col("copied")), kinds, total)]
    want = _different(kinds, F.col("at.n") + size - 1, group_bytes, total).select("h", "at.*", "settled", "hot")
    per_text = want.groupBy("key").agg(F.collect_list(F.struct("h", "s", "n", "settled", "hot")).alias("want"))
    cut = written(texts.join(per_text, "key").select("key", "text", "want").mapInArrow(_cut_out(size), CUT), "kinds")

    for level in range(1, LEVELS + 1):
        held = cut.groupBy("hot").agg(F.count("*").alias("n"), F.sum(F.octet_length("bytes")).alias("b")).collect()  # two rows
        held = {r.hot: r for r in held}
        if False in held:
            buckets = max(1, -(-held[False].b // bucket_bytes))
            parts.append(cut.where("not hot").withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))).groupBy("bucket").applyInArrow(_index_bucket(size), MARKS))
        if True not in held:
            break
        hot = cut.where("hot")
        if level == LEVELS:
            single = written(hot.select("key", "settled", "s", "n", "bytes").mapInArrow(_single_windows(size), "c binary, key binary, s long, settled boolean"), "windows")
            often = single.groupBy("c").agg((F.max("settled") | (F.count("*") > 1)).alias("settled"), F.count("*").alias("m"))
            parts.append(_repeated(single.where("not settled").withColumn("n", F.lit(1)), often, single.count(), ["c"]))
            break
        finer = written(hot.select("key", "s", "settled", "bytes").mapInArrow(_split_again(size, gram, level), FINER), "segments")
        total = finer.count()
        kinds = finer.groupBy("h", "c").agg((F.max("settled") | (F.count("*") > 1)).alias("settled"), F.count("*").alias("m"), F.min(F.struct("key", "s", "n", "bytes")).alias("at"))
        parts.append(_repeated(finer.where("not settled"), kinds, total))
        cut = written(_different(kinds, F.octet_length("at.bytes"), group_bytes, total).select("h", "at.*", "settled", "hot"), "kinds")

    marks = parts[0]
    for part in parts[1:]:
        marks = marks.unionByName(part)
    spans = marks.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("marks"))
    kept = texts.join(spans, "key", "left").select("key", "text", "copied", "marks").mapInArrow(_remove(size), OUT)
    return source.select("doc_id", key.alias("key")).join(kept, "key").drop("key").withColumn("repeats", F.col("n_removed") > 0)


def _repeated(places: DataFrame, kinds: DataFrame, total: int, on: list[str] | None = None) -> DataFrame:
    """Marks of the places whose kind is settled."""
    on = on or ["h", "c"]
    return spread_join(places, kinds.where("settled").select(*on, "m"), on, "m", total, "left_semi").select("key", F.col("s").alias("a"), (F.col("s") + F.col("n")).alias("b"))


def _different(kinds: DataFrame, size_of: Column, group_bytes: int, total: int) -> DataFrame:
    """The kinds of anchors that have more than one, and whether these are too large for one task."""
    groups = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.sum(size_of).alias("held")).where(F.col("kinds") > 1)
    groups = written(groups.select("h", "kinds", (F.col("held") > group_bytes).alias("hot")), "groups")
    return spread_join(kinds, groups, ["h"], "kinds", total, "inner")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: repeated strings of 400 bytes in all documents."""
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = {
    "op1_suffix_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, p, md5(x[2*p+1:2*p+{2 * SIZE}]) AS m FROM (SELECT r, x, unnest(range(0, len(x)//2 - {SIZE} + 1)) AS p FROM d WHERE len(x) >= {2 * SIZE})),
again AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
hit AS (SELECT r, p FROM w SEMI JOIN again USING (m)),
step AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + {SIZE} THEN 0 ELSE 1 END AS fresh FROM hit),
lab AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS g FROM step),
span AS (SELECT r, min(p) AS a, max(p) + {SIZE} AS b FROM lab GROUP BY r, g),
keep AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS after FROM span),
parts AS (
  SELECT r, string_agg(d.x[2*after+1:2*a], '' ORDER BY a) AS head, max(b) AS last_b, count(*) AS n_spans, sum(b - a) AS n_removed
  FROM keep JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(len(x)//2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE head || x[2*last_b+1:] END)) AS kept_sha256,
       coalesce(n_removed, 0) > 0 AS repeats
FROM d LEFT JOIN parts USING (r)
"""
}

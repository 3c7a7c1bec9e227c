"""Shared helpers of the text operators: Arrow text buffers, words and hashes as numpy arrays.

Everything here works on one Arrow batch inside one task.  Texts are UTF-8
bytes; a null text counts as empty.  Batches are cut in pieces of a bounded
number of bytes so that a task's memory does not depend on the batch size.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import secrets
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at once (single longer texts come alone).
PIECE_BYTES = 1 << 19


def return_arrays() -> None:
    """Lets this worker give arrays of a megabyte or more back to the system as soon as they are freed.

    Python workers outlive their tasks, and those of a pipeline run one stage after the other; what a stage
    has freed is not held beside the next.  It costs page faults, so only operators with few large arrays
    call it.  Without glibc nothing changes.
    """
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


_P1 = 0x9E3779B97F4A7C15
_P2 = 0xD1342543DE82EF95
_FULL = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of the words ``[^\x20\x09-\x0D]+``.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[32] = NONSPACE[9:14] = False


def text_col(name: str | Column = "text") -> Column:
    """The text as a non-null string column."""
    return F.coalesce((F.col(name) if isinstance(name, str) else name).cast("string"), F.lit(""))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls become empty.

    Freed memory of earlier batches, and of earlier stages in the same Python
    worker, goes back to the system first.
    """
    pa.default_memory_pool().release_unused()
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES):
    """Row ranges (i, j) that hold at most ``limit`` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pows(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= 1 << 20:
            _powers[base] = have
    return have[0][:n], have[1][:n]


class Rolling:
    """An order of the slices of a text: prefix polynomials mod 2**64, finalised, in constant time a slice.

    Such values collide by construction (for long slices), so they only rank and deal; what must be equal is
    compared by bytes or by a cryptographic digest.
    """

    def __init__(self, values: np.ndarray, base: int = _P1):
        up, self.down = _pows(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Value of each slice of one size, by start."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def draw_seed() -> int:
    """A secret number of a job: hashes under it cannot be made to collide by who writes the texts."""
    return secrets.randbits(64)


#: Longer slices are hashed one by one.
LONG_SLICE = 256


def slice_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of slices under a seed, eight bytes at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    first, odd = (mix(np.array([seed & _FULL, (seed & _FULL) ^ _P2], np.uint64))).tolist()
    odd = np.uint64(odd | 1)
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) + np.uint64(first))
    live = np.flatnonzero((size > 0) & (size <= LONG_SLICE))
    at, left, h = starts[live], size[live], out[live]
    while len(live):
        part = eight[at] & (np.uint64(_FULL) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)))
        h = mix((h ^ part) * odd)
        ends_here = left <= 8
        out[live[ends_here]] = h[ends_here]
        on = ~ends_here
        live, at, left, h = live[on], at[on] + 8, left[on] - 8, h[on]
    key = (seed & _FULL).to_bytes(8, "little")
    for k in np.flatnonzero(size > LONG_SLICE).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(padded[starts[k] : ends[k]], digest_size=8, key=key).digest(), "little")
    return out


def sequence_hashes(h: np.ndarray, starts: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of runs of a few hashes, under a seed."""
    odd = np.uint64(int(mix(np.array([(seed & _FULL) ^ _P1], np.uint64))[0]) | 1)
    out = mix(counts.astype(np.uint64) ^ odd)
    for k in range(int(counts.max(initial=0))):
        own = np.flatnonzero(counts > k)
        out[own] = mix((out[own] ^ h[starts[own] + k]) * odd)
    return out


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, seed: int = 0):
    """Words of the rows of a piece: starts, ends, 64-bit hashes under a seed, and the first word of each row.

    ``buf`` is already lower-cased; ``offsets`` start at 0.  The last array has
    one more entry than there are rows.
    """
    n = len(buf)
    inside = table[buf]
    first = np.empty(n, bool)
    if n:
        first[0] = True
        np.logical_not(inside[:-1], out=first[1:])
        edges = offsets[:-1]
        first[edges[edges < n]] = True
        first &= inside
        last = np.empty(n, bool)
        last[-1] = True
        np.logical_not(inside[1:], out=last[:-1])
        ends = offsets[1:]
        last[ends[ends > 0] - 1] = True
        last &= inside
    starts = np.flatnonzero(first) if n else np.zeros(0, np.int64)
    stops = np.flatnonzero(last) + 1 if n else np.zeros(0, np.int64)
    return starts, stops, slice_hashes(buf, starts, stops, seed), np.searchsorted(starts, offsets)


def hash_words(texts: Sequence[str | bytes], seed: int) -> np.ndarray:
    """Hashes of single words, as ``words`` gives them."""
    raw = [t.encode() if isinstance(t, str) else bytes(t) for t in texts]
    ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
    return slice_hashes(np.frombuffer(b"".join(raw), np.uint8), np.append(0, ends)[:-1].astype(np.int64), ends, seed)


def word_array(buf: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words themselves: their slices hold just the bytes that are inside."""
    data = np.ascontiguousarray(buf[inside])
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: each element's group, and its place in the group."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    group = np.repeat(np.arange(len(counts)), counts)
    begin = np.repeat(np.cumsum(counts) - counts, counts)
    return group, np.arange(total) - begin


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    Where that is unset, as in tests on one machine, a temporary folder is
    made and set as the checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs a shared folder in spark.checkpoint.dir")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows written as a table in the shared folder, and read again: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, and bytes of their longest columns, that a join may broadcast; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def small_side(rows: DataFrame, size: Column | None = None) -> DataFrame:
    """A written table of keys, marked for broadcast if its rows (and the bytes that ``size`` gives for each) are within the bounds."""
    held = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0)).alias("b")).first()
    return F.broadcast(rows) if held.n <= BROADCAST_ROWS and held.b <= BROADCAST_BYTES else rows


#: Keys of one table that may each stand for over this share of its rows; so many rows may be broadcast.
HOT_KEYS = 20_000


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, total: int, how: str) -> DataFrame:
    """An inner or left semi join of rows with one row a key, in which no key brings many rows to one task.

    ``weight`` counts a key's rows, ``total`` all of them: at most ``HOT_KEYS`` keys can hold over
    ``total / HOT_KEYS`` rows each.  These keys are broadcast; only the others are joined by a shuffle.
    """
    limit = max(1000, total // HOT_KEYS)
    hot = F.broadcast(keyed.where(F.col(weight) > limit).drop(weight))
    rest = keyed.where(F.col(weight) <= limit).drop(weight)
    return rows.join(hot, on, how).unionByName(rows.join(hot, on, "left_anti").join(rest, on, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_strings(values: list[bytes | str]) -> pa.Array:
    return pa.array(values, pa.string())

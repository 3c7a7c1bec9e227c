"""Best-fit packing of tokenised documents, after a Martello-Toth dominance reduction.

Stage 1 (tasks): each document becomes its token ids plus an end id; longer
documents are cut in pieces of ``capacity`` tokens.  The pieces (without ids)
are written as a table in the shared folder, with the writing task, and each
piece's rank among the task's pieces of its length.

Stage 2 (driver): only the histogram of lengths matters to a packing, and it has
at most ``capacity`` rows whatever the corpus.  The reduction goes through the
lengths from the longest: a piece no other fits with is alone; a piece with an
exact complement is fixed with it; a piece whose residual holds no two of the
shortest remaining pieces is fixed with the longest single piece that fits,
which dominates every other choice; and a piece whose residual holds at most two
is fixed with the longest piece that fits and the longest that fits beside it, if
no pair that fits has a longer second piece (the two then dominate every choice).
What no rule fixes stays open to later pieces' rules and is packed best-fit in the
end, longest first, whole runs of equal pieces at a time.  The plan is a list of
(length, first rank, count, first sequence, offset), bounded by the capacity too.

Stage 3 (tasks): a piece's rank within its length (the task's offset from a sum
over tasks, plus its rank there) finds its sequence in the plan.

Defined cases: null text is empty (one piece, just the end id); repeated rows
are packed as documents of their own; pieces of one length are interchangeable, so
their order among equals is that of tasks and rows and may differ between runs, the
number of sequences does not; texts of any length are cut in pieces, never cut off;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import expand, flat, pieces, return_arrays, table, text_col, word_array, written

CAPACITY, END_ID = 4096, 1
#: Words that a Python worker remembers with their ids.
CACHE_WORDS = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Byte classes of lower-cased text: 0 white space, 1 letters, 2 digits, 3 others.
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
#: Texts in which every character is ASCII (no apostrophe, no special token) or a Latin letter of two bytes.
_PLAIN = re.compile("[\x00-\x26\x28-\x3b\x3d-\x7f\xc0-\xd6\xd8-\xf6\xf8-įĲ-ɏ]*")


#: The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) if b in _OWN else chr(256 + b - sum(x < b for x in _OWN)) for b in range(256)}


class WordCodec:
    """Ids of a word-level byte-pair tokenizer: every distinct word is encoded once a task.

    The pre-tokenizer cuts texts in words before any merge, so the ids of a
    text are those of its words in order; words are told apart by their bytes.  Plain texts are cut with numpy; all
    others go through the tokenizer's own normaliser and pre-tokenizer pattern.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def _learn(self, keys: list[bytes]) -> None:
        if len(self.slot) + len(keys) > CACHE_WORDS:
            raise OverflowError
        for key in keys:
            ids = [x.id for x in self.model.tokenize(key.decode("latin-1").translate(_ALPHABET))]
            n = len(self.slot)
            if n == len(self.first):
                self.first, self.size = np.append(self.first, np.zeros_like(self.first)), np.append(self.size, np.zeros_like(self.size))
            while self.used + len(ids) > len(self.pool):
                self.pool = np.append(self.pool, np.zeros_like(self.pool))
            self.pool[self.used : self.used + len(ids)] = ids
            self.first[n], self.size[n] = self.used, len(ids)
            self.used += len(ids)
            self.slot[key] = n

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if _PLAIN.fullmatch(t):
                plain.append(k)
            elif t:
                out[k] = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
        if plain:
            try:
                ids = self._plain([texts[k] for k in plain])
            except OverflowError:
                self._reset()
                try:
                    ids = self._plain([texts[k] for k in plain])
                except OverflowError:  # more words in one piece than are remembered
                    ids = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([texts[k] for k in plain], add_special_tokens=False)]
            for k, i in zip(plain, ids, strict=True):
                out[k] = i
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        low = [unicodedata.normalize("NFC", t).lower().encode() for t in texts]
        sizes = np.array([len(x) for x in low], np.int64)
        offs = np.append(0, np.cumsum(sizes))
        raw = b"".join(low)
        buf = np.frombuffer(raw, np.uint8)
        kind = _KIND[buf]
        first = np.empty(len(buf), bool)
        if len(buf):
            first[0] = True
            np.not_equal(kind[1:], kind[:-1], out=first[1:])
            first |= kind == 2
            first[offs[:-1][sizes > 0]] = True
        edge = np.append(np.flatnonzero(first), len(buf))
        starts, ends = edge[:-1], edge[1:]
        keep = kind[starts] != 0
        starts, ends = starts[keep], ends[keep]
        distinct = word_array(buf, kind != 0, starts, ends).dictionary_encode()
        keys = distinct.dictionary.to_pylist()
        get = self.slot.get
        slots = [get(k, -1) for k in keys]
        missing = [n for n, s in enumerate(slots) if s < 0]
        if missing:
            self._learn([keys[n] for n in missing])
            for n in missing:
                slots[n] = self.slot[keys[n]]
        slot = np.array(slots, np.int64)[distinct.indices.to_numpy()]
        counts = self.size[slot]
        group, nth = expand(counts)
        ids = self.pool[self.first[slot][group] + nth]
        cut = np.append(0, np.cumsum(counts))[np.searchsorted(starts, offs)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


_codecs: dict[str, WordCodec] = {}


def codec_of(path: str) -> WordCodec:
    """The codec of this Python worker; its memory of words outlives a task."""
    return_arrays()
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row per piece, with its rank among the pieces of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer)
        seen: dict[int, int] = {}
        task = TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            ids_col = batch.column(0).to_pylist()
            buf, offs = flat(batch.column(1))
            for i, j in pieces(offs):
                data, at = buf[offs[i] : offs[j]].tobytes(), (offs[i : j + 1] - offs[i]).tolist()
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
                for k, ids in zip(range(i, j), codec.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for p, a in enumerate(range(0, len(ids), capacity)):
                        part = ids[a : a + capacity]
                        n = seen.get(len(part), 0)
                        seen[len(part)] = n + 1
                        rows.append((ids_col[k], p, a, len(part), zlib.crc32(part.tobytes()), task, n))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text")).mapInArrow(run, PIECES)


def plan_packing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): ranks of a length are dealt in order.

    Lengths are small integers, so pieces of one length are interchangeable and
    every decision is taken for as many of them at once as it holds for.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    dealt = dict.fromkeys(left, 0)
    lengths = sorted(left)  # of all pieces that no rule has fixed
    open_ = len(lengths)  # the first of them are still to be looked at, the longer ones are for best fit
    plan: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def fix(members: list[int]) -> None:
        """As many sequences of these lengths as there are pieces for."""
        nonlocal sequences, open_
        count = min(left[m] // members.count(m) for m in members)
        offset = 0
        for m in members:
            plan.append((m, dealt[m], count, sequences, offset))
            dealt[m] += count
            left[m] -= count
            offset += m
        sequences += count
        for m in set(members):
            if not left[m]:
                at = bisect_left(lengths, m)
                lengths.pop(at)
                open_ -= at < open_

    def longest(limit: int, used: list[int]) -> int:
        """The longest piece of at most this length beside those used, 0 if there is none."""
        at = bisect_right(lengths, limit) - 1
        while at >= 0 and left[lengths[at]] <= used.count(lengths[at]):
            at -= 1
        return lengths[at] if at >= 0 else 0

    def shortest(count: int, big: int) -> list[int]:
        """The shortest pieces beside one of length ``big``."""
        out: list[int] = []
        for n in lengths[: count + 1]:
            out += [n] * min(count, left[n] - (n == big))
        return out[:count]

    def second_of_pairs(room: int, big: int) -> int:
        """The longest piece that fits together with another one at least as long."""
        y = longest(room // 2, [big])
        if not y or left[y] - (y == big) >= 2:
            return y
        above = bisect_right(lengths, y)
        if above < len(lengths) and lengths[above] == big and left[big] == 1:
            above += 1
        if above < len(lengths) and lengths[above] <= room - y:
            return y
        return longest(y - 1, [big])  # beside y itself

    # Reduction: fix every set that provably dominates all other sets with its largest piece.
    while open_:
        big = lengths[open_ - 1]
        room, small = capacity - big, shortest(3, big)
        if not small or small[0] > room:
            fix([big])
        elif left.get(room, 0) > (room == big):
            fix([big, room])
        elif len(small) < 2 or small[0] + small[1] > room:  # at most one more piece: the longest that fits dominates
            fix([big, longest(room, [big])])
        else:
            if len(small) < 3 or sum(small) > room:  # at most two more
                a = longest(room, [big])
                b = longest(room - a, [big, a])
                if b and second_of_pairs(room, big) <= b:
                    fix([big, a, b])
                    continue
            open_ -= 1
    free = [(n, left[n]) for n in reversed(lengths)]
    # Best fit, longest first, for what no rule has fixed; open sequences by residual.
    bins: dict[int, list[tuple[int, int]]] = {}  # residual -> [(first sequence, count)]
    order: list[int] = []
    for n, count in free:
        rank = dealt[n]
        while count:
            at = bisect_left(order, n)
            if at < len(order):
                r = order[at]
                first, have = bins[r].pop()
                use = min(have, count)
                if have > use:
                    bins[r].append((first + use, have - use))
                elif not bins[r]:
                    del bins[r]
                    order.pop(at)
            else:
                fits = capacity // n
                r, use = capacity, -(-count // fits) if fits > 1 and count >= fits else 1
                use = min(use, count)
                first, sequences = sequences, sequences + use
            plan.append((n, rank, use, first, capacity - r))
            rank += use
            count -= use
            rest = r - n
            if rest:
                if rest not in bins:
                    bins[rest] = []
                    insort(order, rest)
                bins[rest].append((first, use))
        dealt[n] = rank
    return plan


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = written(cut_pieces(docs, tokenizer, capacity, end_id), "pieces")
    per_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    plan = plan_packing({r.length: r.n for r in counts}, capacity)
    by: dict[int, list[tuple]] = {}
    for n, rank, count, sequence, offset in sorted(plan):
        by.setdefault(n, []).append((rank, count, sequence, offset))
    steps = {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in by.items()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begin = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                first, _, seq, off = steps[int(n)]
                at = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own], offset[own] = seq[at] + rank[own] - first[at], off[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(begin, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("begin") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: all documents, at most 4096 tokens a sequence."""
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


SQL: dict[str, str] = {}

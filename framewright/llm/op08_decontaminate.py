"""Benchmark decontamination: a prefix-filtered join of item windows with document words.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
lower-cased.  An item's windows are its runs of ``size`` words (one shorter
window for an item of fewer words).

1. Windows: a table of the distinct windows of all items, with their words, and a
   table of the items that hold each.
2. Order: a window's shingles are its pairs of neighbouring words (the word of a
   window of one word).  They are ordered by the number of their places in all
   documents.  A window stands only where all its shingles stand, so its
   necessary prefix is its rarest shingle, the first of them at ties.
3. Join: document shingles that are a prefix are joined with the windows of that
   prefix.  Positional and length bounds (the window must lie inside the
   document) drop pairs, and the words around the shingle are compared with all
   words of the window, spelled out.  Hashes, under a secret seed of the job, only
   look shingles up.

Nothing of the benchmark but hashes of its shingles reaches the driver: at most
``BLOCK_TOKENS`` at once, which a pass over the documents looks its shingles up
in; with more, every block of them has its own pass.  The windows are broadcast
to the join within the bound of ``small_side``, and shuffled beyond it.

Defined cases: a null text has no words; an item without words has no window;
items with a null id hit words but are not counted; very long texts are judged
whole; repeated documents give repeated rows; an empty table of documents gives
an empty result, an empty benchmark leaves all documents clean; other columns of
either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _P1, _P2, ALNUM, LOWER, draw_seed, expand, flat, mix, pieces, return_arrays, small_side, table, text_col, word_array, words, written

WINDOW = 10
#: Distinct shingles that go to the tasks at once (eight bytes each).
BLOCK_TOKENS = 4 << 20
#: Parts that the places of one shingle are dealt to where windows are joined by a shuffle.
SALTS = 16


def item_words(text: str | None) -> list[str]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    buf = LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends, _, _ = words(buf, np.array([0, len(buf)]), ALNUM)
    low = buf.tobytes()
    return [low[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts, ends, strict=True)]


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of each word with the next one."""
    return mix(h[:-1] * np.uint64(_P1) + mix(h[1:] + np.uint64(_P2)))


def single_hashes(h: np.ndarray) -> np.ndarray:
    return mix(h ^ np.uint64(_P2))


class TokenSet:
    """Shingle hashes to look others up in: a bit table drops most, the sorted hashes decide."""

    def __init__(self, tokens: np.ndarray):
        return_arrays()
        self.sorted = np.sort(tokens.view(np.uint64))
        bits = int(np.clip(np.ceil(np.log2(max(len(tokens), 1) * 32)), 12, 27))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.sorted >> self.shift] = True

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers in the set) of the tokens that are in the set."""
        where = np.flatnonzero(self.table[tokens >> self.shift])
        at = np.searchsorted(self.sorted, tokens[where])
        at[at == len(self.sorted)] = 0
        same = self.sorted[at] == tokens[where] if len(self.sorted) else np.zeros(0, bool)
        return where[same], at[same]


WINDOWS = "window string, n int, words array<string>, tokens array<long>, text_key binary"


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)


def _spelled(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> pa.Array:
    """The words at these numbers, as strings."""
    if not len(at):
        return pa.array([], pa.string())
    return word_array(low, ALNUM[low], starts, ends).take(pa.array(at)).cast(pa.binary()).cast(pa.string())


def item_windows(benchmark: DataFrame, size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(distinct windows, holders): windows by their words joined by a space, with shingle hashes; the item ids of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = flat(batch.column(1))
            for i, j in pieces(offs):
                low = LOWER[buf[offs[i] : offs[j]]]
                starts, ends, h, rows = words(low, offs[i : j + 1] - offs[i], ALNUM, seed)
                many = np.diff(rows)
                row, nth = expand(np.where(many >= size, many - size + 1, np.minimum(many, 1)))
                start, n = rows[:-1][row] + nth, np.minimum(many[row], size)
                group, k = expand(n)
                spelled = _lists(n, _spelled(low, starts, ends, start[group] + k))
                of_pair, q = expand(np.maximum(n - 1, 1))
                first = start[of_pair] + q
                token = np.where(n[of_pair] > 1, pair_hashes(np.append(h, np.uint64(0)))[first], single_hashes(h)[first]) if len(h) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pc.binary_join(spelled, " "), pa.array(n, pa.int32()), spelled, _lists(np.maximum(n - 1, 1), pa.array(token.view(np.int64))), batch.column(0).take(pa.array(row + i))],
                    names=["window", "n", "words", "tokens", "text_key"],
                )

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_col().alias("text")).withColumn("text_key", F.unhex(F.sha2("text", 256)))
    texts = items.groupBy("text_key").agg(F.first("text").alias("text"))
    made = written(texts.mapInArrow(run, WINDOWS), "windows")
    distinct = made.groupBy("window", "n").agg(F.first("words").alias("words"), F.first("tokens").alias("tokens"))
    named = items.where(F.col("item_id").isNotNull()).select("text_key", "item_id").distinct()
    return distinct, made.select("window", "text_key").distinct().join(named, "text_key").select("window", "item_id").distinct()


def token_blocks(tokens: DataFrame, limit: int) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct tokens, at most about ``limit`` at once."""
    held = tokens.count()
    blocks = max(1, -(-held // limit))
    for b in range(blocks):
        part = tokens.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == b) if blocks > 1 else tokens
        yield part.toArrow().column(0).to_numpy()


def _text_tokens(hashes: np.ndarray, rows: np.ndarray, singles: bool):
    """(tokens, place of the first word) of a piece: pairs inside a row, and single words if any window needs them."""
    if not len(hashes):
        return
    pair = pair_hashes(hashes)
    inside = np.ones(len(pair), bool)
    ends = rows[1:-1] - 1
    inside[ends[(ends >= 0) & (ends < len(pair))]] = False
    yield pair[inside], np.flatnonzero(inside)
    if singles:
        yield single_hashes(hashes), np.arange(len(hashes))


def count_tokens(docs: DataFrame, tokens: DataFrame, singles: bool, limit: int, seed: int) -> DataFrame:
    """(token, places): how often each token stands in all documents; tokens that never do are left out."""
    out = None
    for block in token_blocks(tokens, limit):

        def run(batches: Iterator[pa.RecordBatch], block: np.ndarray = block) -> Iterator[pa.RecordBatch]:
            known = TokenSet(block)
            total = np.zeros(len(block), np.int64)
            for batch in batches:
                buf, offs = flat(batch.column(0))
                for i, j in pieces(offs):
                    _, _, h, rows = words(LOWER[buf[offs[i] : offs[j]]], offs[i : j + 1] - offs[i], ALNUM, seed)
                    for token, _ in _text_tokens(h, rows, singles):
                        np.add.at(total, known.find(token)[1], 1)
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(known.sorted[found].view(np.int64)), pa.array(total[found])], names=["token", "places"])

        part = docs.select(text_col().alias("text")).mapInArrow(run, "token long, places long").groupBy("token").agg(F.sum("places").alias("places"))
        out = part if out is None else out.unionByName(part)
    return out


def prefixed_windows(docs: DataFrame, benchmark: DataFrame, size: int, limit: int, seed: int) -> tuple[DataFrame, DataFrame, bool]:
    """(windows with their prefix token and its place, holders, whether there are windows of one word)."""
    distinct, holders = item_windows(benchmark, size, seed)
    distinct = written(distinct, "distinct")
    placed = distinct.select("window", F.posexplode("tokens").alias("place", "token"))
    tokens = written(placed.select("token").distinct(), "tokens")
    singles = bool(distinct.where("n = 1").limit(1).count())
    counts = count_tokens(docs, tokens, singles, limit, seed)
    ranked = placed.join(counts, "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "place", "token")).alias("p"))
    # a prefix that stands nowhere ends its window here
    out = ranked.where("p.places > 0").join(distinct.drop("tokens"), "window").select("window", "n", "words", "p.place", "p.token")
    return written(out, "prefixes"), written(holders, "holders"), singles


CANDIDATES = "id long, key binary, n_words long, found array<struct<token:long,at:long,around:array<string>,middle:int>>"
_FOUND = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int64()), ("around", pa.list_(pa.string())), ("middle", pa.int32())]))


def _candidates(block: np.ndarray, size: int, singles: bool, seed: int):
    """For each text: number of words, and its prefix tokens with the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenSet(block)
        for batch in batches:
            buf, offs = flat(batch.column(2))
            for i, j in pieces(offs):
                text = LOWER[buf[offs[i] : offs[j]]]
                starts, ends, h, rows = words(text, offs[i : j + 1] - offs[i], ALNUM, seed)
                found = [(token[at], place[at]) for token, place in _text_tokens(h, rows, singles) for at in [known.find(token)[0]]]
                token = np.concatenate([np.zeros(0, np.uint64), *(f[0] for f in found)])
                place = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])
                row = np.searchsorted(rows, place, side="right") - 1
                by = np.argsort(row, kind="stable")
                token, place, row = token[by], place[by], row[by]
                low, high = np.maximum(place - size + 1, rows[row]), np.minimum(place + size, rows[row + 1])
                group, k = expand(high - low)
                around = _lists(high - low, _spelled(text, starts, ends, low[group] + k))
                rows_of = pa.StructArray.from_arrays([pa.array(token.view(np.int64)), pa.array(place - rows[row]), around, pa.array((place - low).astype(np.int32))], fields=list(_FOUND.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32()), rows_of)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(rows)), lists], names=["id", "key", "n_words", "found"])

    return run


def window_hits(docs: DataFrame, benchmark: DataFrame, size: int, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: id, key of the text, n_words), (hits: key, start, end, window), (holders of the windows)."""
    source = docs.select(F.col("doc_id").cast("long").alias("id"), text_col().alias("text")).select("id", F.unhex(F.sha2("text", 256)).alias("key"), "text")
    seed = draw_seed()
    windows, holders, singles = prefixed_windows(docs, benchmark, size, limit, seed)
    prefixes = written(windows.select("token").distinct(), "tokens")
    scanned = [written(source.mapInArrow(_candidates(block, size, singles, seed), CANDIDATES), "scanned") for block in token_blocks(prefixes, limit)]
    found = None
    for part in scanned:
        # equal texts are joined once
        own = part.where(F.size("found") > 0).groupBy("key").agg(F.first("found").alias("found")).select("key", F.explode("found").alias("f")).select("key", "f.*")
        found = own if found is None else found.unionByName(own)
    side = small_side(windows, F.lit(2) * F.octet_length("window") + F.lit(8) * F.size("words") + F.lit(48))
    salted = F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int")
    if side is windows:
        found, side = found.withColumn("salt", salted), windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = found.join(side, ["token", "salt"])
    else:
        met = found.join(side, "token")
    start = F.col("at") - F.col("place")
    first = F.col("middle") - F.col("place")
    inside = (first >= 0) & (first + F.col("n") <= F.size("around"))
    same = F.slice("around", first + 1, F.col("n")) == F.col("words")  # needs a start of at least 1
    hits = met.where(F.when(inside, same).otherwise(False)).select("key", start.alias("s"), (start + F.col("n")).alias("e"), "window")
    return scanned[0].select("id", "key", "n_words"), written(hits, "hits"), holders


def covered(spans: Column) -> Column:
    """Number of words in the union of an array of runs."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    add = lambda a, x: F.struct((a.n + F.greatest(F.lit(0), x.e - F.greatest(x.s, a.to))).alias("n"), F.greatest(a.to, x.e).alias("to"))
    return F.aggregate(F.array_sort(spans), zero, add, lambda a: a.n)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: words, words inside any occurrence of an item window, items found."""
    texts, hits, holders = window_hits(docs, benchmark, size, block_tokens)
    spans = hits.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    items = hits.select("key", "window").distinct().join(small_side(holders, F.lit(16) + F.octet_length("window") + F.octet_length("item_id")), "window").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    per = spans.join(items, "key", "left").select("key", covered(F.col("spans")).alias("n_hit"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    per = written(per.select("key", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")), "found")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return texts.join(small_side(per), "key", "left").select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents in which no item window occurs, with all their columns."""
    _, hits, _ = window_hits(docs, benchmark, size, block_tokens)
    gone = small_side(written(hits.select("key").distinct(), "contaminated"))
    return docs.join(gone, F.unhex(F.sha2(text_col(docs["text"]), 256)) == gone["key"], "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: all documents against all benchmark items."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op8_decontaminate": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, array_to_string(w[k:k+9], ' ') AS s, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, k, n, array_to_string(w[k:k+n-1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
),
hit AS (SELECT r, k, dw.n, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
}

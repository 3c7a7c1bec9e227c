"""Edit-aware token counts with a segment tree per document.

A document is cut in leaves of at least ``LEAF`` characters.  A leaf ends only
before white space that follows a letter: the pre-tokenizer's pattern always
starts a new match there, whatever stands further left, so a leaf's tokens don't
depend on other leaves and the counts add up.  A binary tree over the leaves
keeps sums of characters and tokens.

An edit (start, end, new text; in characters of the present text, after the
edits before it) goes down the tree to the leaf of the character before its
start, and right to the first leaf whose end stands unchanged with the letter
before it: these leaves and the edit itself are the region with its boundary
context.  Only the region is cut and encoded again; its leaves' sums change and
the sums above them follow.  A region grown beyond ``GROWN`` leaves rebuilds the
tree from its leaves without encoding others again.

Defined cases: null text is empty; edits are clamped to the text; null edits are
none and null parts of an edit are 0, 0 or empty; repeated rows give repeated
rows; very long texts are counted whole; a stretch in which no white space follows
a letter is one leaf however long, and encoded whole at each edit in it; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_col

LEAF, GROWN = 512, 8
#: White space after a letter: a match of the pre-tokenizer starts here.
_EDGE = re.compile(r"(?<=[^\W\d_])\s")


def default_ranks() -> tuple[str, str]:
    """Path of the merge ranks and the pre-tokenizer pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


_encoders: dict[tuple[str, str], object] = {}


def encoder(path: str, pattern: str):
    if (path, pattern) not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path, pattern] = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path, pattern]


def cut_leaves(text: str) -> list[str]:
    leaves, a = [], 0
    while a < len(text):
        m = _EDGE.search(text, a + LEAF)
        b = m.start() if m else len(text)
        leaves.append(text[a:b])
        a = b
    return leaves


class TokenTree:
    """Leaves of a text with sums of characters and tokens in a binary tree."""

    def __init__(self, text: str, count):
        self.count, self.encoded = count, 0
        leaves = cut_leaves(text)
        self._build(leaves, [self._tokens(x) for x in leaves])

    def _tokens(self, leaf: str) -> int:
        self.encoded += len(leaf)
        return self.count(leaf)

    def _build(self, leaves: list[str], tokens: list[int]) -> None:
        size = 1
        while size < len(leaves):
            size *= 2
        self.size, self.leaves = size, leaves + [""] * (size - len(leaves))
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        self.chars[size:] = [len(x) for x in self.leaves]
        self.tokens[size:] = tokens + [0] * (size - len(tokens))
        for k in range(size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _leaf_of(self, at: int) -> tuple[int, int]:
        """(leaf, place in it) of a character, going down the sums."""
        k = 1
        while k < self.size:
            k *= 2
            if at >= self.chars[k]:
                at -= self.chars[k]
                k += 1
        return k - self.size, at

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        k = leaf + self.size
        self.chars[k], self.tokens[k] = len(text), tokens
        k //= 2
        while k:
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            k //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        n = self.chars[1]
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        if not n:
            leaves = cut_leaves(new)
            self._build(leaves, [self._tokens(x) for x in leaves])
            return
        first, place = self._leaf_of(max(start - 1, 0))
        begin = max(start - 1, 0) - place
        last, region = first, [self.leaves[first]]
        held = len(region[0])
        # the end of the region must keep both the white space and the letter before it
        while begin + held < n and begin + held <= end:
            last += 1
            region.append(self.leaves[last])
            held += len(self.leaves[last])
        text = "".join(region)
        text = text[: start - begin] + new + text[end - begin :]
        fresh = cut_leaves(text)
        counts = [self._tokens(x) for x in fresh]
        slots = last - first + 1
        if len(fresh) <= slots:
            for k in range(slots):
                self._set(first + k, fresh[k] if k < len(fresh) else "", counts[k] if k < len(fresh) else 0)
        elif len(fresh) <= slots + GROWN:
            for k in range(slots):
                own = k == slots - 1
                self._set(first + k, "".join(fresh[k:]) if own else fresh[k], sum(counts[k:]) if own else counts[k])
        else:
            before = [(x, t) for x, t in zip(self.leaves[:first], self.tokens[self.size : self.size + first], strict=True) if x]
            after = [(x, t) for x, t in zip(self.leaves[last + 1 :], self.tokens[self.size + last + 1 :], strict=True) if x]
            both = before + list(zip(fresh, counts, strict=True)) + after
            self._build([x for x, _ in both], [t for _, t in both])

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)


EDITS = "array<struct<start:long,end:long,text:string>>"
OUT = "doc_id long, n_edits long, n_chars long, tokens_before long, tokens_after long, chars_encoded_again long"


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents with their edits (doc_id, seq, start, end, text) in the order of seq as an array column."""
    rows = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("seq", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("text").cast("string").alias("text")).alias("e"))
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("e")).select("doc_id", F.transform("e", lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.text.alias("text"))).alias("edits"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(per, "doc_id", "left")


def count_edited(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Token counts before and after each document's edits (columns doc_id, text, edits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)

        def count(leaf: str) -> int:
            return len(enc.encode_ordinary(leaf))

        for batch in batches:
            rows = []
            for doc, text, edits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                tree = TokenTree(text.as_py(), count)
                before, first = tree.total, tree.encoded
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                rows.append((doc, len(edits or ()), tree.chars[1], before, tree.total, tree.encoded - first))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "n_edits", "n_chars", "tokens_before", "tokens_after", "chars_encoded_again"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text"), F.col("edits").cast(EDITS).alias("edits")).mapInArrow(run, OUT)


def derived_edits(docs: DataFrame) -> DataFrame:
    """Three edits of each document, derived from its own id and text.

    Insert twelve of its characters at one place, delete ten at another, and
    put seven at a third in capitals.
    """
    n = F.length("text")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text"))

    def place(salt: str) -> Column:
        return F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(salt))) % (n + 1)

    held = held.withColumns({"p1": place("a"), "p2": place("b"), "p3": place("c")})
    edits = F.array(
        F.struct(F.col("p1").alias("start"), F.col("p1").alias("end"), F.expr("substring(text, p2 + 1, 12)").alias("text")),
        F.struct(F.col("p2").alias("start"), (F.col("p2") + 10).alias("end"), F.lit("").alias("text")),
        F.struct(F.col("p3").alias("start"), (F.col("p3") + 7).alias("end"), F.upper(F.expr("substring(text, p3 + 1, 7)")).alias("text")),
    )
    return held.select("doc_id", "text", edits.alias("edits"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each."""
    ranks, pattern = default_ranks()
    return count_edited(derived_edits(table(spark, sf_dir, "documents")), ranks, pattern)


SQL: dict[str, str] = {}

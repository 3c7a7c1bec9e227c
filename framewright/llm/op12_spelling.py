"""Spelling variant grouping by finite-state composition.

1. Vocabulary.  Runs of letters of all texts are counted in Spark; every 97th
   (document, run) loses a letter, as the contract says.
2. Initial-state partitions.  Two words that differ by one edit, the shorter of
   ``m`` letters, have their edit at one place of 0 to m: where they first differ.
   A zone [a, b) of places takes the words of m and m + 1 letters that share the
   first a and the last m - b letters; what they share leads the acceptor to one
   state, the initial state of that partition.  Every word stands in two zones,
   the halves, for each m, so each pair meets in the zone of its place and counts
   only there.  Partitions of over ``GROUP_WORDS`` words are cut in zones of half
   the width, and again, until they fit; a zone of one place holds no more than the
   alphabet and its square.
3. Composition.  Partitions are dealt to buckets of bounded size.  A task builds the
   minimal acceptor of its bucket, with one initial state a partition, and composes
   it with the one-edit transducer and with itself: states (p, edited, q), of which
   only (p, 0, p) and (p, 1, q) can be reached.  The accepted pairs of such a state
   are kept as pairs of word numbers, so states that partitions share are composed
   once.
4. Forms and roots.  Near words are counted and compared per word in Spark; forms
   are followed by doubling, six rounds at the most, because n doubles at each form.

Defined cases: null text has no runs, a null doc_id is written as nothing; repeated
rows count again; equal n go to the smaller word in code-point order; very long texts
and runs are taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_col, written

LETTERS, TIMES, EVERY = 5, 3, 97
BUCKET_WORDS, GROUP_WORDS = 20_000, 20_000
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Pairs = list[tuple[int, int]]


class Acceptor:
    """A minimal acyclic automaton with several initial states; words of a state are numbered in their order."""

    def __init__(self) -> None:
        self.register: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []  # letter: (target, number of the words before)
        self.count: list[int] = []
        self._both: dict[tuple[int, int], Pairs] = {}
        self._near: dict[int, Pairs] = {}

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        have = self.register.get(key)
        if have is None:
            have = self.register[key] = len(self.final)
            before, out = int(final), {}
            for letter, target in arcs:
                out[letter] = (target, before)
                before += self.count[target]
            self.final.append(final)
            self.arcs.append(out)
            self.count.append(before)
        return have

    def add(self, words: list[str]) -> int:
        """The initial state of these sorted, distinct words."""
        path: list[tuple[list[bool], list[tuple[str, int]]]] = [([False], [])]
        last = ""

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], self._state(final[0], arcs)))

        for word in words:
            shared = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                shared += 1
            close(shared)
            path += [([False], []) for _ in word[shared:]]
            path[-1][0][0] = True
            last = word
        close(0)
        return self._state(path[0][0][0], path[0][1])

    def both(self, p: int, q: int) -> Pairs:
        """Accepted pairs of (p, 1, q): numbers of the words that both states accept."""
        if p == q:
            return [(k, k) for k in range(self.count[p])]
        known, todo = self._both, [(p, q)]
        while todo:
            p_, q_ = todo[-1]
            if (p_, q_) not in known:
                a, b = self.arcs[p_], self.arcs[q_]
                steps = [(a[c], b[c]) for c in (a if len(a) < len(b) else b) if c in a and c in b]
                wait = [(x, y) for (x, _), (y, _) in steps if x != y and (x, y) not in known]
                if wait:
                    todo += wait
                    continue
                out: Pairs = [(0, 0)] if self.final[p_] and self.final[q_] else []
                for (x, i0), (y, j0) in steps:
                    if x == y:
                        out += [(i0 + k, j0 + k) for k in range(self.count[x])]
                    else:
                        out += [(i0 + i, j0 + j) for i, j in known[x, y]]
                known[p_, q_] = out
            todo.pop()
        return known[p, q]

    def near(self, start: int) -> Pairs:
        """Accepted pairs of (start, 0, start): numbers of words that one edit turns into each other."""
        known, todo = self._near, [start]
        while todo:
            p = todo[-1]
            if p not in known:
                arcs = list(self.arcs[p].values())
                wait = [x for x, _ in arcs if x not in known]
                if wait:
                    todo += wait
                    continue
                found: set[tuple[int, int]] = set()
                for k, (x, before) in enumerate(arcs):
                    found.update((before + i, before + j) for i, j in known[x])  # the same letter, no edit yet
                    found.update((before + i, j) for i, j in self.both(x, p))  # a deleted letter
                    for y, after in arcs[k + 1 :]:
                        found.update((before + i, after + j) for i, j in self.both(x, y))  # another letter
                known[p] = sorted(found)
            todo.pop()
        return known[start]


def shared_letters(x: str, y: str) -> int:
    k, n = 0, min(len(x), len(y))
    while k < n and x[k] == y[k]:
        k += 1
    return k


def compose(rows: pa.Table) -> pa.Table:
    """Near words of a bucket, in both directions, with the counts of the second ones."""
    groups: dict[tuple, list[tuple[str, str, int]]] = {}
    for m, a, b, word, n in zip(*(rows[c].to_pylist() for c in ("m", "a", "b", "word", "n")), strict=True):
        end = len(word) - max(0, m - b)
        groups.setdefault((m, a, b, word[:a], word[end:]), []).append((word[a:end], word, n))
    machine = Acceptor()
    out: list[tuple[str, str, int]] = []
    for (m, a, b, _, _), members in groups.items():
        if len(members) < 2:
            continue
        members.sort()
        for i, j in machine.near(machine.add([r for r, _, _ in members])):
            (_, x, nx), (_, y, ny) = members[i], members[j]
            if min(len(x), len(y)) == m and a <= shared_letters(x, y) < b:
                out += [(x, y, ny), (y, x, nx)]
    cols = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.table([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["word", "other", "other_n"])


def vocabulary(docs: DataFrame, letters: int = LETTERS, times: int = TIMES, every: int = EVERY) -> DataFrame:
    """word, n of all words with at least so many letters and occurrences."""
    low = F.translate(text_col(), CAPITALS, CAPITALS.lower())
    runs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    size = F.length("run")
    h = F.crc32(F.concat_ws(":", "id", "run"))
    at = (F.col("h") % size).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    words = runs.where(size >= letters).select("run", h.alias("h")).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _keys() -> list[Column]:
    tail = F.greatest(F.lit(0), F.col("m") - F.col("b"))
    return [F.col("m"), F.col("a"), F.col("b"), F.substring("word", F.lit(1), F.col("a")).alias("head"), F.right("word", tail).alias("tail")]


def near_words(words: DataFrame, bucket_words: int = BUCKET_WORDS, group_words: int = GROUP_WORDS, letters: int = LETTERS) -> DataFrame:
    """(word, other, other_n) of all words of at least so many letters that differ by one edit, from (word, n)."""
    size = F.length("word")
    zones = lambda a, b: F.array(F.struct(a.alias("a"), ((a + b) / 2).cast("int").alias("b")), F.struct(((a + b) / 2).cast("int").alias("a"), b.alias("b")))
    rows = words.select("word", "n", F.explode(F.filter(F.array(size - 1, size), lambda m: m >= letters)).alias("m"))
    rows = rows.select("word", "n", "m", F.explode(zones(F.lit(0), F.col("m") + 1)).alias("z")).select("word", "n", "m", "z.a", "z.b")
    out = None
    while True:
        rows = written(rows, "zones")
        sizes = rows.groupBy(*_keys()).agg(F.count("*").alias("held"))
        hot = written(sizes.where((F.col("held") > group_words) & (F.col("b") - F.col("a") > 1)), "hot")
        names = ["m", "a", "b", "head", "tail"]
        keyed = rows.select("word", "n", *_keys())
        n_hot, n_rows = hot.count(), rows.count()
        whole = keyed.join(hot.drop("held"), names, "left_anti") if n_hot else keyed
        buckets = max(1, -(-n_rows // bucket_words))
        dealt = whole.select("m", "a", "b", "word", "n", F.pmod(F.xxhash64(*names), F.lit(buckets)).alias("bucket"))
        found = dealt.groupBy("bucket").applyInArrow(compose, "word string, other string, other_n long")
        out = found if out is None else out.unionByName(found)
        if not n_hot:
            return out
        again = keyed.join(hot.drop("held"), names, "left_semi")
        rows = again.select("word", "n", "m", F.explode(zones(F.col("a"), F.col("b"))).alias("z")).select("word", "n", "m", "z.a", "z.b")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form) by doubling; a form never leads back."""
    rows = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = rows.select(F.col("word").alias("root"), F.col("root").alias("next"))
        rows = written(rows.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not rows.where("moved").limit(1).count():
            return rows.select("word", "root")
        rows = rows.select("word", "root")


def variants(docs: DataFrame, bucket_words: int = BUCKET_WORDS, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = written(vocabulary(docs), "vocabulary")
    near = near_words(words, bucket_words, group_words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    found = words.join(best, "word", "left")
    takes = -F.col("best.less") >= 2 * F.col("n")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")), "found")
    roots = follow(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: the words of all documents with their near words, forms and roots."""
    return variants(table(spark, sf_dir, "documents"))


SQL = {
    "op12_spelling_variants": rf"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(n))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
g AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, run, count(*) AS c FROM r WHERE length(run) >= {LETTERS} GROUP BY ALL),
h AS (
  SELECT run, c, xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
  FROM g, t
),
v AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % {EVERY} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM h)
  WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(c) >= {TIMES}
),
k AS (SELECT word, n, i, word[:i-1] AS a, word[i+1:] AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM k x JOIN k y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT k.word, v.word, v.n FROM k JOIN v ON k.a || k.b = v.word
  UNION SELECT v.word, k.word, k.n FROM k JOIN v ON k.a || k.b = v.word
),
b AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM p GROUP BY word),
f AS (SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM v LEFT JOIN b USING (word)),
w AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, w.root FROM w JOIN f ON f.form = w.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN w USING (word)
"""
}

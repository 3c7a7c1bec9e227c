"""Toxicity by a weighted finite-state pattern grammar over clauses.

Symbols.  A text's words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, lower-cased;
marks of ``.!?;:`` and line ends divide them in clauses.  Each word becomes a
symbol: insult (with a lexical weight), threat, target, negation, report or
other.

Transducers, composed on a clause that holds an insult or a threat (others can't
match): each reads the tape that the one before it has written.  *Report* marks
what follows a verb of saying as reported.  *Negation* reads that tape and marks
what stands within three words of a negation; a negation before a verb of saying
ends with it, so that it doesn't reach into the reported words.  *Target* reads
both marks and binds an insult or threat to a person or pronoun within four words
in the same layer of speech.  *Events* reads the last tape and emits an event for
each insult or threat - aimed or bare, plain, negated or reported - and the
document's score is a logistic function of the weighted event counts.

Learning.  Insults are whole words or word beginnings, found by their log-odds
between toxic and clean labelled documents; the arc weights of the events are
fitted by logistic regression.  Both use a bounded sample of labelled rows with
crc32(doc_id as text) mod 5 not 0: at most ``SAMPLE`` of each label, in the
order of a hash of the id.  Only texts are inputs of a score.  Without usable
labels a small seed lexicon and fixed weights hold.  Every word or beginning that
is telling enough enters the lexicon; each must stand in ``LEAST_DOCS`` toxic
documents of the bounded sample, which bounds their number.

Defined cases: null or empty texts score as texts without events; very long texts
are scored whole; labels that are null are ignored, and of repeated labels the
largest counts; repeated documents give repeated rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import ALNUM, LOWER, draw_seed, flat, hash_words, pieces, return_arrays, slice_hashes, table, text_col, words, written

FOLDS, SAMPLE = 5, 8000
#: Bytes of word beginnings that may become lexicon entries, besides whole words (0).
STEMS = (4, 5, 6, 7, 8, 0)
LEAST_DOCS, LEAST_ODDS = 8, 2.5
#: Words and beginnings whose counts a task holds at once.
HELD_COUNTS = 50_000

SEED_INSULTS = "idiot idiots moron morons stupid pathetic worthless disgusting loser losers scum trash clown dumb".split()
THREATS = "kill hurt destroy beat burn shoot stab hang punish umbringen töten tuer matar".split()
TARGETS = "you your yours u he she they them him her his their this these that those it who people man woman du ihr sie er dich dein tu toi vous il elle ils te ti usted ella ellos".split()
NEGATIONS = "not no never none nobody isn aren wasn don doesn didn won cannot without nicht kein keine nie ne pas jamais sin nunca jamás".split()
REPORTS = "said says say told tells wrote writes reported reports claimed claims called quoted according alleged sagte schrieb dit écrit selon dijo escribió según".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Events: (insult, threat) x (aimed, bare) x (plain, negated, reported)
EVENTS = 12
NEAR_NEGATION, NEAR_TARGET = 3, 4

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?;:\n\r"]] = True


#: Marks that the transducers add to a symbol.
REPORTED, NEGATED, AIMED = 8, 16, 32


def report_transducer(tape: list[int]) -> list[int]:
    """Marks the words in reported speech (state 1 begins after a verb of saying)."""
    state, out = 0, []
    for s in tape:
        out.append(s | REPORTED * state)
        if s == REPORT:
            state = 1
    return out


def negation_transducer(tape: list[int]) -> list[int]:
    """Marks the words within a few words of a negation (the state counts down, and ends where reported speech begins)."""
    state, layer, out = 0, 0, []
    for s in tape:
        if s & REPORTED != layer:
            state, layer = 0, s & REPORTED
        if s & 7 == NEGATION:
            state = NEAR_NEGATION + 1
        out.append(s | NEGATED * (state > 0))
        state = max(0, state - 1)
    return out


def target_transducer(tape: list[int]) -> list[int]:
    """Marks the words with a target within a few words on either side, in the same layer of speech (one run each way)."""
    out = list(tape)
    for order in (range(len(tape)), range(len(tape) - 1, -1, -1)):
        state, layer = 0, -1
        for k in order:
            if tape[k] & REPORTED != layer:
                state, layer = 0, tape[k] & REPORTED
            if tape[k] & 7 == TARGET:
                state = NEAR_TARGET + 1
            out[k] |= AIMED * (state > 0)
            state = max(0, state - 1)
    return out


def event_transducer(tape: list[int]) -> list[tuple[int, int]]:
    """(place, event) for each marked insult or threat."""
    kind = lambda s: (6 if s & 7 == THREAT else 0) + (0 if s & AIMED else 3) + (2 if s & REPORTED else 1 if s & NEGATED else 0)
    return [(k, kind(s)) for k, s in enumerate(tape) if s & 7 in (INSULT, THREAT)]


def clause_events(symbols: list[int]) -> list[tuple[int, int]]:
    """(place, event) for each insult or threat of a clause: the composition of the four transducers."""
    return event_transducer(target_transducer(negation_transducer(report_transducer(symbols))))


@dataclass
class Grammar:
    """Lexicon (by hash of a word or beginning) and arc weights; small, and sent to every task."""

    insults: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # length -> (hashes, weights)
    classes: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.array([2.5, 0.4, 0.8, 2.0, 0.4, 0.8] * 2))
    bias: float = -3.0
    seed: int = 0

    @staticmethod
    def closed_classes(seed: int) -> tuple[np.ndarray, np.ndarray]:
        kind = {w: k for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        h = hash_words(list(kind), seed)
        order = np.argsort(h)
        return h[order], np.array(list(kind.values()))[order]

    def symbols(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and lexical weight of each word."""
        h, kind = self.classes
        at = np.searchsorted(h, hashes)
        at[at == len(h)] = 0
        symbol = np.where(h[at] == hashes, kind[at], OTHER)
        weight = (symbol == THREAT).astype(float)
        for size, (known, w) in self.insults.items():
            where = np.arange(len(starts)) if size == 0 else np.flatnonzero(ends - starts >= size)
            x = hashes if size == 0 else slice_hashes(buf, starts[where], starts[where] + size, self.seed)
            at = np.searchsorted(known, x)
            at[at == len(known)] = 0
            found = known[at] == x
            where, at = where[found], at[found]
            symbol[where] = INSULT
            weight[where] = np.maximum(weight[where], w[at])
        return symbol, weight

    def events(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted event counts of each row of a piece, and its number of words."""
        return_arrays()
        low = LOWER[buf]
        starts, ends, hashes, rows = words(low, offs, ALNUM, self.seed)
        out = np.zeros((len(offs) - 1, EVENTS))
        if len(starts):
            symbol, weight = self.symbols(low, starts, ends, hashes)
            clause = np.cumsum(_BREAK[low])[starts]
            hot = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
            row = np.searchsorted(rows, hot, side="right") - 1
            done = -1
            for w, r in zip(hot.tolist(), row.tolist(), strict=True):
                if w < done:
                    continue
                a = max(int(rows[r]), int(np.searchsorted(clause, clause[w])))
                done = min(int(rows[r + 1]), int(np.searchsorted(clause, clause[w], side="right")))
                for k, event in clause_events(symbol[a:done].tolist()):
                    out[r, event] += weight[a + k]
        return out, np.diff(rows)

    def score(self, events: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        z = np.log1p(events) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def held_out(name: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(name).cast("string")) % FOLDS == 0, F.lit(False))


def _word_counts(sample: DataFrame) -> DataFrame:
    """(stem bytes, word or beginning, toxic and clean documents that hold it) over the sample."""

    def rows(counts: dict[tuple[int, bytes], list[int]]) -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.binary()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())],
            names=["size", "stem", "bad", "good"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, bytes], list[int]] = {}
        for batch in batches:
            buf, offs = flat(batch.column(0))
            toxic = batch.column(1).to_numpy()
            for r in range(len(offs) - 1):
                part = LOWER[buf[offs[r] : offs[r + 1]]].tobytes()
                starts, ends, _, _ = words(np.frombuffer(part, np.uint8), np.array([0, len(part)]), ALNUM)
                own = {part[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}
                for key in {(s, w[:s]) for w in own for s in STEMS if s and len(w) >= s} | {(0, w) for w in own}:
                    counts.setdefault(key, [0, 0])[0 if toxic[r] else 1] += 1
                if len(counts) > HELD_COUNTS:  # the partial counts meet in the grouping
                    yield rows(counts)
                    counts = {}
        yield rows(counts)

    return sample.select("text", F.col("toxic").cast("int")).mapInArrow(run, "size int, stem binary, bad long, good long").groupBy("size", "stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _lexicon(sample: DataFrame, n_bad: int, n_good: int, seed: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))
    rows = _word_counts(sample).where(F.col("bad") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).collect()
    # the shortest beginning that is nearly as telling stands for the longer ones
    best: dict[bytes, float] = {}
    chosen: dict[int, list[tuple[bytes, float]]] = {}
    for r in sorted(rows, key=lambda r: (r["size"] or 99, bytes(r.stem))):
        stem = bytes(r.stem)
        held = max((best[stem[:s]] for s in STEMS if s and s <= len(stem) and stem[:s] in best and (r["size"] == 0 or s < len(stem))), default=None)
        if held is None or r.odds > held + 1.5:
            chosen.setdefault(r["size"], []).append((stem, r.odds))
            if r["size"]:
                best[stem] = r.odds
    out = {}
    for size, entries in chosen.items():
        h = hash_words([s for s, _ in entries], seed)
        order = np.argsort(h)
        out[size] = h[order], np.array([min(w, 6.0) / 6.0 for _, w in entries])[order]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; x has a few columns and a bounded number of rows."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), ridge * np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn_grammar(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Lexicon and weights from at most ``sample`` toxic and as many clean labelled rows outside the held-out fold."""
    seed = draw_seed()
    h = hash_words(SEED_INSULTS, seed)
    order = np.argsort(h)
    grammar = Grammar({0: (h[order], np.ones(len(h)))}, Grammar.closed_classes(seed), seed=seed)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    picked = None
    for value in (0, 1):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text"))
    # at most 2 * sample rows of two numbers: small enough to broadcast
    rows = written(source.join(F.broadcast(picked), "doc_id").select("text", "toxic"), "labelled")
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) < LEAST_DOCS:
        return grammar
    found = _lexicon(rows, counts[1], counts[0], seed)
    if found:
        grammar.insults = found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = flat(batch.column(0))
            events = np.concatenate([np.zeros((0, EVENTS)), *(grammar.events(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[0] for i, j in pieces(offs))])
            yield pa.RecordBatch.from_arrays([pa.array(list(events), pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    fit = rows.select("text", "toxic").mapInArrow(run, "x array<double>, y int").groupBy("x", "y").count().collect()  # no more than the sample
    x, y, n = np.array([r.x for r in fit]), np.array([r.y for r in fit]), np.array([r["count"] for r in fit])
    grammar.weights, grammar.bias = _logistic(np.log1p(np.repeat(x, n, axis=0)), np.repeat(y, n))
    return grammar


def _scored(batch: pa.RecordBatch, column: int, grammar: Grammar) -> np.ndarray:
    buf, offs = flat(batch.column(column))
    parts = [grammar.score(*grammar.events(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])) for i, j in pieces(offs)]
    return np.concatenate([np.zeros(0), *parts])


def score_documents(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scored(batch, 2, grammar)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_col().alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The documents that the grammar does not reject, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch, at, grammar) < 0.5))

    # numbered names, since a user's may hold dots
    plain = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema)])
    return docs.toDF(*plain.names).mapInArrow(run, plain).toDF(*docs.columns)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: a score of every document."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn_grammar(docs, table(spark, sf_dir, "labels")))


SQL: dict[str, str] = {}

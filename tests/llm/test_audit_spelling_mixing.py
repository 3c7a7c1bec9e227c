"""Operators 11 to 13: hostile tables against brute force in Python."""

import random
import zlib
from itertools import permutations

from framewright.llm import op11_filter_audit as op11
from framewright.llm import op12_spelling as op12
from framewright.llm import op13_mixing as op13

SCHEMA = "doc_id long, text string, lang string, source string, row string, part string, prefix string, word string, `rank` string, `a.b` string"
EXTRA = ("x", "y", "z", "w", "r", "c")
SPACE = " \t\n\v\f\r"


def docs_of(spark, rows):
    """(doc_id, text, lang, source) rows with further columns whose names clash."""
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)


def split(text):
    out = [""]
    for c in text or "":
        out[-1:] = [out[-1] + c] if c not in SPACE else [out[-1], ""]
    return [w for w in out if w]


def hostile(seed):
    rnd = random.Random(seed)
    some = ["word", "Word", "WORDS", "a", "b", "$1", "x|y", "één", "the", "of", " odd space", "tab\tbed"]
    rows = [(0, None, None, None), (1, "", "en", "s1"), (2, " \n\t ", "", "s1"), (3, "x" * 5000, "en", "s2"), (4, "A" * 10 + "b" * 90, "en", "s2"), (5, "A" * 11 + "b" * 89, "en", "s2")]
    for k in range(150):
        text = " ".join(rnd.choice(some) if rnd.random() < 0.5 else f"w{rnd.randrange(400)}" for _ in range(rnd.choice([1, 5, 99, 100, 101, 150, 400])))
        rows.append((rnd.choice([k + 10, k + 10, None, 7]), text, rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s1", "s1", "s2", "é", "", None, "Z"])))
    rows += [(k + 500, rows[20][1], "en", "s1") for k in range(60)] + [rows[20]] * 3 + [(9, " ".join(f"v{k}" for k in range(60_000)), "en", "big")]
    return rows


def audit_by_hand(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, lang, _ in rows:
        t, w = t or "", split(t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        fails.append((lang or "", i, {k for k, v in bad.items() if v}))
    out, total = {}, {}
    for part in {p for p, _, _ in fails}:
        own = [(i, f) for p, i, f in fails if p == part]
        for order in permutations("ABCDE"):
            seen = set()
            for step, f in enumerate(order):
                gone = [(i, x) for i, x in own if f in x and not x & seen]
                row = [sum(not x & (seen | {f}) for _, x in own), len(gone), sum(f in x and bool(x & seen) for _, x in own), sum(x == {f} for _, x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                out[part, "".join(order), step + 1] = row
                total[part, f] = total.get((part, f), 0) + len(gone)
                seen.add(f)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_hand(spark):
    rows = hostile(1)
    labels = [(i, random.Random(i).choice([0, 1, None]), random.Random(-i).choice([0, 1, None])) for i in range(100)] + [(7, 1, 1), (7, 0, 0), (None, 1, 1), (20, 1, 1), (20, 1, 1)]
    got = op11.audit_documents(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audit_by_hand(rows, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == want and len(got) == len(want)


def test_audit_of_nothing_and_of_clean_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op11.audit_documents(docs_of(spark, []), labels).count() == 0
    clean = op11.audit_documents(docs_of(spark, [(1, " ".join(f"w{k}" for k in range(200)), "en", "s")]), labels).collect()
    assert len(clean) == 600 and all(tuple(r[3:]) == (1, 0, 0, 0, 0, 0, 0) for r in clean)


def words_by_hand(rows):
    counts = {}
    for i, t, *_ in rows:
        run = ""
        for c in (t or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                word = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[word] = counts.get(word, 0) + 1
            run = ""
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near_by_hand(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    k = op12.shared_letters(x, y)
    return x[k + (len(x) >= len(y)) :] == y[k + (len(y) >= len(x)) :]


def variants_by_hand(n):
    near = {w: [v for v in n if near_by_hand(w, v)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def test_variants_by_hand(spark):
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abcé") for _ in range(rnd.randrange(4, 9))) for _ in range(300)} | {"aaaaa", "aaaaaa", "aaaaaaa", "zzzzy", "q" * 3000, "q" * 3001, "÷×éÉÿ"}
    rows = [(None, None, None, None), (1, "", None, None), (2, "é" * 40_000 + " " + "É" * 40_000, None, None)]
    for k in range(400):
        text = "".join(rnd.choice([w, w.upper()]) + rnd.choice([" ", "1", "-", "—", "Ā"]) for w in rnd.choices(sorted(words), k=40))
        rows.append((rnd.choice([k, None, 5]), text, None, None))
    rows += [rows[9]] * 5
    want = variants_by_hand(words_by_hand(rows))
    for group_words, bucket_words in ((20_000, 20_000), (6, 50)):  # the second splits zones down to one place
        got = op12.variants(docs_of(spark, rows), bucket_words, group_words).collect()
        assert {r.word: (r.form, r["root"], r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want), (group_words, bucket_words)
    assert any(v[0] and want[v[0]][0] for v in want.values()), "no form has a form"
    assert op12.variants(docs_of(spark, [])).count() == 0 and op12.variants(docs_of(spark, rows[:2])).count() == 0


def test_acceptor_is_minimal_and_composes():
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 7))) for _ in range(60)})
    machine = op12.Acceptor()
    start = machine.add(words)
    found = {(words[i], words[j]) for i, j in machine.near(start)}
    assert {frozenset(p) for p in found} == {frozenset((x, y)) for x in words for y in words if near_by_hand(x, y)}
    assert machine.count[start] == len(words)
    rights = {}
    for state in range(len(machine.final)):  # no two states accept the same words
        rights[state] = frozenset(([""] if machine.final[state] else []) + [c + w for c, (x, _) in machine.arcs[state].items() for w in rights[x]])
    assert len(set(rights.values())) == len(rights)


def mix_targets(sizes, weights, repeats):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full = set()
    while True:
        rest, open_ = sum(sizes.values()) - repeats * sum(sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        t = {s: repeats * sizes[s] if s in full else w[s] * rest / open_ for s in names}
        more = {s for s in names if s not in full and t[s] > repeats * sizes[s]}
        if not more:
            return t
        full |= more


def check_mix(spark, rows, **how):
    docs = docs_of(spark, rows)
    block = how.get("block", op13.BLOCK)
    got = [tuple(r) for r in op13.mix(docs, **how).collect()]
    again = [tuple(r) for r in op13.mix(docs.repartition(2), **how).collect()]
    key = lambda r: tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in r)
    assert sorted(got, key=key) == sorted(again, key=key), "reruns differ"
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(split(t))
    target = mix_targets(sizes, how.get("weights", op13.WEIGHTS), op13.REPEATS)
    assert sorted((i or -1, n, s or "") for i, n, _, _, _, s in got) == sorted((i or -1, len(split(t)), s or "") for i, t, _, s in rows)
    taken = dict.fromkeys(sizes, 0)
    for _, size, of_source, aim, took, s in got:
        assert of_source == sizes[s] and abs(aim - target[s]) <= 1e-6 * max(1, aim) and 0 <= took <= 3 * size
        taken[s] += took
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * block, (s, taken[s], target[s])


def test_mix_by_hand(spark):
    rows = hostile(2)
    check_mix(spark, rows)
    check_mix(spark, rows, block=4, shard_rows=20)
    check_mix(spark, [(k, "w " * (k % 7 * 30), None, f"s{k % 5}") for k in range(40)] + [(99, "one", None, "tiny"), (98, "x " * 4000, None, None)], block=2, shard_rows=3, weights=(1, 9))
    assert op13.mix(docs_of(spark, [])).count() == 0
    assert [tuple(r) for r in op13.mix(docs_of(spark, [(1, None, None, "s"), (2, " ", None, None)])).select("size", "source_size", "target", "taken").collect()] == [(0, 0, 0.0, 0)] * 2


def test_apportionment_by_hand(spark):
    rnd = random.Random(4)
    for seats in (0, 1, 5, 40, 1000):
        votes = [rnd.choice([0.5, 1.0, 2.0, 3.0, 100.0, 7.25, rnd.random() * 50]) for _ in range(25)]
        parties = spark.createDataFrame([(0, k, v) for k, v in enumerate(votes)], "grp int, rank long, votes double")
        got = {r["rank"]: r.quota for r in op13.apportion(parties, spark.createDataFrame([(0, seats)], "grp int, seats long"), ["rank"]).collect()}
        quotients = sorted((-v / (2 * k + 1), p, k) for p, v in enumerate(votes) for k in range(1000))[:seats]
        assert got == {p: sum(q[1] == p for q in quotients) for p in range(25)}, seats

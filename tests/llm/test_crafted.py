"""Texts made to collide in polynomial hashes modulo a power of two, for every base: Thue-Morse words and complements."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from framewright.llm import common
from framewright.llm import op01_suffix_dedup as op1
from framewright.llm import op03_packing as op3
from framewright.llm import op05_minhash as op5
from framewright.llm import op08_decontaminate as op8

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ONE = "".join("ab"[k.bit_count() % 2] for k in range(2048))
OTHER = ONE.translate(str.maketrans("ab", "ba"))
SHARED = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(400))


def table(spark, texts):
    return spark.createDataFrame([(k, t, None, "s", len(t)) for k, t in enumerate(texts)], SCHEMA).coalesce(1)


def test_the_words_collide_without_a_seed_and_not_with_one():
    values = [sum((x + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, x in enumerate(w.encode())) % (1 << 64) for w in (ONE, OTHER)]
    assert values[0] == values[1]
    a, b = common.hash_words([ONE, OTHER], 5)
    assert a != b


def test_hashes_of_words_follow_bytes_and_seed():
    text = " ".join(["x" * n for n in range(1, 600)] + ["y" * n for n in range(1, 600)]).encode()
    buf, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, ends, h, _ = common.words(buf, offs, common.NONSPACE, 7)
    assert len(set(h.tolist())) == len(h) == 1198
    assert h.tolist() == common.hash_words(text.split(), 7).tolist()
    assert not set(h.tolist()) & set(common.words(buf, offs, common.NONSPACE, 8)[2].tolist())
    assert common.word_array(buf, common.NONSPACE[buf], starts, ends).to_pylist() == text.split()


def repeated(texts, size):
    seen = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - size + 1):
            seen.setdefault(t[p : p + size], []).append((k, p))
    out = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                out[k].update(range(p, p + size))
    return [len(s) for s in out]


@pytest.mark.parametrize("group_bytes", [4 << 20, 500])
def test_suffix_dedup(spark, group_bytes):
    texts = [SHARED + ONE + SHARED, SHARED[::-1] + SHARED + OTHER + SHARED, SHARED + OTHER[:1024] + "z", SHARED + ONE[:1024] + "y", ONE, OTHER]
    got = {r.doc_id: r.n_removed for r in op1.remove_repeats(table(spark, texts), 400, 64, group_bytes=group_bytes).collect()}
    assert [got[k] for k in range(len(texts))] == repeated(texts, 400)


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op3.default_tokenizer())
    texts = [ONE + " x", OTHER + " x", ONE, OTHER]
    got = {r.doc_id: r.ids_crc32 for r in op3.pack_documents(table(spark, texts), op3.default_tokenizer()).collect()}
    for k, t in enumerate(texts):
        assert got[k] == zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())


def test_near_duplicates(spark):
    got = {r.doc_id: r.component_id for r in op5.near_components(table(spark, [ONE, OTHER, ONE.upper(), f"{ONE} a b c d e", f"{OTHER} a b c d e"])).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}


def test_exact_sets_tell_shingles_apart_by_their_words():
    raw = [t.encode() for t in (f"{ONE} b c d", f"{OTHER} b c d", f"{ONE.upper()} B c d", "b c", "", f"c d {ONE} b c d")]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw]))
    row, value = op5.exact_sets(buf, offs, 4)
    sets = [set(value[row == k].tolist()) for k in range(len(raw))]
    assert [len(s) for s in sets] == [1, 1, 1, 1, 0, 3]
    assert sets[0] == sets[2] and not sets[0] & sets[1] and sets[0] < sets[5] and not sets[3] & sets[5]


def test_decontamination(spark):
    items = spark.createDataFrame([("i1", OTHER), ("i2", f"{ONE} two words")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in op8.decontaminate(table(spark, [f"x {ONE} y", f"x {OTHER} y", f"{OTHER} two words", f"{ONE} two words"]), items).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (1, 1), 3: (3, 1)}


def test_pipeline_keeps_them(spark, sf_dir):
    docs = table(spark, [f"{ONE} first of its kind", f"{OTHER} first of its kind"])
    assert corpus_pipeline.near_duplicates(spark, docs, sf_dir).count() == 2
    assert corpus_pipeline.decontamination(spark, docs, sf_dir).count() == 2

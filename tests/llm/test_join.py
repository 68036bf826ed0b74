"""The n-gram join, its parts, components and matrices against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import ngram_join as J
from corvane.llm import words as W
from corvane.llm.components import connected_components


def word_list(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in word))
            word = ""
        else:
            word += c
    return out


def grams(text, width):
    w = word_list(text)
    return {tuple(w[i : i + min(width, len(w))]) for i in range(len(w) - min(width, len(w)) + 1)} if w else set()


def components(rows, width, share, of):
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, grams(t, width)) for i, t in rows if i is not None]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and of * len(a & b) >= share * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def corpus(seed, n):
    r = random.Random(seed)
    made = lambda k: [r.choice("abcdefgh") + r.choice("xyz") + str(r.randint(0, 40)) for _ in range(k)]
    passage = made(30)
    rows = []
    while len(rows) < n:
        base = made(r.choice([1, 2, 4, 8, 12, 20, 40, 80, 160]))
        if r.random() < 0.3:
            base += passage
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                k = r.randrange(len(copy))
                copy[k] = r.choice([copy[k].upper(), "new" + str(r.randint(0, 9)), copy[k]])
            rows.append((len(rows) * 3 + 1, r.choice([" ", "\n", "\t "]).join(copy)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "share", "of"), [(5, 80, 100), (3, 90, 100), (1, 50, 100)])
def test_components_like_brute_force(spark, width, share, of):
    rows = corpus(width, 220) + [(5000, None), (5003, ""), (5006, " \n "), (5009, "one"), (5012, "ONE"), (None, "one"), (5015, "é è"), (5018, "É è")]
    got = J.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=width, similarity=(share, of)).collect()
    want = components(rows, width, share, of)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(grams(t, width)) for i, t in rows}
    assert sum(i != c for i, c in want.items()) > 50


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_keys_lose_no_link(spark, monkeypatch, hot):
    """Nearly every key counts as hot, and a passage that many documents share makes hot ones in any case."""
    rows = corpus(21, 200)
    monkeypatch.setattr(J, "HOT_KEY", hot)
    for width, share in ((5, 80), (3, 90)):
        got = J.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), width=width, similarity=(share, 100)).collect()
        assert {r.doc_id: r.component_id for r in got} == components(rows, width, share, 100)


def test_blocks_find_the_links_between_them(spark, monkeypatch):
    rows = corpus(9, 120)
    monkeypatch.setattr(J, "BLOCK_TOKENS", 150)
    got = J.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, similarity=(80, 100)).collect()
    assert {r.doc_id: r.component_id for r in got} == components(rows, 3, 80, 100)


def test_repeated_ids_and_rows_and_clashing_names(spark):
    rows = [(1, "a b c d e f", 7, "k"), (1, "a b c d e f", 7, "k"), (2, "a b c d e f", 8, "k"), (2, "other words than those above", 8, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, key string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.ngram_components(docs).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1)]
    assert sorted((r.doc_id, r.id) for r in J.one_of_each(docs).collect()) == [(1, 7)]
    more = docs.union(spark.createDataFrame([(3, "other words than those above", 9, "k"), (4, "other words than those below", 9, "k")], docs.schema)).repartition(6)
    linked = {r.doc_id: r.component_id for r in J.ngram_components(more, width=1, similarity=(60, 100)).collect()}
    assert linked == {1: 1, 2: 1, 3: 1, 4: 1}
    empty = docs.limit(0)
    assert J.ngram_components(empty).count() == 0 and J.one_of_each(empty).count() == 0


def test_linked_sets_share_as_many_keys_as_they_need():
    r = np.random.RandomState(1)
    for share in (80, 90, 50):
        parts = J.Parts((share, 100))
        for _ in range(300):
            n = int(r.choice([1, 2, 3, 5, 9, 10, 11, 20, 45, 100, 400]))
            a = np.unique(r.randint(0, 2**62, n, dtype=np.int64).astype(np.uint64) * np.uint64(4))
            gone = r.randint(0, n // 5 + 2)
            b = np.unique(np.concatenate([a[r.permutation(len(a))[gone:]], r.randint(0, 2**62, r.randint(0, n // 6 + 2), dtype=np.int64).astype(np.uint64) * np.uint64(4)]))
            common = len(np.intersect1d(a, b))
            if not len(b) or 100 * common < share * (len(a) + len(b) - common):
                continue
            keys, counts, need = parts.keys(np.concatenate([a, b]), np.array([len(a), len(b)]))
            both = len(np.intersect1d(keys[: counts[0]], keys[counts[0] :]))
            assert both >= need.max() >= 1


def test_words_are_the_same_in_bytes_and_in_characters():
    r = random.Random(4)
    texts = [None, "", *["".join(r.choice("ab Z\t\n\x0bé İ😀9-") for _ in range(r.randint(0, 30))) for _ in range(300)]]
    data, offsets = W.text_bytes(pa.array(texts))
    _, _, counts = W.word_bounds(data, offsets, W.NON_BLANK)
    assert counts.tolist() == [len(word_list(t)) for t in texts]
    sliced = pa.array(["x y", *texts]).slice(1)
    assert W.word_bounds(*W.text_bytes(sliced), W.NON_BLANK)[2].tolist() == counts.tolist()
    starts, ends, _ = W.word_bounds(W.LOWER[data], offsets, W.NON_BLANK)
    hashes = W.word_hashes(W.LOWER[data], starts, ends)
    spelled = [bytes(W.LOWER[data][a:b]) for a, b in zip(starts, ends, strict=True)]
    assert len(set(hashes.tolist())) == len(set(spelled)) and len(set(zip(hashes.tolist(), spelled, strict=True))) == len(set(spelled))


def test_long_columns_hash_in_blocks(monkeypatch):
    text = pa.array(["word%d " % (i % 50) * 3 for i in range(400)] + ["x" * 5000])
    data, offsets = W.text_bytes(text)
    starts, ends, _ = W.word_bounds(data, offsets, W.NON_BLANK)
    whole = W.word_hashes(data, starts, ends)
    monkeypatch.setattr(W, "BLOCK_BYTES", 64)
    assert (W.word_hashes(data, starts, ends) == whole).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(59, 70), (80, 80), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 60)}, 70: 1}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0

"""Substring dedup, periodic runs and centroid clusters beside brute force, and their cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import substring_dedup as S
from corvane.llm.centroids import Compressed, Screen, cluster_vectors
from corvane.llm.periodic_runs import find_runs, periodic_runs, with_planted_periods
from corvane.llm.runs import SuffixAutomaton, maximal_runs
from tests.llm.test_cases import NAMES

DOC = "doc_id long, text string"


def plain_runs(seq, least):
    """Every period by itself; of equal stretches the smallest."""
    out, n = {}, len(seq)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if seq[i] == seq[i + q]:
                j = i
                while j + q < n and seq[j] == seq[j + q]:
                    j += 1
                if j - i >= q and j - i + q >= least:
                    out.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


def sequences(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice([1, 2, 2, 3, 4])
        seq = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.4:
            piece = seq[: rng.randint(1, 9)] or [0]
            seq = (piece * 20)[: rng.randint(0, 40)] + seq + (piece * 9)[: rng.randint(0, 30)]
        yield seq


@pytest.mark.parametrize("least", [2, 7, 12])
def test_runs_beside_brute_force(least):
    for seq in sequences(3000, least):
        assert maximal_runs(seq, least) == plain_runs(seq, least), seq


def test_runs_of_sequences_full_of_them():
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    assert maximal_runs(b, 12) == plain_runs(b, 12)
    assert maximal_runs([7] * 1000, 2) == [(0, 1000, 1)] and maximal_runs([], 2) == []
    assert len(maximal_runs([i % 30_000 for i in range(100_000)], 12)) == 1


def test_factors_are_the_longest_pieces_that_start_earlier():
    for seq in sequences(500, 5):
        at = 0
        for begin, end, earlier in SuffixAutomaton(seq).factors():
            size, first = 0, -1
            for j in range(begin):
                k = 0
                while begin + k < len(seq) and seq[j + k] == seq[begin + k]:
                    k += 1
                if k > size:
                    size, first = k, j
            assert (begin, end, earlier) == (at, at + max(1, size), first)
            at = end
        assert at == len(seq)


def test_stretches_lose_no_run():
    """Whole batches, with runs beside words of their own, empty texts and texts that touch."""
    rng = random.Random(3)
    texts = []
    for i, seq in enumerate(sequences(400, 9)):
        words = [f"w{x}" for x in seq]
        texts.append(" ".join([f"x{i}.{k}" for k in range(rng.randint(0, 20))] + words + [f"y{i}.{k}" for k in range(rng.randint(0, 20))]))
        texts += ["", None][: rng.randint(0, 2)]
    counts, found = find_runs(pa.array(texts, pa.string()), 12)
    for i, text in enumerate(texts):
        words = (text or "").split()
        assert counts[i] == len(words) and found.get(i, []) == plain_runs(words, 12)


def test_periodic_runs_collapse(spark):
    rows = [(1, "a b c " * 5 + "d"), (2, None), (3, " \n "), (4, "x" * 9), (5, "one " * 11), (6, "one\t" * 12 + "two"), (1, "a b c " * 5 + "d"), (None, "z y " * 7)]
    docs = spark.createDataFrame([(i, t, 0, "n") for i, t in rows], "doc_id long, text string, N_WORDS int, runs string")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic_runs(docs).collect()))
    assert got == [(0, 14, [(0, 14, 2)], "z y"), (1, 16, [(0, 15, 3)], "a b c d"), (1, 16, [(0, 15, 3)], "a b c d"), (2, 0, [], ""), (3, 0, [], ""), (4, 1, [], "x" * 9), (5, 11, [], " ".join(["one"] * 11)), (6, 13, [(0, 12, 1)], "one two")]
    assert periodic_runs(docs.limit(0)).count() == 0


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 50))) for i in range(300)] + [(None, "a b"), (301, None)]
    got = {r.doc_id: r.text for r in with_planted_periods(spark.createDataFrame(rows, DOC)).collect()}
    changed = 0
    for i, text in rows:
        words, h = (text or "").split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[k] if k < a else words[a + (k - a) % p] for k in range(n))
            changed += text != " ".join(words)
        assert got[i] == text
    assert changed > 10


def test_very_long_texts(spark):
    piece = " ".join(f"v{i}" for i in range(1000))
    docs = spark.createDataFrame([(1, " ".join(f"u{i}" for i in range(100_000)) + (" " + piece) * 40), (2, piece), (3, "y" * 1_000_000)], DOC)
    got = {r.doc_id: r for r in periodic_runs(docs).collect()}
    assert [tuple(x) for x in got[1].runs] == [(100_000, 40_000, 1000)] and len(got[1].text.split()) == 101_000 and got[3].n_words == 1
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in S.substring_dedup(docs).collect()}
    assert cut == {1: (140_000, 0), 2: (1000, 1000), 3: (1, 0)}


def plain_substrings(rows, window):
    first = {}
    for i, text in rows:
        words = (text or "").split()
        for k in range(len(words) - window + 1 if i is not None else 0):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        words = (text or "").split()
        gone = {x for k in range(len(words) - window + 1 if i is not None else 0) if first[tuple(words[k : k + window])] < i for x in range(k, k + window)}
        out.append((i if i is not None else -1, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out)


def passages(seed):
    """Documents made of shared passages, copies, near copies and words of their own."""
    rng = random.Random(seed)
    pool = [[f"p{j}w{rng.randrange(30)}" for _ in range(rng.randint(5, 120))] for j in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(pool) if rng.random() < 0.6 else [f"d{i}x{k}" for k in range(rng.randint(1, 60))]
        if words and rng.random() < 0.3:
            words[rng.randrange(len(words))] = "changed"
        rows.append((rng.randint(0, 150), rng.choice([" ", "  ", "\n"]).join(words)))
    hot = [f"h{k}" for k in range(70)]
    rows += [(200 + i, " ".join([f"a{i}", *hot, f"b{i % 7}"])) for i in range(60)]
    return [*rows, rows[3], (None, rows[0][1]), (7, None), (8, ""), (9, "short text")]


@pytest.mark.parametrize(("seed", "hot"), [(1, S.HOT_BYTES), (2, 0), (3, 3000)])
def test_substring_dedup_beside_brute_force(spark, monkeypatch, seed, hot):
    """Strings in buckets, all of them window by window, and some of each."""
    monkeypatch.setattr(S.repeated_spans, "__defaults__", (S.WINDOW, S.NGRAM, 5000, hot))
    rows = passages(seed)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.text) for r in S.substring_dedup(spark.createDataFrame(rows, DOC).repartition(4)).collect())
    assert got == plain_substrings(rows, S.WINDOW)
    assert sum(x[2] for x in got) > 1000


@pytest.mark.parametrize(("window", "ngram"), [(7, 3), (3, 3), (1, 1), (50, 12)])
def test_super_kmers_hold_each_window_once(window, ngram):
    rng = random.Random(window)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 300))) for _ in range(40)]
    data, starts, ends, counts, hashes = S._batch_words(pa.array(texts))
    row, first, windows, value = S.super_kmers(hashes, counts, window, ngram)
    held = sorted((r, f + k) for r, f, n in zip(row.tolist(), first.tolist(), windows.tolist()) for k in range(n))
    base = np.cumsum(counts) - counts
    assert held == [(r, int(base[r]) + k) for r in range(len(texts)) for k in range(counts[r] - window + 1)]
    assert windows.max() <= S.MOST_WINDOWS
    packed = S._packed(data, starts, ends, first, windows + window - 1).to_pylist()
    every = [w for t in texts for w in t.split()]
    assert [p.decode() for p in packed] == [" ".join(every[f : f + n + window - 1]) for f, n in zip(first.tolist(), windows.tolist())]
    of = {}
    for r, f, n, m in zip(row.tolist(), first.tolist(), windows.tolist(), value.tolist()):
        for k in range(n):
            of.setdefault(tuple(every[f + k : f + k + window]), set()).add(m)
    assert all(len(x) == 1 for x in of.values())  # equal windows have one minimiser


def test_window_ranks_are_exact():
    texts = ["a b c a b c a b", "c a b c", "a b c", "a b", "é b c"]
    number, own, at = S.window_ranks(pa.array([t.encode() for t in texts], pa.binary()), 3)
    words = [tuple(texts[i].split()[k : k + 3]) for i, k in zip(own.tolist(), at.tolist())]
    assert len(words) == 6 + 2 + 1 + 1 and len({*zip(number.tolist(), words)}) == len(set(words)) == len(set(number.tolist()))


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in seeds]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((away(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = {j: sum(d for _, o, d in last if o == j) for _, j, _ in last}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i if i is not None else -1), j, d, sums[j], sum(sums.values()), digest[j]) for i, j, d in last)


def test_clusters_beside_brute_force(spark):
    rng = np.random.RandomState(4)
    middle = rng.randn(12, 64)
    rows = [(i, [float(np.float32(x)) for x in middle[i % 12] + rng.randn(64) * 0.4]) for i in range(150)]
    bad = [(200, None), (201, rows[0][1][:63]), (202, [*rows[0][1][:63], None]), (203, [*rows[0][1][:63], float("nan")]), (204, [*rows[0][1][:63], float("inf")]), (205, [])]
    more = [(None, rows[1][1]), rows[2], rows[2], (2, rows[3][1]), (206, [0.0] * 64)]
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows + bad + more], "vec_id long, embedding array<float>, v int, id int, cluster string")
    report = {}
    got = cluster_vectors(frame.repartition(5), report=report)
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got.collect()) == plain_clusters(rows + more)
    assert report["made"] < 0.2 * report["full"]


def test_few_and_tied_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert cluster_vectors(spark.createDataFrame([], kind)).count() == 0
    assert cluster_vectors(spark.createDataFrame([(1, None)], kind)).count() == 0
    same = [(i, [0.5] * 64) for i in range(20)]  # all centroids equal: number 0 takes them
    assert sorted(tuple(r) for r in cluster_vectors(spark.createDataFrame(same, kind)).collect()) == plain_clusters(same)
    few = [(i, [i * 0.1] * 64) for i in range(3)]
    assert sorted(tuple(r) for r in cluster_vectors(spark.createDataFrame(few, kind)).collect()) == plain_clusters(few)
    with pytest.raises(Exception, match="too large"):
        cluster_vectors(spark.createDataFrame([(1, [1e30] * 64)], kind)).count()


def test_bounds_never_exceed_distances():
    rng = np.random.RandomState(0)
    for scale in (1, 1024, 1 << 26):
        vectors, centroids = (rng.randn(200, 64) * scale / 4).astype(np.int64), (rng.randn(8, 64) * scale / 4).astype(np.int64)
        vectors[:8] = centroids
        screen = Screen(centroids)
        exact = ((vectors[:, None, :] - centroids[None]) ** 2).sum(2)
        assert (screen.bounds(Compressed.of(vectors)) <= exact).all()
        best, distance, _ = screen.nearest(vectors, Compressed.of(vectors))
        assert (distance == exact.min(1)).all() and (best == exact.argmin(1)).all()


def test_clashing_names(spark):
    rows = passages(5)[:40]
    docs = spark.createDataFrame(rows, DOC)
    full = docs
    for i, name in enumerate(dict.fromkeys([x.lower() for x in NAMES] + ["minimiser", "packed", "string", "bucket", "spans", "_spans", "least", "most", "v", "c", "n_words"])):
        if name not in [c.lower() for c in full.columns]:
            full = full.withColumn(name if i % 2 else name.upper(), F.lit(i))
    for run, columns in ((S.substring_dedup, ["doc_id", "text", "n_words", "n_removed"]), (periodic_runs, ["doc_id", "text", "n_words", "runs"])):
        order = lambda df: sorted(repr(tuple(r)) for r in df.select(*columns).collect())  # noqa: B023, E731
        assert order(run(docs)) == order(run(full)) and {c.lower() for c in full.columns} <= {c.lower() for c in run(full).columns}
    assert S.substring_dedup(docs.limit(0)).count() == 0

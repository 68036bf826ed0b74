"""Model files that run: a small encoder and a small scorer, written field by field in the format of ONNX, in Spark's workers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import models as M
from corvane.operators.vectors import cosine_top_k
from corvane.plans.search import SearchEngine

pytest.importorskip("onnxruntime")
tokenizers = pytest.importorskip("tokenizers")

WORDS = "[PAD] [UNK] [CLS] red green apple pear car road".split()
TABLE = np.array([[0, 0, 0], [0, 0, 0.1], [0.1, 0.1, 0.1], [1, 0, 0], [1, 0.2, 0], [0, 1, 0], [0.1, 1, 0], [0, 0, 1], [0, 0.1, 1]], dtype=np.float32)
WEIGHTS = np.array([0, -1, 0.5, 1, 1, 2, 2, -3, -3], dtype=np.float32)


def number(x):
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def field(key, value):
    """One field of a message: an integer, or bytes with their length."""
    if isinstance(value, int):
        return number(key << 3) + number(value)
    value = value.encode() if isinstance(value, str) else value
    return number(key << 3 | 2) + number(len(value)) + value


def tensor(name, values):
    return b"".join(field(1, d) for d in values.shape) + field(2, 1) + field(8, name) + field(9, values.astype("<f4").tobytes())


def value(name, kind, dims):
    shape = b"".join(field(1, field(2, d)) for d in dims)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))


def node(op, inputs, output, *attributes):
    return b"".join(field(1, x) for x in inputs) + field(2, output) + field(4, op) + b"".join(field(5, a) for a in attributes)


def model(nodes, tensors, inputs, output):
    graph = b"".join(field(1, n) for n in nodes) + field(2, "g") + b"".join(field(5, t) for t in tensors)
    graph += b"".join(field(11, value(x, 7, ["b", "t"])) for x in inputs) + field(12, output)
    return field(1, 6) + field(7, graph) + field(8, field(1, "") + field(2, 11))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    where = tmp_path_factory.mktemp("models")
    made = tokenizers.Tokenizer(tokenizers.models.WordLevel({w: i for i, w in enumerate(WORDS)}, unk_token="[UNK]"))
    made.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    made.post_processor = tokenizers.processors.TemplateProcessing(single="[CLS] $A", pair="[CLS] $A $B:1", special_tokens=[("[CLS]", 2)])
    made.save(str(where / "tokenizer.json"))
    (where / "encoder.onnx").write_bytes(model([node("Gather", ["table", "input_ids"], "hidden")], [tensor("table", TABLE)], ["input_ids", "attention_mask"], value("hidden", 1, ["b", "t", "d"])))
    to_float = field(1, "to") + field(3, 1) + field(20, 2)
    axes = field(1, "axes") + field(8, 1) + field(20, 7)
    scorer = [node("Gather", ["weights", "input_ids"], "w"), node("Cast", ["token_type_ids"], "second", to_float), node("Mul", ["w", "second"], "product"), node("ReduceSum", ["product"], "score", axes)]
    (where / "scorer.onnx").write_bytes(model(scorer, [tensor("weights", WEIGHTS)], ["input_ids", "attention_mask", "token_type_ids"], value("score", 1, ["b", "one"])))
    return where


def pooled(text, tokens):
    ids = [2, *[WORDS.index(w) if w in WORDS else 1 for w in text.split()]][:tokens]
    mean = TABLE[ids].mean(axis=0)
    return mean / np.linalg.norm(mean)


TEXTS = ["red apple", "green pear", "car road", "", "strange words here", " ".join(["apple"] * 40), None]


def test_an_encoder_file(spark, files):
    load = M.onnx_encoder(str(files / "encoder.onnx"), str(files / "tokenizer.json"), tokens=8)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, content string").repartition(3)
    got = {r.doc_id: r.embedding for r in M.with_vectors(rows, load, dimensions=3).collect()}
    assert got[6] is None
    for i, text in enumerate(TEXTS[:6]):
        assert got[i] == pytest.approx(pooled(text, 8), abs=1e-5)
    near = M.with_vectors(rows, load, dimensions=3)
    asked = near.where("doc_id = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    assert [r.doc_id for r in cosine_top_k(asked, near, 2).orderBy("rank").collect()] == [0, 1]


def test_a_scorer_file(spark, files):
    load = M.onnx_scorer(str(files / "scorer.onnx"), str(files / "tokenizer.json"), tokens=16)
    pairs = [("red", "apple pear"), ("red", "car"), ("apple apple", ""), (None, None), ("x", "road apple")]
    got = [r.s for r in spark.createDataFrame(pairs, "q string, t string").coalesce(1).select(M.scorer(load)(F.col("q"), F.col("t")).alias("s")).collect()]
    raw = [4, -3, 0, 0, -1]  # the words of the second text only
    assert got == pytest.approx([round(1 / (1 + np.exp(-x)), 4) for x in raw], abs=1e-4)


def test_a_search_with_both(spark, files):
    """Vectors and reranking by model files inside the whole plan."""
    encode = M.onnx_encoder(str(files / "encoder.onnx"), str(files / "tokenizer.json"), tokens=8)
    score = M.scorer(M.onnx_scorer(str(files / "scorer.onnx"), str(files / "tokenizer.json"), tokens=16))
    docs = spark.createDataFrame([(1, "red apple", "a"), (2, "green pear", "b"), (3, "car road", "c"), (4, "red car", "d")], "doc_id long, content string, title string")
    vectors = M.with_vectors(docs, encode, dimensions=3).select("doc_id", "embedding")
    encoder = lambda asked: M.with_vectors(asked, encode, "query", dimensions=3).select("query_id", "embedding")
    engine = SearchEngine.of(docs, vectors, encoder, score, stemming=False)
    asked = spark.createDataFrame([(0, "red")], "query_id long, query string")
    dense = engine.search(asked, "dense", 2, reranked=False).orderBy("rank").collect()
    v = {i: pooled(t, 8) @ pooled("red", 8) for i, t in ((1, "red apple"), (2, "green pear"), (3, "car road"), (4, "red car"))}
    assert [r.doc_id for r in dense] == sorted(v, key=lambda i: -v[i])[:2]
    ranked = engine.search(asked, "hybrid", 4).orderBy("rank").collect()
    # raw scores 3, 3, -2, -6; of equal ones the better fused comes first
    assert [r.doc_id for r in ranked] == [1, 2, 4, 3]
    assert [r.score for r in ranked] == pytest.approx([round(1 / (1 + np.exp(-x)), 4) for x in (3, 3, -2, -6)], abs=1e-4)

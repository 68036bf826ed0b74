"""Text encoders and pair scorers as Arrow UDFs: a model is loaded once in a worker and sees whole batches.

A model is given by a function without arguments that loads it.  For an
encoder it returns a function from a list of texts to a matrix of token
vectors and a mask, or to finished vectors; for a scorer a function from a
list of pairs to raw scores.  ``onnx_encoder`` and ``onnx_scorer`` make such
functions for model files that the workers can read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENCODER_TOKENS, SCORER_TOKENS, DIMENSIONS = 256, 512, 384
#: Texts that a model sees at once.
BATCH_TEXTS = 64

#: Texts to vectors; pairs to raw scores.
Encode = Callable[[list[str]], np.ndarray]
Score = Callable[[list[tuple[str, str]]], np.ndarray]


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the token vectors whose mask is 1, at length 1: (texts, dimensions) float32."""
    weight = mask[:, :, None].astype(np.float32)
    mean = (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _session(model_path: str, tokenizer_path: str, tokens: int):
    """An ONNX session, its input names, and a tokenizer that cuts and pads to ``tokens``."""
    import onnxruntime
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.enable_truncation(max_length=tokens)
    tokenizer.enable_padding(length=tokens)
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1  # a worker has one core
    session = onnxruntime.InferenceSession(model_path, sess_options=options, providers=["CPUExecutionProvider"])
    return session, [x.name for x in session.get_inputs()], tokenizer


def model_inputs(encodings: list, names: list[str], typed: bool) -> dict[str, np.ndarray]:
    """What the model is fed with; the types of tokens only if it asks for them (zeros unless ``typed``)."""
    fed = {"input_ids": np.array([e.ids for e in encodings], dtype=np.int64), "attention_mask": np.array([e.attention_mask for e in encodings], dtype=np.int64)}
    if "token_type_ids" in names:
        fed["token_type_ids"] = np.array([e.type_ids for e in encodings], dtype=np.int64) if typed else np.zeros_like(fed["input_ids"])
    return fed


def onnx_encoder(model_path: str, tokenizer_path: str, tokens: int = ENCODER_TOKENS) -> Callable[[], Encode]:
    """Loads a sentence encoder: fixed-length padding, mean pooling, vectors of length 1."""

    def load() -> Encode:
        session, names, tokenizer = _session(model_path, tokenizer_path, tokens)

        def encode(texts: list[str]) -> np.ndarray:
            fed = model_inputs(tokenizer.encode_batch(texts), names, False)
            return pooled(session.run(None, fed)[0], fed["attention_mask"])

        return encode

    return load


def onnx_scorer(model_path: str, tokenizer_path: str, tokens: int = SCORER_TOKENS) -> Callable[[], Score]:
    """Loads a cross-encoder: one raw score for each (query, text)."""

    def load() -> Score:
        session, names, tokenizer = _session(model_path, tokenizer_path, tokens)
        return lambda pairs: np.asarray(session.run(None, model_inputs(tokenizer.encode_batch(pairs), names, True))[0]).ravel()

    return load


def encode_batch(encode: Encode, texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """(texts, dimensions) float32, some texts at a time; (0, dimensions) for no texts."""
    parts = [np.asarray(encode(texts[i : i + BATCH_TEXTS]), dtype=np.float32) for i in range(0, len(texts), BATCH_TEXTS)]
    return np.concatenate(parts) if parts else np.empty((0, dimensions), dtype=np.float32)


def predict(score: Score, pairs: list[tuple[str, str]]) -> list[float]:
    """Probabilities of the pairs, 4 places; none for no pairs."""
    raw = [np.asarray(score(pairs[i : i + BATCH_TEXTS]), dtype=np.float64) for i in range(0, len(pairs), BATCH_TEXTS)]
    return np.round(1.0 / (1.0 + np.exp(-np.concatenate(raw))), 4).tolist() if raw else []


def encoder(load: Callable[[], Encode], dimensions: int = DIMENSIONS) -> Callable[[Column], Column]:
    """An expression that turns texts into vectors. A null text gives a null vector."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            known = texts.notna()
            found = iter(encode_batch(encode, texts[known].tolist(), dimensions))
            yield pd.Series([next(found) if k else None for k in known], index=texts.index, dtype=object)

    return vectors


def scorer(load: Callable[[], Score]) -> Callable[[Column, Column], Column]:
    """An expression that scores (query, text); null texts count as empty."""

    @F.pandas_udf(T.DoubleType())
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = load()
        for queries, texts in batches:
            yield pd.Series(predict(score, list(zip(queries.fillna("").tolist(), texts.fillna("").tolist(), strict=True))), index=queries.index, dtype=float)

    return scores


def with_vectors(rows: DataFrame, load: Callable[[], Encode], text_col: str = "content", vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """``rows`` with the vector of a text."""
    return rows.withColumn(vector_col, encoder(load, dimensions)(F.col(text_col)))

"""The small evaluation set: six documents, six queries, one relevant document each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The documents (id, text, title) and the queries (text, relevant document) of the evaluation.
DOCUMENTS = (
    (1, "B-Tree and LSM-Tree storage engines: B-Trees optimize for fast point lookups and in-place updates via balanced tree nodes, while Log-Structured Merge (LSM) trees optimize for high-throughput sequential writes using append-only commit logs and background compaction.", "Storage Engines: B-Trees vs LSM"),
    (2, "Hierarchical Navigable Small World (HNSW) graphs: HNSW provides state-of-the-art approximate nearest neighbor search over high-dimensional vector embeddings with logarithmic time complexity using multi-layer graph skip-lists.", "HNSW Vector Indexing"),
    (3, "Backpropagation and Automatic Differentiation: Reverse-mode automatic differentiation calculates gradients of the loss function with respect to weights using the chain rule, enabling efficient gradient descent in deep neural networks.", "Deep Learning Gradients & Autograd"),
    (4, "FastAPI and ASGI Web Frameworks: FastAPI utilizes Starlette and Pydantic for asynchronous request handling, schema validation, and OpenAPI documentation with high concurrency on Uvicorn.", "Asynchronous Web APIs with FastAPI"),
    (5, "Raft Distributed Consensus: Raft achieves fault-tolerant distributed state machine replication through leader election, log replication, and randomized election timeouts to prevent split-brain scenarios.", "Raft Distributed Consensus"),
    (6, "Transformer Multi-Head Self-Attention: Scaled dot-product attention computes interactions between all pairs of input tokens with O(N^2) complexity, enabling bidirectional contextual representations in BERT and GPT architectures.", "Transformer Attention Mechanics"),
)
QUERIES = (
    ("how to quickly route and search nearest embeddings in high dimensional space", 2),
    ("preventing split-brain and achieving agreement in distributed systems clusters", 5),
    ("calculating loss derivatives and weights optimization in neural networks", 3),
    ("FastAPI Starlette Pydantic ASGI", 4),
    ("Log-Structured Merge LSM-Tree append-only", 1),
    ("Scaled dot-product attention O(N^2) complexity tokens", 6),
)
GRADE = 3.0


def evaluation_set(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents(doc_id, content, title), queries(query_id, query), judgements(query_id, doc_id, grade)."""
    documents = spark.createDataFrame(list(DOCUMENTS), "doc_id long, content string, title string")
    queries = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(QUERIES)], "query_id long, query string")
    return documents, queries, spark.createDataFrame([(i, doc, GRADE) for i, (_, doc) in enumerate(QUERIES)], "query_id long, doc_id long, grade double")

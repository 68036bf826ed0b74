"""Index, ranking, fusion, metrics and chunking operators."""

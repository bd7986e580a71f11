"""Column expressions: text, vectors, scores, embeddings."""

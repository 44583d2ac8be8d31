"""Text formats of temporal graphs, labels, embeddings and results."""

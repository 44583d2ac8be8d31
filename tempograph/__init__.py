"""Dynamic-graph analytics on Spark: temporal edges as relations, matrices as sparse relations, embeddings and their evaluation."""

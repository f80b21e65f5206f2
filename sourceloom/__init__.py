"""Text-corpus retrieval as Spark jobs: filter, chunk, vectorize, search, cite, evaluate."""

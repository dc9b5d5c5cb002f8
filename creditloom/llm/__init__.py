"""Training-data operators: deduplication, quality, secrets, mixing, tokens, nearest vectors, URLs, runs and whitening."""

"""Training-data operators: search, filters, deduplication, language models and packing for text corpora."""

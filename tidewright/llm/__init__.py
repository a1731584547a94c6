"""Training-data operators: deduplication, classification, extraction, tokenisation and mixing."""

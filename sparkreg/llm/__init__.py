"""Training-data operators: deduplication, extraction, classification,
mixing, tokenising and search over document, page and vector tables."""

"""Training-data operators: tokenising, media, search, classifiers, mixing, privacy, deduplication."""

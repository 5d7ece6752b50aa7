"""Operators for building training corpora (mixing, toxicity, de-duplication, quality, search, sharding, language-model
scoring, packing and licence scans).  Nothing else in the library imports this subpackage."""

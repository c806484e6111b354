"""Operators for large text corpora: mixing, scoring, packing, dedup, archives, search, chat."""

"""Operators for large text corpora: filters, near copies, repeats, scores, counts and packing."""

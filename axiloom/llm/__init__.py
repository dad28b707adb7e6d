"""Operators of a training-data pipeline: dedup, filtering, labelling, mixing and packing of text corpora."""

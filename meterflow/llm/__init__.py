"""Operators that prepare a text corpus for training, their registered queries, and the pipeline's building blocks."""

"""Readers that turn files, text and driver tables into typed DataFrames."""

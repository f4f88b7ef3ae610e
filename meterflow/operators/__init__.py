"""Relational and ordered-state operators over readings and time slices."""

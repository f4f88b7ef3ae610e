"""Query API and the catalogue of runnable queries with their SQL counterparts."""

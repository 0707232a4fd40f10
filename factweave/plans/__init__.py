"""Compositions of operators, and the query catalogue built from them."""

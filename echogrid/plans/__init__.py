"""Queries over the given tables: each operator applied to relations derived from them."""

"""Corpora made from the synthetic tables, and the queries asked of them."""

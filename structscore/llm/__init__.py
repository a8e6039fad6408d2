"""Operators for preparing training data: thirteen jobs over `documents`, `pages` and `embeddings`.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the `op*` queries and their SQL live in `catalog`.
"""

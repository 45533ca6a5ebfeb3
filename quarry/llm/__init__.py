"""Operators for large-scale training-data pipelines over text corpora.

Nothing outside this subpackage imports it.  Every operator is a function
from DataFrames to a DataFrame; :mod:`quarry.llm.registry` binds them to the
``documents`` / ``embeddings`` / ``conversations`` tables as queries.
"""

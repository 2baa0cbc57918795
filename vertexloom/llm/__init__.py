"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every module holds one operator with a
general interface; :mod:`vertexloom.llm.queries` derives the registered queries from them.
"""

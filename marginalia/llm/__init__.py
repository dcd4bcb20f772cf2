"""Operators for preparing large language-model training corpora.

Nothing outside this subpackage imports it.  ``entries`` holds the queries and
their SQL; each operator lives in a module of its own.
"""

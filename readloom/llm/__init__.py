"""Corpus operators for language-model training data.

Nothing outside this package imports it; :mod:`readloom.llm.queries`
registers one query per operator.
"""

"""Operators for large text corpora: deduplication, token counting, decontamination, mixing, quality, output.

Nothing outside this subpackage imports it.  ``llm.queries`` lists the registered queries.
"""

"""Training-data operators: token files, deduplication, filtering and scoring.

Nothing outside this subpackage imports it.  Every module holds one operator
with its own general interface; :mod:`pagequarry.llm.queries` derives the
registered queries from them.
"""

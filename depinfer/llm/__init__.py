"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Each ``opN_*`` module holds one
operator with a general interface; :mod:`depinfer.llm.queries` derives the thin
per-table queries from them.
"""

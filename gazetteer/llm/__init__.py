"""Operators of a training-data pipeline.

Nothing else in the package imports this subpackage.  Each module holds one operator with a general interface; the thin
`opN_*` queries over the standard tables, and their SQL, are in `gazetteer.llm.queries`.
"""

"""Training-data operators: one module per operator, queries in ``citeloom.llm.queries``.

Nothing else in the library imports this subpackage.
"""

"""Operators for large training corpora; nothing else in the library imports this subpackage.

Each module holds one operator with its general interface, and the thin query that
:mod:`stepweave.llm.registry` registers for it.
"""

"""Operators for preparing training text at large scale.

Nothing else in the package imports this subpackage; its queries and SQL live in
``plurality.llm.queries``.
"""

"""Operators for large training corpora; nothing else in the library imports them.

``foldwise.llm.queries`` registers one query for each; it is not imported here,
so that tasks load only the operator they run.
"""

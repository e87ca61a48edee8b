"""Operators for preparing training text at corpus scale.

One module per operator; nothing outside this package imports it.  The thin
queries that apply each operator to a whole table are in
:mod:`termlens.llm.queries`.
"""

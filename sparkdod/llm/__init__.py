"""Operators of a training-data pipeline over a ``documents`` table.

Each module holds one operator with its own general interface; ``queries``
registers one thin query per operator and the DuckDB SQL where SQL can
express the result. Nothing outside this package imports it.
"""

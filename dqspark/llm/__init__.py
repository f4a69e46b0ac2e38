"""Operators for preparing training text at scale, each with its registered query.

One module per operator; ``queries`` gathers the registered functions and their SQL.
"""

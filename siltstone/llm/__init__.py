"""Operators of a training-data pipeline: text, chat, token and embedding corpora.

Nothing outside this subpackage imports it. ``registry`` lists its queries and SQL.
"""

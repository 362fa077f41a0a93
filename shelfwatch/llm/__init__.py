"""Operators of a training-data pipeline over tables of documents, pages and conversations.

Nothing outside this package imports it; ``queries`` holds the registered queries and their SQL.
"""

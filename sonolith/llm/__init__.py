"""Operators for preparing training corpora, on documents, pages and labels.

Nothing outside this folder imports it. Every module holds one operator with
its general interface; ``registry`` holds the thin queries and their SQL.
"""

"""Training-data operators: scoring, ordering, chat text, quality, dedup, search, mixing, tokens, PII.

Nothing outside this package imports it; ``queries`` holds the registered
queries and their SQL.
"""

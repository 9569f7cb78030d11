"""Training-data pipeline operators: dedup, decontamination, language, tokens, filters.

Each module is one operator with a general DataFrame interface; ``queries`` derives the thin
registered queries from them.  Nothing else in the library imports this subpackage.
"""

"""Operators for preparing training text at scale.

Nothing outside this package imports it; ``corpus_pipeline.py`` and the
``op*`` queries are its only users.
"""

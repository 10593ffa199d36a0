"""Operators for preparing training text at scale.

Nothing outside this package, ``corpus_pipeline`` and ``tests/llm`` imports it.
"""

"""Operators that a training-data pipeline needs: near-duplicates, language, PII, toxicity and the like.

Nothing outside this folder imports it.
"""

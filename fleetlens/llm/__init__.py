"""Operators for preparing language-model training data (see README, section llm).

Nothing else in the library imports this subpackage.
"""

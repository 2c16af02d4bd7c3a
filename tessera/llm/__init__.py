"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage. Every operator has its own
module with a general interface; ``queries`` holds the registered queries.
"""

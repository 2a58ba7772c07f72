"""Operators that prepare training text, each with a general interface; queries.py applies them to the test tables."""

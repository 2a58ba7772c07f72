"""The driver contract's queries, bound to the test tables."""

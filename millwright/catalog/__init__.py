"""Queries over the test tables, each with an equivalent SQL text where SQL can say it."""

"""Queries over the test tables, with the same queries as SQL where SQL can say them."""

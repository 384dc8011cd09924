"""Registered queries over the given tables, each with its independent SQL where SQL can say it."""

"""Queries over the test tables that apply the operators, each with its SQL where SQL expresses it."""

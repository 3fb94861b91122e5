"""Relational, ranking, graph and reconciliation operators."""

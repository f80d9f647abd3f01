"""Relational, graph, vector and planner operators."""

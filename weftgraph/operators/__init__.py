"""Operators on the graph and on its deliveries."""

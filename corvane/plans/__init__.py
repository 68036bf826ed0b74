"""Whole search plans and the registered queries."""

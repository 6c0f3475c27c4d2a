"""Derived inputs and the catalogue of queries."""

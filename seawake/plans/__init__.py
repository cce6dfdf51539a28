"""Marts and analytic queries."""

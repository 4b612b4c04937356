"""Registered queries with their SQL oracles, and small languages compiled to columns."""

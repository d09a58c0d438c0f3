"""Registered driver queries and their SQL oracles."""

"""Operators as SQL templates over named tables, written once for Spark and for the oracle."""

"""Operators on panel tables; each returns lazy DataFrames."""

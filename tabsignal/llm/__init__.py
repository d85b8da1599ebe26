"""Training-data operators.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, selects the columns it needs by exact name (so extra columns whose
names differ in case only do no harm), and states in its docstring what it
gives for nulls, empty and very long texts, ties, repeated rows and empty
tables.
"""

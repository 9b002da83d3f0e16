"""Readers of the common source formats. Parsers work on DataFrames of lines or records."""

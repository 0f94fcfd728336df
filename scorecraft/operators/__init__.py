"""Relational operators of the evaluation flow (records, parsing, scoring,
summaries).  Functions take and return DataFrames."""

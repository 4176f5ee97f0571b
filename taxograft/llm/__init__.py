"""Operators of a training-data pipeline: clean-up, duplicates, decontamination, mixing, audits.

Nothing outside this folder imports it.  Every operator takes DataFrames and column names it
documents, ignores other columns, and defines what nulls, empty texts and repeated rows mean.
"""

"""Warehouse housekeeping on Spark: which tables exist, who uses them, what they feed.

Inputs are three tables (catalog, job or daily usage log, lineage links); every
function takes and returns DataFrames.
"""

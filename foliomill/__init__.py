"""Foliomill: processing of business documents as Spark jobs.

Every stage is a function from DataFrame to DataFrame.  A document is one row; all
per-document work is row-local, so shuffles happen only where rows of several
documents really meet (roll-ups, state versions, corpus statistics).
"""

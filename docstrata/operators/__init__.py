"""Operators over DataFrames: prefilter, references, clauses, rules, versions, gate, coverage, measures, queues."""

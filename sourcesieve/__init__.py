"""Declarative analysis of source text on Spark: tokens, syntax trees, rules and diagnostics as DataFrames."""

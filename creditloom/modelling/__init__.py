"""Splitting, fitting, tuning and judging default classifiers with Spark ML."""

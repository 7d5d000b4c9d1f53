"""Cohort analytics on Spark DataFrames: codes, admissions, sequences, statistics, models."""

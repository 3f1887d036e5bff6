"""Accounts-payable analytics on Spark DataFrames: parse, extract, validate, reconcile, deduplicate, sync, report."""

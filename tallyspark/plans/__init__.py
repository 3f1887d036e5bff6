"""Whole runs: process, sync, report, evaluate."""

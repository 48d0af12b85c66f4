"""Whole plans: reconciliation acts, page analysis, the process store."""

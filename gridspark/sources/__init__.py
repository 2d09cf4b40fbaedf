"""Workbooks in and out of tables."""

"""Meanings of values, formats and worksheet functions."""

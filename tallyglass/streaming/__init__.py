"""Operators that run on streams of files."""

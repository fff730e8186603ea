"""Operators on streams of reads."""

"""Operators on tables of reads, overlaps, graphs, bubbles and coverage."""

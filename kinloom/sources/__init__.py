"""Readers and writers of text formats. Paths are opened by Spark alone, so any store it knows will do."""

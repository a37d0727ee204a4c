"""Streaming forms of the operators that are incremental by nature."""

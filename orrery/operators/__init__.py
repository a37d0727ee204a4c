"""Relational and iterative operators; every one takes and returns DataFrames."""

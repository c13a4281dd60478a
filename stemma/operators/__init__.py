"""Relational, sequence, spatial, quality and search operators over DataFrames."""

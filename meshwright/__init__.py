"""Meshwright: graph and co-activation analytics over DataFrames."""

__version__ = "0.1.0"

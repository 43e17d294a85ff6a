"""Listing curation, record linkage, feature building and grouped price modelling on Spark."""

__version__ = "0.1.0"

"""Operators over versioned key/value logs: plain functions from DataFrames to DataFrames."""

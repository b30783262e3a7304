"""Operators: functions from DataFrames to one DataFrame."""

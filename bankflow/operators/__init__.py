"""Operators: functions from DataFrames to DataFrames, without sessions or writes."""

"""Operators: functions from DataFrames to DataFrames. None collects rows to the driver."""

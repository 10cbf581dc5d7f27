"""Operators: functions from DataFrames to DataFrames that neither collect nor loop over rows."""

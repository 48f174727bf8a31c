"""Batch and streaming Spark jobs for classifying light curves: functions that take and return DataFrames."""

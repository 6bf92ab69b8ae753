"""Trajectory, event and review analytics on Spark DataFrames."""

"""Trajectory and physics-evaluation analytics expressed as Spark DataFrames."""

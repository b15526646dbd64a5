"""Versioned file trees as Spark DataFrames: snapshots, comparison, history, merging, restoring and change streams."""

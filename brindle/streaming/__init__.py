"""Partitioned event logs: producing, consuming, offsets, dead letters; batch twins and Structured Streaming."""

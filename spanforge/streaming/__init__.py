"""Metric streams: windows, alerts and micro-batches."""

"""Logs that keep arriving, handled by the same scans and constraints in micro-batches."""

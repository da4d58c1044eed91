"""Readers of log wire formats and the partitioned store."""

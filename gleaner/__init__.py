"""Consensus recovery of an event table from redundant, noisy text readings, on Spark."""

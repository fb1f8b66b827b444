"""Batch model runs over tables, and small local models."""

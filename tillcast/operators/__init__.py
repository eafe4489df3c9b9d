"""Batch operators. Each one is a function from DataFrame(s) to DataFrame."""

"""Whole jobs over tables, and the queries registered for them."""

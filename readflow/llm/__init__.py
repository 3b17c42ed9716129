"""Operators for preparing training text; each module holds one, ``queries`` registers them."""

"""Operators for preparing training text: one module each, with a DataFrame in and a DataFrame out."""

"""Operators for preparing training text at large scale; nothing else in the library imports them."""

"""Operators for training text. Nothing outside imports this subpackage."""

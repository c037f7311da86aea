"""Operators for preparing training text at scale; nothing else in the library imports this subpackage."""

"""Subpackage of polyrun."""

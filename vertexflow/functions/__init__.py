"""Comparison and bit functions."""

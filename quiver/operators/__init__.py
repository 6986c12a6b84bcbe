"""Quiver operators."""

"""Quiver plans."""

"""Quiver functions."""

"""Quiver streaming."""

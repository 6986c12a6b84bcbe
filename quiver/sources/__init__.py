"""Quiver sources."""

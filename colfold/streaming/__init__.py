"""Folded files as streams."""

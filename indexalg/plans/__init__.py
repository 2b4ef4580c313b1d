"""Rewrites of trees, and trees as text."""

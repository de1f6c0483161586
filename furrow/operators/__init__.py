"""Analyses of the run matrix, paths and routes, as DataFrame operations."""

"""Composed jobs and the registry of runnable queries."""

"""Readers, writers and the derived statement tables."""

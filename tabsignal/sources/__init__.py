"""Readers, writers and logs."""

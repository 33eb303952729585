"""Stored tables and files."""

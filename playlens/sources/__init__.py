"""Readers, writers and the derived test fixtures."""

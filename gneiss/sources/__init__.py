"""Readers and writers of bundles, tables and timed text."""

"""Readers and writers for files and catalog tables."""

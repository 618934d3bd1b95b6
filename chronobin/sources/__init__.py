"""Readers and writers of instrument event files."""

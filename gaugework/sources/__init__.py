"""Readers with quarantine, and write-once publication."""

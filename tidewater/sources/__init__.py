"""Readers, writers, versioned tables and SQL access."""

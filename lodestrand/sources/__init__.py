"""Readers, writers, the versioned store and the remote connector."""

"""Readers and writers: sales files, stored tables, versioned snapshots."""

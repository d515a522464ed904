"""Readers and writers: sensor datasets, passages, vectors, results, snapshots."""

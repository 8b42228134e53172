"""Readers and writers: raw CSV with lineage, partitioned tables, versioned snapshots."""

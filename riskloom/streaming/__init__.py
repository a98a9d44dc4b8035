"""Incremental and streaming forms; each also runs in batch on a plain table."""

"""Incremental work. The inventory has no event streams; what restarts is the rebuild."""

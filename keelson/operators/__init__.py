"""Operators over versioned rows: merge, modification, compaction."""

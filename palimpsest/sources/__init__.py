"""Sources of snapshots: tables, and worlds of region files."""

"""Operators over snapshots: tables of (dim, kind, x, z, hash), one row for each chunk that is present."""

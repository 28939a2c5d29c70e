"""Commits from a stream of snapshots."""

"""Relational operators over listings, versions, snapshots, packs and reference graphs."""

"""Trustweave: typed knowledge graphs over disagreeing sources, computed by Spark."""

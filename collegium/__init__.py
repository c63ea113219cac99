"""Collegium: academic records, public notices and change detection as Spark DataFrame operations."""

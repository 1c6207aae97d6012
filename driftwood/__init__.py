"""Spark jobs for searching and preparing document collections."""

"""Kolumna: a columnar SQL analytics engine on Spark."""

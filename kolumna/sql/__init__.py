"""The SQL front end: text to syntax trees."""

from kolumna.sql.parser import parse

__all__ = ["parse"]

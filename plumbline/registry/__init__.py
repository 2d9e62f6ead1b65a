"""The operators applied to the test tables, each next to the same question in
ANSI SQL."""

from plumbline.registry.oracle import ORACLE_SQL
from plumbline.registry.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

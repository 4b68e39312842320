"""The registered queries over the given tables, and equivalent DuckDB SQL."""

from echolith.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

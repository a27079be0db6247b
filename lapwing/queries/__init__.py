"""Registered queries: each reads the given tables; most carry an independent SQL statement."""

from lapwing.queries.registry import REGISTRY  # noqa: F401

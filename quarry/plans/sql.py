"""Pieces of oracle SQL."""

from __future__ import annotations


def half_up(x: str, digits: int = 0) -> str:
    return f"floor(CAST({x} AS DOUBLE) * {10**digits}e0 + 0.5e0) / {10**digits}e0"


def ratio(num: str, den: str, digits: int | None = None, scale: int = 1) -> str:
    q = f"(CAST({num} AS DOUBLE) * {scale}e0 / nullif(CAST({den} AS DOUBLE), 0e0))"
    return q if digits is None else half_up(q, digits)


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def since(table: str, days: float, op: str = ">=", more: str = "") -> str:
    span = f"{days} DAY" if days >= 1 else "1 HOUR"
    return f"FROM {{{table}}} WHERE created_at {op} (SELECT max(created_at) FROM {{llm_calls}}) - INTERVAL {span}{more}"

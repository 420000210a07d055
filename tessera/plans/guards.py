"""Size checks in front of every broadcast.

A side is broadcast only when it is provably small: either a fixed literal
table or a DataFrame whose row count *and* approximate size we check (cheap
aggregates, run only on inputs already bounded by the row limit).  Above the
bounds the caller's plan falls back to a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20


def broadcast_small(df: DataFrame, what: str, max_rows: int = MAX_BROADCAST_ROWS,
                    max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when it has at most ``max_rows`` rows and its rows, as JSON
    text, total at most ``max_bytes``; otherwise ``df`` unchanged (shuffle join)."""
    row_bytes = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(row_bytes)).first()  # one small job
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


def broadcast_literal(df: DataFrame) -> DataFrame:
    """Broadcast a table built from fixed literals in this package (size known)."""
    return F.broadcast(df)

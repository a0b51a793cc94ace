"""Queries of event-time windows and per-document state over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import state
from .registry import query


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(t):
    return state.tumbling(t.events, "1 hour", ["event_type"]).select("start", "event_type", "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, i""")
def session_counts(t):
    return state.sessions(t.events, "30 minutes", ["user_id"]).select("user_id", "start", "n")


@query("SELECT user_id AS docid, count(*) AS consumed FROM events GROUP BY 1")
def document_state(t):
    """Facts gather per document and are consumed at the barrier."""
    return state.consume_documents(t.events.select(F.col("user_id").alias("docid"), "event_id"), "docid")

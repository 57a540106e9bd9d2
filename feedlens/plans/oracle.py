"""DuckDB forms of the fixture views, wrapped around oracle query bodies as CTEs."""

from __future__ import annotations

from ..sources import fixtures as fx

_CTES = {
    "feedback_events": "SELECT " + ", ".join(fx.EVENTS_EXPRS) + " FROM events",
    "feedback_docs": "SELECT " + ", ".join(
        [e.format(ts0="TIMESTAMP '2024-01-01 00:00:00'") for e in fx.DOCS_EXPRS]
        + [fx.DOCS_RATING_EXPR] + fx.DOCS_HELPFUL_EXPRS)
        + " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "feedback_orders": "SELECT " + ", ".join(fx.ORDERS_EXPRS)
        + " FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"
        + " JOIN customer c ON o.o_custkey = c.c_custkey",
}


def with_views(body: str, *ctes: tuple[str, str]) -> str:
    """Prefix ``body`` with the fixture views it mentions plus extra (name, sql) CTEs."""
    parts = [f"{name} AS ({sql})" for name, sql in _CTES.items() if name in body
             or any(name in c[1] for c in ctes)]
    parts += [f"{name} AS ({sql})" for name, sql in ctes]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body

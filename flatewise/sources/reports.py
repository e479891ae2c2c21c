"""Reports rendered from small result tables: markdown, bars and a summary line. Rows come ordered and are few."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame


def _cell(value) -> str:
    return "-" if value is None else f"{value:.2f}" if isinstance(value, float) else str(value)


def _taken(rows: DataFrame, limit: int | None) -> list:
    """All rows, or the first ``limit`` where the caller asks for a limit."""
    return (rows if limit is None else rows.limit(limit)).collect()


def markdown(rows: DataFrame, order: list[str], limit: int | None = None) -> str:
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join(_cell(v) for v in r) + " |" for r in _taken(rows.orderBy(*order), limit)]
    return "\n".join(lines)


def html_table(rows: DataFrame, order: list[str], limit: int | None = None) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(v))}</td>" for v in r) + "</tr>" for r in _taken(rows.orderBy(*order), limit))
    return f"<table><tr>{head}</tr>{body}</table>"


def bars(rows: DataFrame, name: str, value: str, width: int = 40, limit: int | None = None) -> str:
    got = [(r[0], r[1] or 0) for r in _taken(rows.select(name, value).orderBy(name), limit)]
    top = max((v for _, v in got), default=0) or 1
    return "\n".join(f"{n!s:>16} {'#' * round(width * v / top):<{width}} {v:.2f}" for n, v in got)


def summary(tallied: DataFrame) -> str:
    r = tallied.first()
    return f"{'PASS' if r['all_passed'] else 'FAIL'}: {r['n_passed']} of {r['n_guards']} guards"

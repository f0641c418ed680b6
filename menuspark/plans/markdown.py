"""Reports as Markdown. Only bounded frames are collected: each is a top list or one row of totals."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 60


def _cell(value: object) -> str:
    if value is None:
        return "—"
    if isinstance(value, float):
        return f"{value:.3f}"
    return str(value).replace("|", "\\|").replace("\n", " ")


def percent(part: float, whole: float) -> str:
    return f"{100 * part / whole:.1f} %" if whole else "0.0 %"


def table(df: DataFrame, most: int = ROWS) -> str:
    rows = df.limit(most).collect()
    head = [f"| {' | '.join(df.columns)} |", f"|{'|'.join(' --- ' for _ in df.columns)}|"]
    return "\n".join(head + [f"| {' | '.join(map(_cell, r))} |" for r in rows]) if rows else "_none_"


def totals(df: DataFrame) -> str:
    row = df.first()
    return "\n".join(f"- {c.replace('_', ' ')}: {_cell(row[c])}" for c in df.columns)


def quality_report(summary: DataFrame, zero: DataFrame, fuzzy: DataFrame, matching: DataFrame, as_of: str) -> str:
    m = matching.first().asDict()
    whole = m.pop("impressions_7d")
    shares = "\n".join(f"- {k.removesuffix('_7d')}: {v} ({percent(v, whole)})" for k, v in m.items())
    return f"# Quality\n\nAs of {as_of}\n\n{totals(summary)}\n\n## Matching\n\n{shares}\n\n## Zero-result queries\n\n{table(zero)}\n\n## Fuzzy queries\n\n{table(fuzzy)}\n"


def demand_report(summary: DataFrame, queue: DataFrame, resolved: DataFrame, as_of: str) -> str:
    return f"# Demand\n\nAs of {as_of}\n\n{totals(summary)}\n\n## Review queue\n\n{table(queue)}\n\n## Resolved by the current index\n\n{table(resolved)}\n"

"""Markdown reports and status lines over small results: a table of a query, sections of a report, a file of it."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a table of a report shows at most; more are counted in a line below it.
SHOWN = 200


def table(df: DataFrame, shown: int = SHOWN) -> str:
    """A Markdown table of a result's first rows, in its order."""
    rows = df.limit(shown + 1).collect()
    cell = lambda v: "-" if v is None else (f"{v:.2f}" if isinstance(v, float) else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:shown]]
    return "\n".join(lines + ([f"\nMore rows than {shown} aren't shown."] if len(rows) > shown else []))


def report(title: str, sections: dict[str, DataFrame | str]) -> str:
    """A document of titled sections: tables of results, or text."""
    out = [f"# {title}", ""]
    for name, body in sections.items():
        out += [f"## {name}", "", table(body) if isinstance(body, DataFrame) else body, ""]
    return "\n".join(out)


def session_report(session: DataFrame, stages: DataFrame, alerts: DataFrame) -> str:
    return report("Session", {"Resources": session, "Stages": stages, "Alerts": alerts})


def run_report(metrics: DataFrame, resources: DataFrame) -> str:
    return report("Run", {"Metrics": metrics, "Resources": resources})


def roadmap_report(milestones: DataFrame, weeks: DataFrame, papers: DataFrame) -> str:
    return report("Reading roadmap", {"Milestones": milestones, "Weeks": weeks, "Papers": papers})


def hypothesis_card(one: DataFrame) -> str:
    """A card of one hypothesis: each column a line."""
    r = one.first()
    return "" if r is None else f"### {r[0]}\n\n" + "\n".join(f"- **{c}**: {r[c]}" for c in one.columns[1:])


def status(df: DataFrame) -> dict:
    """The one row of a status query, as a dict."""
    r = df.first()
    return {} if r is None else r.asDict(recursive=True)


def save(text: str, df: DataFrame, path: str) -> None:
    """Writes a report where the session's tables are, through the session."""
    df.sparkSession.createDataFrame([(text.removesuffix("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)

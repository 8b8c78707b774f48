"""Reports from the evaluation's small results: summary, retrieval and generation quality, failures, health, memo."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession

from .sinks import markdown

REPORTS = {
    "eval_summary": ("eval_summary",), "retrieval_quality": ("eval_summary", "route_distribution"), "failure_cases": ("weakest_cases", "failure_reasons"),
    "system_health": ("system_health", "graph_stats"), "community_reports": ("community_reports",),
}


def write_reports(spark: SparkSession, root: str, out: str, queries: dict, names: tuple[str, ...] = tuple(REPORTS)) -> list[str]:
    """Markdown and JSON of every report named; gives the paths. Reports already written are kept."""
    paths = []
    for name in names:
        md, js = Path(out, f"{name}.md"), Path(out, f"{name}.json")
        if not (md.exists() and js.exists() and md.stat().st_size and js.stat().st_size):
            parts = {q: queries[q](spark, root) for q in REPORTS[name]}
            md.parent.mkdir(parents=True, exist_ok=True)
            md.write_text("\n".join(markdown(df, q) for q, df in parts.items()))
            js.write_text(json.dumps({q: [r.asDict(True) for r in df.limit(1000).collect()] for q, df in parts.items()}, default=str, indent=2, sort_keys=True))
        paths += [str(md), str(js)]
    return paths


def decision_memo(spark: SparkSession, root: str, item: int, out: str, queries: dict) -> str:
    """A memo on one question: its answer, citations and the comparison of modes."""
    answer = queries["answers"](spark, root).where(f"item_id = {int(item)}")
    other = queries["compare_modes"](spark, root).where(f"item_id = {int(item)}")
    Path(out).parent.mkdir(parents=True, exist_ok=True)
    Path(out).write_text(markdown(answer, f"Decision memo for question {item}") + "\n" + markdown(other, "Vector only beside graph-aware"))
    return out

"""Command line: ``python -m lodestone.cli run NAME``, ``list``, ``ask``, ``compare``, ``report``, ``graph``, ``template``."""

from __future__ import annotations

import argparse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--root", default="/root/testdata/sf0.001", help="folder of the tables")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    run = sub.add_parser("run", help="run a query and show or write it")
    run.add_argument("name")
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    ask = sub.add_parser("ask", help="answer a question of the table")
    ask.add_argument("item", type=int)
    ask.add_argument("--mode", default="auto", choices=("auto", "vector", "local", "global", "drift", "hybrid"))
    comp = sub.add_parser("compare", help="vector only beside graph-aware")
    comp.add_argument("item", type=int)
    graph = sub.add_parser("graph", help="statistics, communities or an export of the graph")
    graph.add_argument("what", choices=("stats", "communities", "export", "load-plan", "structured-lookup"))
    temp = sub.add_parser("template", help="run a stored template")
    temp.add_argument("name")
    rep = sub.add_parser("report", help="write a report")
    rep.add_argument("name")
    rep.add_argument("--out", default="reports")
    return p


MODES = {"auto": "answers", "vector": "vector_only", "local": "local_search", "global": "global_search", "drift": "drift_search", "hybrid": "mmr_rerank"}
GRAPH = {"stats": "graph_stats", "communities": "community_reports", "export": "cypher_export", "load-plan": "load_batches", "structured-lookup": "structured_lookup"}


def main(argv: list[str] | None = None) -> int:
    from .plans import registry
    from .session import session, ship
    from .sources.reports import decision_memo, write_reports

    args = parser().parse_args(argv)
    known = registry.queries()
    if args.command == "list":
        print("\n".join(sorted(known)))
        return 0
    spark = session()
    ship(spark)
    if args.command == "report":
        print(write_reports(spark, args.root, args.out, known, (args.name,)) if args.name != "memo" else decision_memo(spark, args.root, 1, f"{args.out}/memo.md", known))
        return 0
    name = {"run": lambda: args.name, "ask": lambda: MODES[args.mode], "compare": lambda: "compare_modes", "graph": lambda: GRAPH[args.what], "template": lambda: f"template_{args.name}"}[args.command]()
    if name not in known:
        print(f"unknown query {name!r}; see list")
        return 2
    df = known[name](spark, args.root)
    if getattr(args, "item", None) is not None:
        df = df.where(f"item_id = {args.item}")
    if getattr(args, "out", None):
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

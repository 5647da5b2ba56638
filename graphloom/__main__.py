"""python -m graphloom VERB: create, info, schema, cypher, query, view, agent, over a stored graph or the table view."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from .ask import agent_prompt, ask, query_tool
from .docs import describe_schema
from .graph import Graph
from .kg import KnowledgeGraph, get_subgraph, list_subgraphs, load_profile
from .operators.export import console, graph_html
from .session import local_session
from .store import GraphStore
from .views import trade_graph


def graph_of(args: argparse.Namespace, spark) -> Graph:
    return trade_graph(spark, args.tables) if args.tables else GraphStore(spark, args.store)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("--store", help="folder of a stored graph")
    p.add_argument("--tables", help="folder of star-schema tables to view as a graph")
    p.add_argument("--import", dest="modules", action="append", default=[], help="a module that registers subgraphs")
    verbs = p.add_subparsers(dest="verb", required=True)
    create = verbs.add_parser("create", help="build a profile's graph")
    create.add_argument("profiles", help="JSON file of profiles")
    create.add_argument("name")
    create.add_argument("--root", default="kg_outputs")
    create.add_argument("--delete-first", action="store_true")
    create.add_argument("--html", action="store_true")
    verbs.add_parser("info", help="tables and their counts").add_argument("-g", "--group", action="append", help="only these labels and types")
    verbs.add_parser("schema", help="describe registered subgraphs").add_argument("subgraphs", nargs="*")
    verbs.add_parser("cypher", help="run a query").add_argument("text")
    verbs.add_parser("query", help="answer a question").add_argument("question")
    verbs.add_parser("view", help="write an HTML page").add_argument("output")
    verbs.add_parser("agent", help="answer queries read from standard input")
    args = p.parse_args(argv)
    for m in args.modules:
        importlib.import_module(m)
    if args.verb == "schema":
        print(describe_schema([get_subgraph(n).schema() for n in args.subgraphs or list_subgraphs()]))
        return 0
    spark = local_session()
    if args.verb == "create":
        result = KnowledgeGraph(spark, args.root, load_profile(args.profiles, args.name)).build(args.delete_first, args.html)
        print(json.dumps({"path": result.path, **vars(result.statistics), "warnings": result.warnings, "html": result.html}, indent=1))
        return 0
    graph = graph_of(args, spark)
    if args.verb == "info":
        counts = graph.counts(args.group, args.group)
        print(console(counts.orderBy("type", "name"), 1000))
    elif args.verb == "cypher":
        print(console(graph.cypher(args.text)))
    elif args.verb == "query":
        print(console(ask(graph, args.question)))
    elif args.verb == "view":
        with open(args.output, "w") as f:
            f.write(graph_html(graph))
    elif args.verb == "agent":
        print(agent_prompt("\n".join(f"- {n}" for n in graph.nodes)))
        run = query_tool(graph)
        for line in sys.stdin:
            print(run(line))
    return 0


if __name__ == "__main__":
    sys.exit(main())

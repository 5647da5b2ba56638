"""Graphs and results for people and other tools: node-link JSON, an HTML page, Markdown, CSV and console tables."""

from __future__ import annotations

import hashlib
import html
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import DST, HIDDEN, ID, LABEL, SRC, Graph, global_id

#: Where a node's display name comes from, and hidden fields that are shown all the same.
NAME_FIELDS = ("name", "title", "description", "label", "_original_name", "id")
SHOWN = ("_created_at", "_updated_at", "_original_name")


def display_name(df: DataFrame, label: Column | str, columns: list[str] | None = None, longest: int = 30) -> Column:
    """The first of the usual name fields that holds text, then the first text field that does, then the label; long
    ones are cut."""
    columns = columns if columns is not None else df.columns
    texts = [f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, T.StringType) and not f.name.startswith("_")]
    order = list(dict.fromkeys([c for c in NAME_FIELDS if c in columns] + texts))
    filled = [F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))) for c in order]
    name = F.coalesce(*filled, F.lit(label) if isinstance(label, str) else label)
    return F.when(F.length(name) > longest, F.concat(F.substring(name, 1, longest), F.lit("..."))).otherwise(name)


def label_colour(label: str) -> str:
    """A colour from the label's MD5, no channel darker than 100 (a fixed value)."""
    channels = (int(hashlib.md5(label.encode()).hexdigest()[i : i + 2], 16) for i in (0, 2, 4))
    return "#" + "".join(f"{c + 100 if c < 100 else c:02x}" for c in channels)


def shown_properties(columns: list[str]) -> list[str]:
    return [c for c in columns if (not c.startswith("_") or c in SHOWN) and c not in HIDDEN]


def text_property(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    value = F.to_json(F.col(name)) if isinstance(kind, T.StructType | T.MapType | T.ArrayType) else F.col(name).cast("string")
    return F.trim(value)


def graph_nodes(graph: Graph, labels: list[str] | None = None) -> DataFrame:
    """id, label, name and properties (a map of texts) of every node."""
    out: DataFrame | None = None
    for label, t in graph.nodes.items():
        if labels is not None and label not in labels:
            continue
        pairs = [x for p in shown_properties(t.properties) for x in (F.lit(p), text_property(t.df, p))]
        props = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
        one = t.df.select(global_id(label, F.col(ID)).alias("id"), F.lit(label).alias("label"), display_name(t.df, label, t.properties).alias("name"), props.alias("properties"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else graph.spark.createDataFrame([], "id string, label string, name string, properties map<string,string>")


def graph_links(graph: Graph, types: list[str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """source, target, type and properties of every edge; with nodes only between these."""
    out: DataFrame | None = None
    for e in graph.edges:
        if types is not None and e.name not in types:
            continue
        pairs = [x for p in e.properties for x in (F.lit(p), text_property(e.df, p))]
        props = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
        one = e.df.select(global_id(e.source, F.col(SRC)).alias("source"), global_id(e.target, F.col(DST)).alias("target"), F.lit(e.name).alias("type"), props.alias("properties"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return graph.spark.createDataFrame([], "source string, target string, type string, properties map<string,string>")
    if nodes is not None:
        ids = nodes.select("id")
        out = out.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return out


def merged_links(links: DataFrame) -> DataFrame:
    """One link for each (source, target, type): its weight is the number of edges."""
    return links.groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("weight"))


def link_weight(properties: dict[str, str]) -> tuple[float, dict[str, float]]:
    """(weight, weights by name) of a link's properties: "weight", "weights" as a JSON object, "weight_...". The weight is
    "weight", or the first of "weights"; 1 if there is neither."""
    found: dict[str, float] = {}

    def take(name: str, value: Any) -> None:
        try:
            found[name] = float(value)
        except (TypeError, ValueError):
            pass

    if "weight" in properties:
        take("default", properties["weight"])
    try:
        several = json.loads(properties.get("weights") or "{}")
    except ValueError:
        several = {}
    for k, v in several.items() if isinstance(several, dict) else ():
        take(str(k), v)
    first = next(iter(found.values()), 1.0)
    for k, v in properties.items():
        if k.startswith("weight_"):
            take(k.removeprefix("weight_"), v)
    return first, found


def rows_of(df: DataFrame, limit: int | None) -> list:
    return (df if limit is None else df.limit(limit)).collect()


def result_entities(df: DataFrame, limit: int | None = None) -> tuple[list[dict], list[dict]]:
    """Nodes and links among a result's values: structs with _id and _label are nodes, with _src and _dst links; links
    to nodes that the result lacks go. All rows are looked at, or the first ``limit``."""
    nodes: dict[str, dict] = {}
    links: list[dict] = []

    def visit(v: Any) -> None:
        if isinstance(v, dict):
            if SRC in v and DST in v and LABEL in v:
                links.append({"source": v[SRC], "target": v[DST], "type": v[LABEL], "properties": {k: str(x).strip() for k, x in v.items() if k not in HIDDEN and x is not None}})
            elif ID in v and LABEL in v:
                props = {k: str(x).strip() for k, x in v.items() if k in shown_properties(list(v)) and x is not None}
                name = next((props[k] for k in NAME_FIELDS if props.get(k)), next((x for x in props.values() if x), v[LABEL]))
                nodes.setdefault(v[ID], {"id": v[ID], "label": v[LABEL], "name": name if len(name) <= 30 else name[:30] + "...", "properties": props})
            for x in v.values():
                visit(x)
        elif isinstance(v, list | tuple):
            for x in v:
                visit(x)

    for row in rows_of(df, limit):
        visit(row.asDict(recursive=True))
    return list(nodes.values()), [x for x in links if x["source"] in nodes and x["target"] in nodes]


PAGE = """<!doctype html>
<html><head><meta charset="utf-8"><title>{title}</title><style>
body {{ font: 14px sans-serif; margin: 0 }} svg {{ width: 100vw; height: 92vh }} text {{ font-size: 10px; pointer-events: none }} #info {{ padding: 4px 10px; height: 6vh; overflow: auto }}
</style></head><body><div id="info">{title}: {counts}</div><svg></svg><script>
const graph = {data};
const svg = document.querySelector("svg"), ns = "http://www.w3.org/2000/svg", W = innerWidth, H = innerHeight * 0.92;
const at = new Map(graph.nodes.map((n, i) => [n.id, Object.assign(n, {{x: W / 2 + 300 * Math.cos(i), y: H / 2 + 300 * Math.sin(i * 1.7)}})]));
const make = (kind, attributes) => {{ const e = document.createElementNS(ns, kind); for (const k in attributes) e.setAttribute(k, attributes[k]); svg.appendChild(e); return e; }};
const lines = graph.links.map(l => [l, make("line", {{stroke: "#999", "stroke-width": Math.min(6, l.weight || 1)}})]);
const dots = graph.nodes.map(n => {{ const e = make("circle", {{r: 8, fill: graph.colours[n.label]}}); e.onclick = () => {{ document.getElementById("info").textContent = n.label + " " + JSON.stringify(n.properties); }}; const t = make("text", {{}}); t.textContent = n.name; return [n, e, t]; }});
function step(k) {{
  for (const a of graph.nodes) {{ let fx = (W / 2 - a.x) * 0.01, fy = (H / 2 - a.y) * 0.01; for (const b of graph.nodes) if (a !== b) {{ const dx = a.x - b.x, dy = a.y - b.y, d = dx * dx + dy * dy + 1; fx += 900 * dx / d; fy += 900 * dy / d; }} a.fx = fx; a.fy = fy; }}
  for (const l of graph.links) {{ const a = at.get(l.source), b = at.get(l.target), dx = (b.x - a.x) * 0.02, dy = (b.y - a.y) * 0.02; a.fx += dx; a.fy += dy; b.fx -= dx; b.fy -= dy; }}
  for (const n of graph.nodes) {{ n.x += n.fx * k; n.y += n.fy * k; }}
  for (const [l, e] of lines) {{ const a = at.get(l.source), b = at.get(l.target); for (const [k, v] of [["x1", a.x], ["y1", a.y], ["x2", b.x], ["y2", b.y]]) e.setAttribute(k, v); }}
  for (const [n, e, t] of dots) {{ e.setAttribute("cx", n.x); e.setAttribute("cy", n.y); t.setAttribute("x", n.x + 10); t.setAttribute("y", n.y + 3); }}
}}
let n = 0; (function run() {{ step(Math.max(0.1, 1 - n / 200)); if (n++ < 300) requestAnimationFrame(run); }})();
</script></body></html>
"""


def html_page(nodes: list[dict], links: list[dict], title: str = "Graph", total: tuple[int, int] | None = None) -> str:
    """A page of its own, without outside scripts, that draws nodes and links; total: how many there are, if more."""
    of = [f" of {n}" if total and n > len(x) else "" for n, x in zip(total or (0, 0), (nodes, links))]
    links = [x | {"weight": link_weight(x.get("properties") or {})[0]} for x in links]
    data = json.dumps({"nodes": nodes, "links": links, "colours": {n["label"]: label_colour(n["label"]) for n in nodes}}, ensure_ascii=False).replace("</", "<\\/")
    return PAGE.format(title=html.escape(title), counts=f"{len(nodes)}{of[0]} nodes, {len(links)}{of[1]} links", data=data)


class TooLarge(ValueError):
    """More nodes or links than one document should hold."""


def drawn(graph: Graph, labels: list[str] | None, types: list[str] | None, limit: int | None, most: int) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """Nodes and links to write into one document, and how many there are in all. Without a limit these are all; a
    graph of over ``most`` nodes or links is refused."""
    nodes, links = graph_nodes(graph, labels), graph_links(graph, types)
    total = nodes.count(), links.count()
    if limit is None and max(total) > most:
        raise TooLarge(f"the graph has {total[0]} nodes and {total[1]} links, one document holds {most}; set a limit, or write_graph writes all as files")
    if limit is not None:
        nodes = nodes.orderBy("id").limit(limit)
    return nodes, graph_links(graph, types, nodes), total


def graph_html(graph: Graph, title: str = "Graph", labels: list[str] | None = None, types: list[str] | None = None, limit: int | None = None, most: int = 200_000) -> str:
    """The whole graph as a page, or with a limit its first nodes by id, which the page says; edges to nodes that are not
    drawn go. See drawn for graphs that are too large."""
    nodes, links, total = drawn(graph, labels, types, limit, most)
    return html_page([r.asDict(recursive=True) for r in nodes.collect()], [r.asDict(recursive=True) for r in links.collect()], title, total)


def write_graph(graph: Graph, path: str, labels: list[str] | None = None, types: list[str] | None = None) -> None:
    """All nodes and links as JSON lines below path, in nodes and links, written by the tasks that read them."""
    graph_nodes(graph, labels).write.mode("overwrite").json(f"{path}/nodes")
    graph_links(graph, types).write.mode("overwrite").json(f"{path}/links")


def result_html(df: DataFrame, title: str = "Result", limit: int | None = None) -> str:
    """A result's nodes and links as a page: of all rows, or of the first ``limit``."""
    return html_page(*result_entities(df, limit), title)


def cytoscape_edges(graph: Graph, excluded: tuple[str, ...] = ("text_chunk",)) -> DataFrame:
    """id ("a-label-b"), source, target and label of edges whose ends are of no excluded label."""
    links = graph_links(graph)
    kept = ~F.substring_index("source", ":", 1).isin(*excluded) & ~F.substring_index("target", ":", 1).isin(*excluded)
    return links.filter(kept).select(F.concat_ws("-", "source", "type", "target").alias("id"), "source", "target", F.col("type").alias("label"))


def cytoscape_json(graph: Graph, limit: int | None = None, excluded: tuple[str, ...] = ("text_chunk",), most: int = 200_000) -> str:
    """All nodes and edges as elements, but for excluded labels, or with a limit the first nodes by id and the edges
    between them. See drawn for graphs that are too large."""
    nodes, _, _ = drawn(graph, [x for x in graph.nodes if x not in excluded], None, limit, most)
    ids = nodes.select("id")
    edges = cytoscape_edges(graph, excluded).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    elements = [{"data": {"id": r["id"], "label": r["label"], "name": r["name"], **(r["properties"] or {})}} for r in nodes.collect()]
    elements += [{"data": {"id": r["id"], "source": r["source"], "target": r["target"], "label": r["label"]}} for r in edges.collect()]
    return json.dumps(elements, ensure_ascii=False)


def markdown(df: DataFrame, limit: int = 30) -> str:
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def console(df: DataFrame, limit: int = 20) -> str:
    """The first rows as aligned text, and dots if there are more."""
    rows = df.limit(limit + 1).collect()
    cells = [df.columns, *[["" if v is None else str(v) for v in r] for r in rows[:limit]]] + ([["..."] * len(df.columns)] if len(rows) > limit else [])
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in cells)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)

"""Questions in plain language: a translator turns them into queries, which run read-only."""

from __future__ import annotations

import json
import re
from typing import Protocol

from pyspark.sql import DataFrame

from .graph import Graph
from .operators.export import markdown
from .plans.parser import Project, parse

RULES = """Answer with one read-only query that begins with MATCH and ends with RETURN.
Use only the labels, relationship types and properties above, with their given directions.
Compare texts with toLower(...) CONTAINS ...; compare dates with date(...).
Reach into structs with dots; properties of relationships belong to the relationship's variable.
Use no path of more than {hops} steps; join alternatives with UNION; return properties rather than whole nodes, distinct ones, and at most {limit} rows."""


class Translator(Protocol):
    """Turns a prompt (schema, rules, question) and the question into a query."""

    def __call__(self, prompt: str, question: str) -> str: ...


def prompt_for(description: str, question: str, limit: int = 30, hops: int = 4) -> str:
    return f"{description}\n{RULES.format(limit=limit, hops=hops)}\n\nQuestion: {question}\n"


STRUCTURED = """<SYNTAX>
{rules}
Names of variables are short and alphanumeric. There are no procedures beside CALL show_tables() and table_info(...).
</SYNTAX>
<RETURN_RESULTS>
Whole numbers stay whole numbers; types are not forced; no keyword of the query language is returned.
</RETURN_RESULTS>
<QUESTION>
{question}
</QUESTION>
<SCHEMA>
{description}
</SCHEMA>
<OUTPUT_FORMAT>
Answer with one JSON object: {{"cypher": "the query, without line breaks"}}
</OUTPUT_FORMAT>
"""


def structured_prompt(description: str, question: str, limit: int = 30, hops: int = 4) -> str:
    """A prompt in marked sections whose answer is a JSON object with one field, cypher."""
    return STRUCTURED.format(rules=RULES.format(limit=limit, hops=hops), question=question, description=description)


def structured_query(text: str) -> str:
    """The query in the answer to a structured prompt; ValueError if there is none."""
    if m := re.search(r"\{.*\}", text, re.S):
        try:
            query = json.loads(m[0], strict=False).get("cypher")
        except ValueError:
            query = None
        if isinstance(query, str) and query.strip():
            return " ".join(query.split("\n")).strip().rstrip(";")
    raise ValueError(f"no JSON object with a query in {text!r}")


def bare_query(text: str) -> str:
    """The query in a translator's answer: what a fence holds, or else from MATCH on."""
    if m := re.search(r"```(?:\w+)?\s*(.*?)```", text, re.S):
        text = m[1]
    m = re.search(r"\b(optional\s+match|match|call)\b.*", text, re.S | re.I)
    return (m[0] if m else text).strip().rstrip(";")


class TemplateTranslator:
    """Works without a model: "how many X", "list X", "X by Y", with the graph's own labels and types."""

    def __init__(self, graph: Graph):
        self.graph = graph

    def __call__(self, prompt: str, question: str) -> str:
        q = question.lower()
        named = [x for x in self.graph.nodes if re.search(rf"\b{re.escape(x.lower())}(s|es)?\b", q) or (x.lower().endswith("y") and x.lower()[:-1] + "ies" in q)]
        if not named:
            raise ValueError(f"can't translate {question!r}: it names no label")
        named.sort(key=lambda x: q.find(x.lower()[:-1]))
        label = named[0]
        if re.search(r"\bhow many\b|\bcount\b|\bnumber of\b", q):
            if len(named) > 1:
                other = named[1]
                for e in self.graph.edges:
                    if {e.source, e.target} == {label, other}:
                        return f"MATCH (a:`{label}`)-[:`{e.name}`]-(b:`{other}`) RETURN b.name AS {other.lower()}, count(a) AS n ORDER BY n DESC"
            return f"MATCH (n:`{label}`) RETURN count(n) AS n"
        return f"MATCH (n:`{label}`) RETURN DISTINCT n.name AS name ORDER BY name"


def limited(query: str, limit: int) -> str:
    """A query with a limit, unless its last RETURN has one; the parts of a UNION are limited together, by ask."""
    parts = parse(query).parts
    last = parts[-1][-1]
    return f"{query} LIMIT {limit}" if isinstance(last, Project) and last.limit is None and len(parts) == 1 else query


def ask(graph: Graph, question: str, translator: Translator | None = None, description: str = "", limit: int = 30, structured: bool = False) -> DataFrame:
    """Rows that answer a question. What goes wrong is raised with the query that was tried. structured: the translator
    gets a structured prompt and answers with a JSON object."""
    translate = translator or TemplateTranslator(graph)
    answer = translate((structured_prompt if structured else prompt_for)(description, question, limit), question)
    query = structured_query(answer) if structured else bare_query(answer)
    try:
        found = graph.cypher(limited(query, limit), read_only=True)
        return found.limit(limit) if len(parse(query).parts) > 1 else found
    except Exception as e:
        raise RuntimeError(f"the query failed: {e}\n{query}") from e


def query_tool(graph: Graph, limit: int = 30):
    """A function for agents: a query's rows as Markdown, or what went wrong as text. Changes are refused."""

    def run(query: str) -> str:
        try:
            return markdown(graph.cypher(bare_query(query), read_only=True), limit)
        except Exception as e:
            return f"Error: {e}"

    return run


def agent_prompt(description: str, single_tool: bool = True) -> str:
    how = "You have one tool, which runs a query and gives a table." if single_tool else "You have several tools; one runs a query and gives a table."
    return f"You answer questions about a knowledge graph. {how} Look things up before you answer, and say so if the graph lacks the answer.\n\n{description}\n{RULES.format(limit=30, hops=4)}\n"

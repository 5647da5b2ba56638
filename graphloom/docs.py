"""Descriptions of a schema for people and language models, from specs and from schema-language text."""

from __future__ import annotations

import enum
import re
from dataclasses import dataclass, field

from .schema import EdgeSpec, GraphSchema, is_edge_property
from .types import element, human_name, model_fields


@dataclass
class FieldText:
    name: str
    type: str
    description: str = ""


@dataclass
class TypeText:
    """A class or enum of a schema-language text."""

    name: str
    kind: str
    description: str = ""
    fields: dict[str, FieldText] = field(default_factory=dict)
    values: dict[str, str] = field(default_factory=dict)


def parse_schema_text(text: str) -> dict[str, TypeText]:
    """class and enum blocks with @description("...") or @description(#"..."#), of one line or several, and comments."""
    out: dict[str, TypeText] = {}
    text = re.sub(r"(?m)^\s*//(?!/).*$", "", text)
    at = 0
    while m := re.compile(r"\b(class|enum)\s+(\w+)\s*\{").search(text, at):
        depth, end = 1, m.end()
        quoted = ""
        while depth and end < len(text):
            if quoted:
                if text.startswith(quoted, end):
                    end += len(quoted)
                    quoted = ""
                    continue
            elif text.startswith('#"', end):
                quoted = '"#'
                end += 2
                continue
            elif text[end] == '"':
                quoted = '"'
            elif text[end] in "{}":
                depth += 1 if text[end] == "{" else -1
            end += 1
        body = text[m.end() : end - 1]
        one = out[m[2]] = TypeText(m[2], m[1])
        notes: dict[int, str] = {}

        def note(found: re.Match) -> str:
            notes[len(notes)] = " ".join((found[2] if found[2] is not None else found[3] or "").split())
            return f" {'@@' if found[1] == '@@' else '@'}note{len(notes) - 1} "

        flat = re.sub(r'(@@|@)description\(\s*(?:#"(.*?)"#|"((?:[^"\\]|\\.)*)")\s*\)', note, body, flags=re.S)
        last: FieldText | str | None = None
        for line in flat.splitlines():
            line = line.strip()
            if not line:
                continue
            if whole := re.match(r"@@note(\d+)", line):
                one.description = notes[int(whole[1])]
                continue
            if line.startswith("@"):
                found, name = re.search(r"@note(\d+)", line), None
            else:
                name = re.match(r"\w+", line)
                found = re.search(r"@note(\d+)", line)
            if name:
                if one.kind == "class":
                    kind = re.sub(r"@.*", "", line[name.end() :]).strip()
                    last = one.fields[name[0]] = FieldText(name[0], kind)
                else:
                    last = name[0]
                    one.values[name[0]] = ""
            if found and last is not None:
                if isinstance(last, FieldText):
                    last.description = notes[int(found[1])]
                else:
                    one.values[last] = notes[int(found[1])]
        at = end
    return out


def edge_property_docs(target: type, texts: dict[str, TypeText]) -> list[tuple[str, str, str]]:
    """(name on the edge, type, description) of a target's p_..._ fields."""
    known = texts.get(target.__name__)
    return [(f[2:-1], human_name(a), known.fields[f].description if known and f in known.fields else "") for f, a in model_fields(target).items() if is_edge_property(f)]


def _fields(kind: type, schema: GraphSchema, skipped: set[str], embedded: tuple[type, ...], texts: dict[str, TypeText], prefix: str = "") -> list[str]:
    lines = []
    known = texts.get(kind.__name__)
    for name, annotation in model_fields(kind).items():
        if name in skipped or is_edge_property(name):
            continue
        inner, many = element(annotation)
        if inner in embedded and not many:
            lines += _fields(inner, schema, set(), (), texts, f"{prefix}{name}.")
            continue
        note = known.fields[name].description if known and name in known.fields else ""
        lines.append(f"  - {prefix}{name}: {human_name(annotation)}" + (f" - {note}" if note else ""))
    return lines


def enums_of(schema: GraphSchema) -> list[type]:
    found: dict[type, None] = {}
    for n in schema.nodes:
        for kind in (n.node_class, *n.embedded):
            for annotation in model_fields(kind).values():
                inner, _ = element(annotation)
                if isinstance(inner, type) and issubclass(inner, enum.Enum):
                    found[inner] = None
    return list(found)


def describe_schema(schemas: GraphSchema | list[GraphSchema], schema_text: str = "", print_enums: bool = True) -> str:
    """Markdown: node labels with their fields (structs with dots), edge types with their properties, enums."""
    many = schemas if isinstance(schemas, list) else [schemas]
    texts = parse_schema_text(schema_text)
    lines, seen = ["# Graph schema", "", "## Nodes"], set()
    for s in many:
        for n in s.nodes:
            if n.label in seen:
                continue
            seen.add(n.label)
            note = n.description or (texts[n.label].description if n.label in texts else "")
            lines += ["", f"### {n.label}" + (f": {note}" if note else ""), "  - id: string", "  - name: string"]
            lines += _fields(n.node_class, s, s.excluded[n.label] | {"id", "name"}, n.embedded, texts)
            lines += [f"  - {x.name}.{f.name}: {f.dataType.simpleString()}" for x in n.extra for f in x.type.fields]
    lines += ["", "## Relationships", ""]
    met: set[tuple[str, str, str]] = set()
    for s in many:
        for e in s.edges:
            if e.key not in met:
                met.add(e.key)
                lines += edge_lines(e, texts)
    enums = {x.__name__: x for s in many for x in enums_of(s)}
    if print_enums and enums:
        lines += ["", "## Enumerations", ""] + [f"- {name}: {', '.join(m.name for m in kind)}" for name, kind in enums.items()]
    return "\n".join(lines) + "\n"


def edge_lines(e: EdgeSpec, texts: dict[str, TypeText]) -> list[str]:
    lines = [f"- ({e.from_class.__name__})-[:{e.name}]->({e.to_class.__name__})" + (f" - {e.description}" if e.description else "")]
    return lines + [f"  - {n}: {t}" + (f" - {d}" if d else "") for n, t, d in edge_property_docs(e.to_class, texts)]

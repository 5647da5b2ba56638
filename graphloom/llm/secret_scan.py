"""Secret scans: an Aho-Corasick pass over each text finds keywords, and only where one is found an anchored regular
expression is tried; matches that embed a checksum must satisfy it.

Kinds, as listed in KINDS: ``assign`` (a secret's name, a sign and a value), ``access`` (access key ids), ``hex``
(long hexadecimal runs), and, beyond these, ``forge`` (code-forge tokens) and ``package`` (package-registry tokens),
whose last six characters are the CRC-32 of the body before them in base 62.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, map_rows, text_slices

#: Patterns of each kind, and the least length of group 2, of the match or of the run.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
FORGE = r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"
PACKAGE = r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "forge", "package")
BASE_KINDS = KINDS[:3]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: What must stand where a match of a kind begins. A hexadecimal run of 24 begins with four such characters.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("AKIA",),
    "hex": tuple(map("".join, product("0123456789abcdef", repeat=4))),
    "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "package": ("npm_",),
}


def checksum_holds(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of the thirty before them."""
    value, digits = zlib.crc32(token[-36:-6].encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return token[-6:] == digits.rjust(6, "0")


@lru_cache(maxsize=1)
def scanner():
    """The automaton over all keywords (names of secrets in every mix of cases) and each kind's pattern."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            for w in map("".join, product(*({c, c.swapcase()} for c in word))) if kind == "assign" else (word,):
                found.add_word(w, (kind, len(w)))
    found.make_automaton()
    patterns = {"assign": re.compile(ASSIGN, re.I | re.A), "access": re.compile(ACCESS), "hex": re.compile(HEX), "forge": re.compile(FORGE), "package": re.compile(PACKAGE)}
    return found, patterns


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind as listed. Of each kind these are the
    leftmost non-overlapping matches, without those that are too short or whose checksum fails."""
    if not text:
        return []
    automaton, patterns = scanner()
    at: dict[str, list[int]] = {}
    for end, (kind, size) in automaton.iter(text):
        at.setdefault(kind, []).append(end - size + 1)
    out = []
    for kind, starts in at.items():
        over, match = 0, patterns[kind].match
        for start in sorted(starts):
            if start >= over and (m := match(text, start)):
                over = m.end()
                if kind in LEAST:
                    ok = len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]
                else:
                    ok = checksum_holds(m[0])
                if ok:
                    out.append((kind, start, over))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the secrets of every whole text.

    docs needs doc_id and text; other columns are ignored. A null or empty text has none; every row gives a row, repeated
    ones and those without a doc_id too; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_secrets(t) for t in each_text(batch.column("text"))]
            base = [[s for s in spans if s[0] in BASE_KINDS] for spans in found]
            counts = {f"n_{k}": pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE_KINDS}
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), **counts,
                "base_sha256": pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()),
                "spans": pa.array([joined(s) for s in found], pa.string()),
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span's characters replaced by [kind]; of overlapping spans the first one's kind counts."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with secrets in text replaced; n_chars, if there and not null, follows the text.

    docs needs text. Null and empty texts stay as they are; repeated rows are changed alike; an empty table gives no rows."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch.column(place)):
                clean = [t if t is None or not (s := find_secrets(t)) else redact(t, s) for t in texts]
                yield batch.slice(at, len(texts)).set_column(place, batch.schema.field(place), pa.array(clean, batch.schema.field(place).type))

    out = map_rows(docs, run)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out

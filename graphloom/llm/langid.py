"""Language identification by rank-order profiles.

A language's profile is the order of its most frequent character n-grams; a document's is the same of its own text. The
out-of-place distance sums, over the document's n-grams, how far their ranks lie apart (n-grams that the language's
profile lacks count as the profile's length); the nearest language is the answer.

N-grams of one to three characters are counted within words, a word being a run of letters with a blank on either side.
An n-gram is an integer, 21 bits a character, and its numeric order breaks ties of frequency; a text's n-grams are
counted by sorting them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each_text, map_rows, quoted, text_slices, unused

UNKNOWN = "und"
BLANK = 32
PART = 1 << 20
Profiles = dict[str, np.ndarray]


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def letter_codes(text: str) -> np.ndarray:
    """Code points of a text in lower case, whatever is no letter a blank, with a blank at either end."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(letters()[codes], codes, BLANK).astype(np.int64)


def count_keys(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs, or the sum of its times."""
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(np.concatenate([first, [len(keys)]])) if times is None else np.add.reduceat(times, first) if len(first) else times


def gram_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams around every letter and their counts: itself, with either neighbour, with both."""
    found = []
    for a in range(0, len(codes), PART):
        part = codes[a : a + PART + 2]  # two more, so that every triple lies in one part
        letter = part != BLANK
        last = a + PART + 2 >= len(codes)
        n = len(part) if last else PART
        pairs = (part[:-1] << 21) | part[1:]
        found.append(count_keys(np.concatenate([part[:n][letter[:n]], pairs[:n][(letter[:-1] | letter[1:])[:n]], ((pairs[:-1] << 21) | part[2:])[:n][letter[1:-1][:n]]])))
        if last:
            break
    return found[0] if len(found) == 1 else count_keys(*(np.concatenate(x) for x in zip(*found)))


def ranked(codes: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams, first the most frequent, of equals the smaller."""
    keys, n = gram_counts(codes)
    return keys[np.argsort(-n, kind="stable")[:length]]


def train(docs: DataFrame, held: Column, length: int = 400) -> Profiles:
    """Each language's profile over all rows with text and lang of which held is false. The driver gets ``length``
    n-grams a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at, texts in text_slices(batch.column("text")):
                by: dict[str, list[str]] = {}
                for lang, text in zip(batch.column("lang").slice(at, len(texts)).to_pylist(), texts):
                    by.setdefault(lang, []).append(text)
                for lang, some in by.items():
                    parts = [gram_counts(letter_codes(" ".join(some)))] + ([totals[lang]] if lang in totals else [])
                    totals[lang] = count_keys(*(np.concatenate(x) for x in zip(*parts)))
                if sum(len(k) for k, _ in totals.values()) > 500_000:
                    yield from out(totals)
                    totals.clear()
        yield from out(totals)

    def out(totals: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, (keys, n) in totals.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "gram": pa.array(keys), "n": pa.array(n.astype(np.int64))})

    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held).select("text", "lang")
    totals = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= length)
    found: dict[str, list[tuple[int, int]]] = {}
    for lang, r, gram in top.select("lang", "r", "gram").collect():
        found.setdefault(lang, []).append((r, gram))
    return {lang: np.array([g for _, g in sorted(found[lang])], dtype=np.int64) for lang in sorted(found)}


class Judge:
    """Tells a text's language and how clearly: the share of the largest possible distance by which it stays below it."""

    def __init__(self, profiles: Profiles, length: int):
        self.langs, self.length = list(profiles), length
        self.keys, self.ranks = [], []
        for p in profiles.values():
            order = np.argsort(p)
            self.keys.append(p[order])
            self.ranks.append(order)

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes = letter_codes(text) if text else np.zeros(0, dtype=np.int64)
        if not self.langs or not (codes != BLANK).any():
            return UNKNOWN, 0.0
        own = ranked(codes, self.length)
        place = np.arange(len(own))
        best, least = UNKNOWN, None
        for lang, keys, ranks in zip(self.langs, self.keys, self.ranks):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            apart = np.where(keys[at] == own, np.minimum(np.abs(ranks[at] - place), self.length), self.length)
            total = int(apart.sum())
            if least is None or total < least:
                best, least = lang, total
        return best, 1 - least / (self.length * len(own))


def judge_rows(docs: DataFrame, profiles: Profiles, length: int = 400, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs, all rows and columns, with the language and its score behind them."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # bounded: length n-grams a language
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value, length)
        for batch in batches:
            found = [judge(t) for t in each_text(batch.column(place))]
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[f"c{i}" for i in range(batch.num_columns + 2)])

    return map_rows(docs, run, [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 2 when divided by 4; false without one."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify_languages(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns from text and lang of the rows that are not held out; predicts from
    text alone.

    docs needs doc_id, text and lang; other columns are ignored. A null text, or one without a letter, is ``und`` with
    score 0, as is any if there is nothing to learn from; of languages equally near the first by name is taken; every
    row gives a row; an empty table gives none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    profiles = train(rows, held_out(F.col("doc_id")), length)
    return judge_rows(rows.select("doc_id", "text"), profiles, length).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.32, length: int = 400) -> DataFrame:
    """docs, all columns, without the rows that are ``und`` or as far from every language as texts in none are.

    docs needs doc_id, text and lang, and learns from its own rows as identify_languages does. Null texts and those
    without a letter go; repeated rows stay or go together; an empty table, or one with nothing to learn from, gives no
    rows.

    On the sf0.1 documents whole texts score 0.43 or more and one to three of their words 0.33 or more; random letters
    score up to 0.28 from fifteen words on, but single short words of them cannot be told from a language's. An
    unlearned language near a learned one can stay."""
    profiles = train(docs, held_out(F.col("doc_id")), length)
    lang, score = unused(docs.columns, "_lang"), unused(docs.columns, "_score")
    judged = judge_rows(docs, profiles, length, (lang, score))
    return judged.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least_score)).select(*quoted(docs.columns))

"""Operators on single texts against plain versions of the same rules."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from graphloom.llm import langid, mixing, quality, queries, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_secret_scan_equals_regular_expressions(spark, small, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op6_secret_scan"](spark, small).collect()}
    patterns = {"assign": re.compile(secret_scan.ASSIGN, re.I | re.A), "access": re.compile(secret_scan.ACCESS), "hex": re.compile(secret_scan.HEX)}
    assert len(got) == len(documents)
    for doc_id, text, *_ in documents:
        spans = [(k, *m.span()) for k, p in patterns.items() for m in p.finditer(text or "") if len(m[2] if k == "assign" else m[0]) >= secret_scan.LEAST[k]]
        spans.sort(key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
        r = got[doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in patterns)
        assert r.base_sha256 == hashlib.sha256(secret_scan.joined(spans).encode()).hexdigest()


def test_secret_scan_cases():
    find = secret_scan.find_secrets
    assert find(None) == find("") == []
    assert find("PassWord = abc123") == [("assign", 0, 17)]
    assert find("password: abc12") == []  # five characters
    assert find("toKen=abcdef") == []  # the Kelvin sign is no k
    assert find("AKIA" + "A" * 15) == [] and find("AKIA" + "A" * 16) == [("access", 0, 20)]
    assert find("x" + "a1" * 12 + "z") == [("hex", 1, 25)] and find("a1" * 11 + "a") == []
    assert find("token=token=abcdef") == [("assign", 0, 18)]
    body = "a" * 30
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = secret_scan.BASE62[d] + digits
    good = "ghp_" + body + digits.rjust(6, "0")
    assert ("forge", 3, 43) in find("é " + " " + good) and not [s for s in find(good[:-1] + ("0" if good[-1] != "0" else "1")) if s[0] == "forge"]
    assert secret_scan.redact("a password=abcdef b", find("a password=abcdef b")) == "a [assign] b"


def test_quality_statistics(spark, small, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op9_quality"](spark, small).collect()}
    for doc_id, text, *_ in documents:
        text = text or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_quality_model_on_held_out_rows(spark):
    """The labels' odd doc_ids are held out of training; most of their good rows stay and most bad ones go."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    judged = quality.judge_quality(docs, labels.filter("doc_id % 2 = 0"))
    rows = judged.join(labels.filter("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").filter("not base_failed").select("kept", "quality").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.5, (np.mean(good), np.mean(bad), len(bad))


def test_languages_of_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op5_language_id"](spark, d).collect()}
    truth = duckdb.sql(f"select doc_id, lang, text from '{d}/documents.parquet'").fetchall()
    assert len(got) == len(truth)
    right = []
    for doc_id, lang, text in truth:
        r = got[doc_id]
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text))
        assert 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == lang)
    assert np.mean(right) > 0.97, np.mean(right)


def test_texts_in_no_language_go(spark):
    """Random letters, consonants and unlearned languages in Latin letters go; clean texts of a few words stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(5)
    made = lambda letters: " ".join("".join(rng.choice(list(letters), rng.integers(2, 10))) for _ in range(60))
    odd = [made("abcdefghijklmnopqrstuvwxyz"), made("bcdfghjklmnpqrstvwxz")]
    odd += ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."]
    odd += ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."]
    clean = ["the house of the lord", "la maison de la mer", "die Frau und der Mann", "la casa de los niños"]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd + clean)], "doc_id long, text string, lang string")
    kept = langid.keep_identified(docs.unionByName(more)).select("doc_id", "text").collect()
    assert [r.text for r in sorted((r for r in kept if r.doc_id < 0), key=lambda r: -r.doc_id)] == clean
    letters = docs.filter("text rlike '[a-zA-Z]'").count()
    assert sum(r.doc_id >= 0 for r in kept) >= letters


@pytest.mark.parametrize("sizes,weights", [([10, 10, 10], [1, 2, 3]), ([100, 1, 1], [1, 2, 3]), ([0, 5, 0], [1, 2, 3]), ([7], [1]), ([1, 1000, 30, 2], [1, 2, 3, 1])])
def test_water_fill(sizes, weights):
    targets = mixing.water_fill(sizes, weights, 3)
    assert abs(sum(targets) - sum(sizes)) < 1e-6
    assert all(t <= 3 * s + 1e-9 for t, s in zip(targets, sizes))
    free = [t / w for t, w, s in zip(targets, weights, sizes) if t < 3 * s - 1e-9]
    assert not free or max(free) - min(free) < 1e-6


def test_mix(spark, small, documents):
    got = queries.QUERIES["op3_source_mix"](spark, small).toPandas()
    assert len(got) == len(documents)
    sizes = {d: len(WORD.findall(t or "")) for d, t, *_ in documents}
    assert dict(zip(got.doc_id, got["size"])) == sizes
    per = Counter()
    for d, _, _, s in documents:
        per[s] += sizes[d]
    names = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    targets = dict(zip(names, mixing.water_fill([per[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))], 3)))
    source = {d: s for d, _, _, s in documents}
    assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    for s, g in got.groupby(got.doc_id.map(source)):
        assert (g.source_size == per[s]).all() and np.allclose(g.target, targets[s])
        assert abs(g.taken.sum() - targets[s]) <= max(20, 0.02 * targets[s]), (s, g.taken.sum(), targets[s])
    again = queries.QUERIES["op3_source_mix"](spark, small).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_mix_takes_targets_where_blocks_are_large(spark):
    """Blocks as of 268 million words (4096 words), with a large source and tail sources of a few hundred words."""
    rng = np.random.default_rng(3)
    sizes = [120_000, 90_000] + [int(n) for n in rng.integers(150, 1200, 30)]
    rows = [(100 * i + k, "w " * (n // 3 + (n % 3 if k == 0 else 0)), f"s{i:02d}") for i, n in enumerate(sizes) for k in range(3)]
    documents, pieces = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), least_slots=1, most_block=4096)
    taken = {r.s: r.n for r in pieces.groupBy("s").agg({"words": "sum"}).toDF("s", "n").collect()}
    targets = {r.s: r.target for r in documents.select("s", "target").distinct().collect()}
    assert sum(taken.values()) == sum(sizes)
    assert all(abs(taken.get(s, 0) - t) < 1 for s, t in targets.items()), sum(s not in taken for s in targets)
    last = -(-sum(sizes) // 4096)
    assert all(0 <= r.slot < last for r in pieces.select("slot").distinct().collect())


def plain_secrets(text):
    patterns = {"assign": re.compile(secret_scan.ASSIGN, re.I | re.A), "access": re.compile(secret_scan.ACCESS), "hex": re.compile(secret_scan.HEX), "forge": re.compile(secret_scan.FORGE), "package": re.compile(secret_scan.PACKAGE)}
    out = []
    for k, p in patterns.items():
        for m in p.finditer(text or ""):
            if len(m[2] if k == "assign" else m[0]) >= secret_scan.LEAST[k] if k in secret_scan.LEAST else plain_checksum(m[0]):
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def plain_checksum(token):
    """The last six characters as a number in base 62 are the CRC-32 of the thirty before."""
    value = 0
    for c in token[-6:]:
        value = 62 * value + secret_scan.BASE62.index(c)
    return value == zlib.crc32(token[-36:-6].encode())


def test_secret_scan_of_tokens_with_checksums(spark):
    rng = np.random.default_rng(8)
    letters = list(secret_scan.BASE62)

    def token(prefix, good):
        body = "".join(rng.choice(letters, 30))
        value, digits = zlib.crc32(body.encode()) + (0 if good else 1), ""
        for _ in range(6):
            value, d = divmod(value, 62)
            digits = secret_scan.BASE62[d] + digits
        return prefix + body + digits

    rows = []
    for i in range(300):
        parts = [str(rng.choice(["é ", "token=", "x", " ", "\n", "ghp_", "npm_", "password: 'abcdef12' "])) + token(str(rng.choice(["ghp_", "gho_", "npm_", "ghx_"])), bool(rng.integers(2))) + str(rng.choice(["", " ", "a", "."])) for _ in range(3)]
        rows.append((i, "".join(parts)))
    got = {r.doc_id: r.spans for r in secret_scan.scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: secret_scan.joined(plain_secrets(t)) for i, t in rows}
    assert got == want and sum("forge" in s for s in want.values()) > 50 and sum("package" in s for s in want.values()) > 50


def plain_grams(text):
    """Counts of n-grams of one to three characters around letters; whatever is no letter is a blank."""
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    key = lambda *chars: sum(ord(c) << (21 * (len(chars) - 1 - i)) for i, c in enumerate(chars))
    n = Counter()
    for i, c in enumerate(s):
        if c != " ":
            n[key(c)] += 1
            n[key(s[i - 1], c, s[i + 1])] += 1
        if i and (c != " " or s[i - 1] != " "):
            n[key(s[i - 1], c)] += 1
    return n


def plain_languages(rows, length=400):
    """(held out, language, score) of rows (doc_id, text, lang) by the out-of-place distance."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in rows]
    totals = {}
    for (_, t, lang), h in zip(rows, held):
        if not h and t is not None and lang is not None:
            totals.setdefault(lang, Counter()).update(plain_grams(t))
    order = lambda n: [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:length]]
    profiles = {lang: {g: i for i, g in enumerate(order(totals[lang]))} for lang in sorted(totals) if totals[lang]}
    out = []
    for (_, t, _), h in zip(rows, held):
        own = order(plain_grams(t)) if t and profiles else []
        if not own:
            out.append((h, "und", 0.0))
            continue
        far = {lang: sum(min(abs(p[g] - i), length) if g in p else length for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(far, key=far.get)
        out.append((h, best, 1 - far[best] / (length * len(own))))
    return out


def test_languages_equal_plain_distances(spark, small, documents, odd, odd_rows):
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in queries.QUERIES["op5_language_id"](spark, small).collect()}
    for (d, *_), want in zip(documents, plain_languages([d[:3] for d in documents])):
        assert got[d][:2] == want[:2] and abs(got[d][2] - want[2]) < 1e-12, d
    rows = [(d, t, lang) for _, d, t, lang, *_ in odd_rows]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:3], round(x[3], 9))
    assert sorted(map(key, map(tuple, langid.identify_languages(odd).collect()))) == sorted(key((d, *w)) for (d, *_), w in zip(rows, plain_languages(rows)))


def test_mix_takes_each_stream_up_to_its_target(spark, small):
    """Words taken, from the definition: a source's documents in hash order, repeated, up to its whole target."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{small}/documents.parquet")
    shuffled = docs.select("doc_id", "source", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(17)).alias("o")).collect()
    got = {r.doc_id: r for r in mixing.mix_documents(docs).collect()}
    for source in {r.source for r in shuffled}:
        mine = sorted((r.o, r.doc_id) for r in shuffled if r.source == source)
        total = sum(got[d]["taken"] for _, d in mine)
        left, taken = total, Counter()
        assert abs(total - got[mine[0][1]].target) < 1
        while left:
            for _, d in mine:
                k = min(left, got[d]["size"])
                taken[d] += k
                left -= k
        assert all(got[d]["taken"] == taken[d] for _, d in mine), source


def plain_probability(model, text):
    """The model's probability with features hashed one by one."""
    words = (text or "").encode().split()
    bucket = lambda key: (key * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - quality.BITS)
    h = [zlib.crc32(w) for w in words]
    kinds = [[bucket(x | 1 << 40) for x in h], [bucket((a * 0xC2B2AE3D27D4EB4F % (1 << 64)) ^ b) for a, b in zip(h, h[1:])], []]
    for i, w in enumerate(words):
        s = b" " + w + b" "
        for n, tag in ((3, 3 << 40), (4, 4 << 40)):
            kinds[2] += [bucket(int.from_bytes(s[j : j + n], "little") | tag) for j in range(len(s) - n + 1)]
    z = sum(quality.SCALE * sum(model.weights[k] for k in some) / len(some) for some in kinds if some)
    return 1 / (1 + np.exp(-(model.a * (z + model.bias) + model.b)))


def test_quality_equals_plain_scores(spark, small, documents):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.judge_quality(docs, labels).collect()}
    for d, t, *_ in documents:
        p = plain_probability(model, t)
        assert abs(got[d].probability - p) < 1e-9 and got[d].kept == (not got[d].base_failed and p >= 0.5), d


def test_odd_rows(spark, odd, odd_rows, empty):
    n = len(odd_rows)
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, 1), (5, 0)], "doc_id long, quality int")
    for f in (secret_scan.scan_documents, langid.identify_languages, mixing.mix_documents, lambda d: quality.judge_quality(d, labels)):
        assert f(odd).count() == n
        assert f(empty).count() == 0
    assert quality.judge_quality(odd, labels.limit(0)).count() == n
    mix = mixing.mix_documents(odd).collect()
    assert all(r.taken <= 3 * r["size"] for r in mix) and sum(r.taken for r in mix) > 0
    clean = secret_scan.redact_documents(odd)
    assert clean.columns == odd.columns and clean.count() == n
    assert Counter((r.doc_id, r.spans) for r in secret_scan.scan_documents(odd).collect()) == Counter((r[1], secret_scan.joined(plain_secrets(r[2]))) for r in odd_rows)
    judged = Counter((r.doc_id, r.n_words, r.word_chars, r.n_dup_lines) for r in quality.judge_quality(odd, labels).collect())
    words = lambda t: WORD.findall(t or "")
    assert judged == Counter((r[1], len(words(r[2])), sum(map(len, words(r[2]))), 0) for r in odd_rows)
    assert Counter((r.doc_id, r["size"], r.source) for r in mix) == Counter((r[1], len(words(r[2])), r[4]) for r in odd_rows)
    for stage in (langid.keep_identified, secret_scan.redact_documents, mixing.mixed_documents):
        assert stage(empty).columns == empty.columns and stage(empty).count() == 0
    same = [f for f in odd.columns if f not in ("text", "n_chars")]
    assert Counter(tuple(r[c] for c in same) for r in clean.collect()) == Counter(tuple(r[c] for c in same) for r in odd.collect())
    assert {r.text for r in langid.keep_identified(odd).collect()} <= {r[2] for r in odd_rows if r[2] and r[2].strip()}
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_mixed_documents_repeat_whole_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    mixed = mixing.mixed_documents(docs)
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    share = {r.doc_id: r.taken / r["size"] for r in mixing.mix_documents(docs).collect() if r["size"]}
    assert all(abs(times.get(d, 0) - x) <= 0.5 for d, x in share.items()) and max(times.values()) <= 3

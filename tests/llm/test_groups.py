"""Operators across documents, urls and vectors against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import ann, packing, queries, simhash, substring_dedup, token_files, url_rules
from graphloom.llm.common import CachedEncoder, shared_path

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def pieces_of(rows, capacity=2048):
    tokenizer = Tokenizer.from_file(BYTES)
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        at = k = 0
        while at < len(ids):
            to = at + ((len(ids) - at) % capacity or capacity)
            out.append((doc_id, k, at, to - at, zlib.crc32(np.array(ids[at:to], dtype="<u4").tobytes())))
            at, k = to, k + 1
    return out


def check_packing(got, rows, capacity=2048):
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(pieces_of(rows), key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, small, documents):
    got = queries.QUERIES["op1_best_fit_packing"](spark, small).collect()
    n = check_packing(got, [d[:2] for d in documents])
    counts = dict(Counter(r.length for r in got))
    assert n <= sum(k for _, k in packing.best_fit(counts, 2048))


@pytest.mark.parametrize("n,mean", [(1, 5), (40, 900), (3000, 300), (20000, 700)])
def test_packing_plan(n, mean):
    rng = np.random.default_rng(n)
    counts = dict(Counter(np.clip(rng.lognormal(np.log(mean), 0.8, n).astype(int), 1, 2048).tolist()))
    plan = packing.plan_packing(dict(counts), 2048)
    got = Counter()
    for config, k in plan:
        assert sum(config) <= 2048 and k > 0
        for size in config:
            got[size] += k
    assert got == Counter(counts)
    assert sum(k for _, k in plan) <= sum(k for _, k in packing.best_fit(dict(counts), 2048))


def test_packing_meets_the_lower_bound():
    """The lengths of the sf0.01 documents fit into as few sequences as their sum allows."""
    texts = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").to_arrow_table().column("text").combine_chunks()
    counts = Counter()
    for ids in CachedEncoder(BYTES, True).encode(texts):
        n = len(ids) // 4 + 1
        counts.update([2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0))
    bound = packing.lower_bound(dict(counts), 2048)
    assert bound >= -(-sum(k * n for k, n in counts.items()) // 2048)
    assert sum(k for _, k in packing.plan_packing(dict(counts), 2048)) == bound


def test_lower_bound_counts_pieces_over_half():
    assert packing.lower_bound({6: 10}, 10) == 10 and packing.lower_bound({6: 10, 4: 10}, 10) == 10 and packing.lower_bound({}, 10) == 0


def test_knapsack_prices():
    rng = random.Random(1)
    for _ in range(20):
        lengths = sorted(rng.sample(range(1, 30), 4))
        values = np.array([rng.random() * x for x in lengths])
        best, _ = packing.price_knapsack(np.array(lengths), values, 40)
        plain = [0.0] * 41
        for room in range(1, 41):
            plain[room] = max([plain[room - 1]] + [plain[room - x] + v for x, v in zip(lengths, values) if x <= room])
        assert np.allclose(best, plain)


def test_encoder_equals_library():
    rng = random.Random(2)
    texts = ["", " ", "\n", "a  b", "x\n\ny", " lead", "trail ", "a\tb \tc", "caf\u0301e \u0301x", "don't 's x's  'll", "a\x1cb", "a<|endoftext|> b", "İST ΣΑΣ", "a\u3000b", "𝕏 😀", "x² ½ ªº µ", "a\xa0b\xad"]
    texts += ["".join(rng.choice("ab'sl \n\té.,1!²") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for path, leading in ((BYTES, True), (WORDS, False)):
        encode = CachedEncoder(path, leading, capacity=500)
        for text, ids in zip(texts, encode.encode(pa.array(texts))):
            assert np.frombuffer(ids, dtype="<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark, small, documents):
    tokenizer = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in queries.QUERIES["op4_token_files"](spark, small).collect()}
    start = 0
    for doc_id, text, *_ in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(documents)


def test_token_files_read_what_is_asked_for(spark, small, documents, odd, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    path = token_files.write_token_files(docs, shared_path(spark, "t"), WORDS, False, 2, shard_bytes=20_000)
    wanted = [documents[3][0], documents[77][0], 10**12]
    rows = token_files.read_token_files(spark, path, wanted, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    texts = {d: t for d, t, *_ in documents}
    assert {r.doc_id: r.ids for r in rows} == {d: tokenizer.encode(texts[d], add_special_tokens=False).ids + [2] for d in wanted[:2]}
    assert token_files.token_file_digest(odd, WORDS, False, 2).count() == odd.count()
    assert token_files.token_file_digest(empty, WORDS, False, 2).count() == 0


def test_shard_frames(tmp_path):
    import zstandard

    builder = token_files.ShardBuilder(2)
    ids = [np.arange(n, dtype="<u4") for n in (1, 0, 5000)]
    for d, x in zip((None, 3, 9), ids):
        builder.add(d, x)
    data = builder.build(4, 2) + token_files.TAIL.encode()
    (tmp_path / "s").write_bytes(data)
    shard = token_files.Shard.of_file(str(tmp_path / "s"))
    assert [shard.ids(i).tolist() for i in range(3)] == [x.tolist() for x in ids]
    assert (shard.find(9), shard.find(None), shard.find(4)) == ([2], [0], [])
    # a plain reader passes over the seek table
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(x.astype("<u2").tobytes() for x in ids)
    broken = bytearray(data)
    broken[int(shard.starts[2]) + 40] ^= 255
    with pytest.raises(Exception):
        token_files.Shard.of_bytes(bytes(broken)).ids(2)


def plain_removal(texts, width):
    """For each text (bytes) which bytes lie in a string of width bytes that starts anywhere else too."""
    at = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - width + 1):
            if at[t[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(gone)
    return out


def plain_passages(texts, gone, width, words):
    """gone, and the bytes of strings of whole words, shorter than width, that occur elsewhere too."""
    found = []
    for t in texts:
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        found.append([(a, b) for (a, _), (_, b) in zip(at, at[words - 1 :]) if b - a < width])
    n = Counter(t[a:b] for t, spans in zip(texts, found) for a, b in spans)
    out = [g.copy() for g in gone]
    for t, spans, g in zip(texts, found, out):
        for a, b in spans:
            if n[t[a:b]] > 1:
                g[a:b] = True
    return out


def runs_in(gone):
    return int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())


def digest_row(data, gone, told):
    kept = bytes(np.frombuffer(data, dtype=np.uint8)[~gone]) if len(data) else b""
    return len(data), int(gone.sum()), runs_in(gone), hashlib.sha256(kept).hexdigest(), runs_in(told), int(told.sum())


def test_substring_removal(spark, small, documents):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op2_substring_dedup"](spark, small).collect()}
    texts = [(t or "").encode() for _, t, *_ in documents]
    removed = plain_removal(texts, 400)
    for (doc_id, *_), data, gone, told in zip(documents, texts, removed, plain_passages(texts, removed, 400, 51)):
        assert got[doc_id] == digest_row(data, gone, told), doc_id


@pytest.fixture(scope="module")
def made_up_texts():
    """Small alphabets, shared passages with changed bytes, periodic texts; with and without crowded anchors."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcd ") for _ in range(300))
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 250)
            cut = list(passage[a : a + rng.randint(1, 200)])
            if cut and rng.random() < 0.4:
                cut[rng.randrange(len(cut))] = rng.choice("é  \n")
            parts += ["".join(cut), "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30)))]
        rows.append((i, "".join(parts)))
    rows += [(200, "a" * 500), (201, "ab" * 300), (202, "abc" * 100 + "q"), (203, ""), (204, None), (205, passage), (205, passage), (None, passage[:40]), (206, passage[:39])]
    return rows


@pytest.mark.parametrize("most,words", [(512, 51), (2, 6), (512, 6), (2, 0)])
def test_substring_removal_of_made_up_texts(spark, made_up_texts, most, words):
    docs = spark.createDataFrame(made_up_texts, "doc_id long, text string")
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(docs, width=40, gram=8, words=words, most=most).collect())
    texts = [(t or "").encode() for _, t in made_up_texts]
    gone = plain_removal(texts, 40)
    told = plain_passages(texts, gone, 40, words) if words else gone
    assert got == Counter((d, *digest_row(t, g, w)) for (d, _), t, g, w in zip(made_up_texts, texts, gone, told))


def test_substring_removal_when_digests_collide(spark, made_up_texts, monkeypatch):
    """Equal digests of different runs: the sort finds out, and another salt is taken."""
    plain = substring_dedup.digest
    tried = []

    def weak(data, salt=0):
        return (len(data) % 2, 0) if salt == 0 else plain(data, salt)

    monkeypatch.setattr(substring_dedup, "digest", weak)
    spans = substring_dedup.spans
    monkeypatch.setattr(substring_dedup, "spans", lambda *a: tried.append(a[-1]) or spans(*a))
    docs = spark.createDataFrame(made_up_texts, "doc_id long, text string")
    got = Counter(tuple(r)[:5] for r in substring_dedup.remove_repeats(docs, width=40, gram=8, words=0).collect())
    texts = [(t or "").encode() for _, t in made_up_texts]
    gone = plain_removal(texts, 40)
    assert tried == [0, 1] and got == Counter((d, *digest_row(t, g, g)[:4]) for (d, _), t, g in zip(made_up_texts, texts, gone))


def test_suffix_sort():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    group = np.array(sorted(rng.randint(0, 9) for _ in strings))
    order, common = substring_dedup.Suffixes(strings).sort(group)
    assert [(group[i], strings[i]) for i in order] == sorted((g, s) for g, s in zip(group, strings))
    plain = substring_dedup.Suffixes(strings)._sort_plainly(group)
    assert (common == plain[1]).all()


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else (least[r] if d is None else min(least[r], d))
    return [(rows[i][0], f"{prints[i]:016x}", least[find(i)]) for i in range(len(rows))]


def test_simhash(spark, small, documents, odd, odd_rows, empty):
    got = queries.QUERIES["op10_simhash"](spark, small).collect()
    want = plain_components([d[:2] for d in documents])
    assert Counter(map(tuple, got)) == Counter(want)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want})
    assert Counter(map(tuple, simhash.near_duplicates(odd).collect())) == Counter(plain_components([(r[1], r[2]) for r in odd_rows]))
    assert simhash.drop_near_duplicates(odd).count() == len({w[2] for w in plain_components([(r[1], r[2]) for r in odd_rows])})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_simhash_links_of_dense_fingerprints(spark):
    """Chains and clusters of fingerprints, with parts of anchors dealt out: the same components as all pairs give."""
    rng = random.Random(6)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(60):
            prints.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    frame = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    for blocks, home, visit in ((3, 4096, 32768), (3, 5, 7), (2, 4096, 32768)):
        labels = {r.node: r.label for r in simhash.connected_components(simhash.links(frame, 4, blocks, home, visit)).collect()}
        groups = {}
        for p in prints:
            groups.setdefault(labels.get(signed[p], signed[p]), set()).add(find(p))
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({find(p) for p in prints})


def test_blocks_follow_the_number_of_fingerprints():
    assert simhash.cheapest_blocks(1000) == simhash.cheapest_blocks(1_000_000) == 3 and simhash.cheapest_blocks(10**9) == 2


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(7, 7)], "u long, v long")
    labels = {r.node: r.label for r in simhash.connected_components(edges).collect()}
    assert len({labels[i] for i in range(301)}) == 1 and len({labels[1000 + i] for i in range(50)}) == 1 and len(set(labels.values())) == 2


def plain_rule(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in url_rules.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_url_rules(spark, small):
    pages = duckdb.sql(f"select page_id, url from '{small}/pages.parquet'").fetchall()
    odd = [None, "", "x", "://", "http://com", "http://com/", "http://COM/En/x?y", "http://.com/", "http://a.example.com?x/en/", "https://www.example.com/en/", "https://b.www.example.com/en/1#a?b",
           "http://xexample.com/en/", "http://net/es/", "http://a.net/es", "http://a.net/fr/x", "ftp://É.NET/fr/é", "http://example.com:80/en/", "a://b://net/es/"]
    pages += [(10_000 + i, u) for i, u in enumerate(odd)] + [(10_000, None), (None, "http://a.net/fr/")]
    frame = spark.createDataFrame([("k", i, u, 1) for i, u in pages], "key string, page_id long, url string, range int")
    got = Counter(map(tuple, url_rules.judge_urls(frame).collect()))
    assert got == Counter((i, *plain_rule(u)) for i, u in pages)
    assert url_rules.judge_urls(frame.limit(0)).count() == 0


def brute_nearest(rows, k=10):
    out = {}
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    for i, v in rows:
        if i % 100 == 0:
            far = np.sqrt(((x - np.array(v, dtype=np.float64)) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, far)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), far[j]) for j in order]
    return out


@pytest.mark.parametrize("sf,least", [("sf0.001", 0.9), ("sf0.1", 0.9)])
def test_nearest(spark, sf, least):
    d = f"/root/testdata/{sf}"
    rows = duckdb.sql(f"select vec_id, embedding from '{d}/embeddings.parquet'").fetchall()
    want = brute_nearest(rows)
    got = {}
    for r in queries.QUERIES["op8_nearest"](spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(g) == 10 for g in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / (10 * len(want))
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    assert all(abs(s - np.linalg.norm(vectors[q] - vectors[i])) < 1e-9 for q, g in got.items() for i, s in g)
    assert found >= least, found


@pytest.mark.parametrize("noise", [0.3, 0.1, 0.03])
def test_nearest_in_dense_groups(spark, noise):
    """Thousands of near copies, whose codes hardly differ: the ten nearest are exact, whatever the batch size."""
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(3, 64))
    x = np.concatenate([m + noise * rng.normal(size=(3000, 64)) for m in middles] + [rng.normal(size=(1000, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = list(enumerate(x.tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    want = {q: [i for i, _ in w] for q, w in brute_nearest(rows).items()}
    for size in (10_000, 700):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {}
        for r in ann.nearest(frame, frame.vec_id % 100 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        found = sum(len(set(got[q]) & set(w)) for q, w in want.items()) / (10 * len(want))
        assert got == want, found


@pytest.mark.parametrize("n", [5_000, 50_000])
def test_nearest_recall_does_not_hang_on_batches(spark, n):
    """Clustered vectors, queries sent to as many cells as 0.99 of the sample's neighbours need: the same rows under two
    batch sizes, and at least 0.9 of the true ones."""
    rng = np.random.default_rng(n)
    middles = rng.normal(size=(max(5, n // 500), 32))
    x = (middles[rng.integers(len(middles), size=n)] + 0.5 * rng.normal(size=(n, 32))).astype(np.float32)
    rows = list(enumerate(x.tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    path = shared_path(spark, "vectors")
    frame.write.parquet(path)
    frame = spark.read.parquet(path)
    want = brute_nearest(rows)
    results = []
    for size in (10_000, 60_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {}
        for r in ann.nearest(frame, frame.vec_id % 100 == 0, recall=0.99).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        results.append(got)
    assert results[0] == results[1] and got.keys() == want.keys()
    found = sum(len(set(got[q]) & {i for i, _ in w}) for q, w in want.items()) / (10 * len(want))
    assert found >= 0.9, found


def test_nearest_among_equal_vectors(spark):
    """A third of all rows are one vector: ties go to the smaller vec_id, none of the own rows is found."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8))
    x[::3] = x[0]
    rows = list(enumerate(x.tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(frame, frame.vec_id % 100 == 0, cell_rows=100, part_bytes=1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in w] for q, w in brute_nearest(rows).items()}


def test_nearest_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0]), (6, [None, 1.0, 0.0]), (7, [1.0]), (100, [0.9, 0.1, 0.0]), (8, []), (None, [1.0, 1.0, 1.0]), (2, [0.0, 1.0, 0.0]), (9, [float("inf"), 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, code string")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(frame, frame.vec_id % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (0, 4, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, 2)]
    assert ann.nearest(frame.limit(0), frame.vec_id % 100 == 0).count() == 0


def test_odd_rows(spark, odd, odd_rows, empty):
    got = packing.pack_documents(odd, BYTES).collect()
    check_packing(got, [(r[1], r[2]) for r in odd_rows])
    assert packing.pack_documents(empty, BYTES).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    texts = [(r[2] or "").encode() for r in odd_rows]
    gone = plain_removal(texts, 400)
    want = Counter((r[1], *digest_row(t, g, w)) for r, t, g, w in zip(odd_rows, texts, gone, plain_passages(texts, gone, 400, 51)))
    assert Counter(map(tuple, substring_dedup.remove_repeats(odd).collect())) == want
    tokenizer, start, files = Tokenizer.from_file(WORDS), 0, []
    got = sorted(token_files.token_file_digest(odd, WORDS, False, 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[1] for r in odd_rows), key=lambda d: (d is not None, d))
    for r in got:
        assert r.start == start
        start += r.n_tokens
        files.append((r.doc_id, r.n_tokens, r.ids_crc32))
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    assert Counter(files) == Counter((r[1], len(ids(r[2])), zlib.crc32(np.array(ids(r[2]), dtype="<u4").tobytes())) for r in odd_rows)


def test_pipeline(spark, small, documents):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = shared_path(spark, f"test-{name}")
        stage(spark, frames[-1], small).write.parquet(path)
        frames.append(spark.read.parquet(path))
    start, known, single, clean, mixed, packed = frames
    assert all(f.columns == docs.columns for f in frames[:5])
    words = {d for d, t, *_ in documents if any(c.isalpha() for c in t)}
    assert {r.doc_id for r in known.collect()} <= words and known.count() > 0.9 * len(words)
    rows = [(r.doc_id, r.text) for r in known.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for *_, c in plain_components(rows)})
    from graphloom.llm.secret_scan import find_secrets

    assert clean.count() == single.count() and not any(find_secrets(r.text) for r in clean.collect())
    check_packing(packed.collect(), [(r.doc_id, r.text) for r in mixed.collect()])
    assert corpus_pipeline.run(spark, small).count() == packed.count()


def test_pipeline_of_odd_and_empty_tables(spark, odd, odd_rows, empty):
    for frame, name in ((odd, "odd"), (empty, "empty")):
        folder = shared_path(spark, name)
        frame.write.parquet(f"{folder}/documents.parquet")
        packed = corpus_pipeline.run(spark, folder)
        assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        if name == "empty":
            assert packed.count() == 0
            continue
        texts = {r[1]: r[2] for r in odd_rows if r[1] is not None and r[2] and any(c.isalpha() for c in r[2])}
        ids = {r.doc_id for r in packed.collect()}
        assert ids and ids <= set(texts) and not ids & {1, 2, 3, -7}
        # what is left are whole documents, in gapless sequences
        rows = [r for r in packed.collect() if r.piece == 0]
        check_packing(packed.collect(), [(r.doc_id, texts[r.doc_id]) for r in rows])

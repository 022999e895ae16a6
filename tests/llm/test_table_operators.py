"""Mixing, WARC, sharding, near-duplicates and the pipeline."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pitchline.llm import blocks, components, embeddings, mixing, sharding, simhash, warc
from pitchline.llm.common import new_folder


def union(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


# mixing


def brute_targets(sizes):
    """{source: words} in code point order, None last -> targets by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1.0 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in capped else share[s] for s in order}
        capped |= over


def check_mix(docs):
    got = mixing.mix(docs).collect()
    size = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, size(r.text)) for r in docs.collect())
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += size(r.text)
    want = brute_targets(dict(sizes))
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert {(r.source_size, round(r.target, 6)) for r in got} == {(sizes[s], round(t, 6)) for s, t in want.items()}
    assert sum(r.taken for r in got) == sum(round(t) for t in want.values())
    return got


def test_mixing_targets(spark, sf_dir, edge_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = check_mix(docs)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target = Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in target.items())
    check_mix(edge_docs)
    assert mixing.mix(no_docs).count() == 0


def test_mixed_documents_hold_the_taken_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.encode().split())
        assert text[r.doc_id].startswith(r.text)  # blanks and all
    assert words == Counter({r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken})


def test_mixed_documents_of_repeated_rows_and_clashing_names(spark, edge_docs, no_docs, monkeypatch):
    names = ["row", "id", "h", "size", "taken", "n", "copy", "kept", "_h", "_id", "_salt", "slot", "ties"]
    docs = edge_docs.drop("size", "h", "n_tokens").withColumns({c: F.lit(5) for c in names})
    for limit in (10**6, -1):  # by broadcast and by shuffle
        monkeypatch.setattr("pitchline.llm.common.BROADCAST_ROWS", limit)
        want, words = Counter(), Counter()
        for r in mixing.mix(docs).collect():
            want[r.doc_id] += r.taken
        out = mixing.mixed_documents(docs)
        assert out.columns == docs.columns
        for r in out.collect():
            words[r.doc_id] += len(r.text.encode().split())
        assert words == Counter({k: n for k, n in want.items() if n})
        same = spark.createDataFrame([(1, "a b  c\n d", "x")] * 3 + [(2, "e " * 100, "x"), (3, "f " * 11, "y")], "doc_id long, text string, source string")
        taken = sum(r.taken for r in mixing.mix(same).collect())
        assert sum(len(r.text.split()) for r in mixing.mixed_documents(same).collect()) == taken
        kept = simhash.one_of_each_group(docs)
        assert kept.columns == docs.columns and kept.count() == len({r.component_id for r in simhash.simhash_groups(docs).collect()})
    assert mixing.mixed_documents(no_docs).count() == 0


def brute_taken(spark, docs):
    """{(id, text hash): words} of the same schedule, slot by slot in Python."""
    sizes = [(r.doc_id, r.source, len((r.text or "").encode().split()), r.h, r.o) for r in docs.select("doc_id", "text", "source", F.xxhash64("text").alias("h"), F.xxhash64("doc_id", F.xxhash64("text"), F.lit(7)).alias("o")).collect()]
    total = Counter()
    for _, s, n, _, _ in sizes:
        total[s] += n
    targets = {s: int(math.floor(t + 0.5)) for s, t in brute_targets(dict(total)).items()}
    block, taken = mixing.BLOCK, Counter()
    for s, words in targets.items():
        own = [x for x in sizes if x[1] == s]
        parts = max(1, -(-len(own) // mixing.PART_ROWS))
        own.sort(key=lambda x: (x[4] % parts, x[4], x[0], x[2], x[3]))
        flat = [(x[0], x[3]) for x in own for _ in range(x[2])]
        for _ in range(words // len(flat) if flat else 0):
            taken.update(flat)
        rest = words % len(flat) if flat else 0
        taken.update(flat[:rest])
    assert block > 0
    return taken


def test_taken_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = Counter()
    slots = []
    for r in mixing.mix(docs).collect():
        got[r.doc_id, r.h] += r.taken
        slots += [r.slot] if r.slot is not None else []
    assert Counter({k: n for k, n in got.items() if n}) == brute_taken(spark, docs)
    assert len(set(slots)) > len(slots) // 4


def test_schedule_is_even(spark):
    t = spark.createDataFrame([("a", 500), ("b", 300), ("c", 200)], "skey string, words long")
    rows = mixing.schedule(spark, t, 1000).collect()
    for k in (100, 400, 1000):
        seen = Counter(r.skey for r in rows if r.slot < k)
        assert all(abs(seen[s] - k * w) < 8 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    for s in "abc":
        own = sorted((r.slot, r.rank) for r in rows if r.skey == s)
        assert [rank for _, rank in own] == list(range(len(own)))


def test_no_query_of_the_mix_is_large(spark, sf_dir, monkeypatch):
    """The driver holds each query's plan, again for every stage that ends."""
    sizes, staged = [], mixing.staged

    def seen(df, tag="whole"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        sizes.append((tag, plan.count("Exchange "), plan.count("Window [")))
        return df

    monkeypatch.setattr(mixing, "staged", lambda df, tag: staged(seen(df, tag), tag))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = seen(mixing.mixed_documents(docs))
    assert len(sizes) > 3 and out.count() > 0
    assert all(exchanges <= 10 and windows <= 6 for _, exchanges, windows in sizes), sizes


# WARC


def test_warc_equals_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS FROM '{sf_dir}/pages.parquet'")
    want = sorted(c.sql(warc.ORACLE_SQL).fetchall(), key=str)
    assert sorted(map(tuple, warc.op4_warc(spark, sf_dir).collect()), key=str) == want


def test_warc_round_trip(spark):
    html = "<p>" + "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n" * 60
    pages = [(1, "http://a/b?c=1 2\r\nX: y", html), (2, "u", html), (2, "u", html), (None, None, html), (3, None, None), (4, "h", ""), (5, "x", "\x00\n" + "a" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = new_folder(spark, "test-warc")
    warc.write_archives(df, folder)
    got = warc.captures(warc.read_records(spark, folder, with_payload=True)).collect()
    assert len(got) == len(pages) and all(r.n_requests == r.n_metadata == 1 for r in got)
    kinds = Counter(r.response.type for r in got)
    assert kinds == {"response": 4, "revisit": 3}
    for r in got:
        i = r.metadata.fields.get("pageId")
        own = next(p for p in pages if (str(p[0]) if p[0] is not None else None) == i)
        assert warc.page_url(r.metadata.fields.get("pageUrl")) == own[1]
        assert r.response.payload.decode() == ("" if r.response.type == "revisit" else own[2] or "")
    out = warc.archive_and_read(df, "bigint").collect()
    assert {r.refers_to for r in out if r.record_type == "revisit"} == {2}
    assert warc.archive_and_read(df.limit(0), "bigint").count() == 0


def test_warc_ties_text_ids_and_hot_payloads(spark, monkeypatch):
    """Rows alike in everything, ids with blanks and line ends, one payload in many rows."""
    big, rows = "é" * 700, []
    rows += [(" a\r\n", "u", big)] * 3 + [("b ", f"v{k}", big) for k in range(40)] + [(None, "w", big), ("c", None, "x" * 999), ("c", None, "x" * 999), ("d", "", "y" * 1000)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    for limit in (10**6, -1):
        monkeypatch.setattr("pitchline.llm.common.BROADCAST_ROWS", limit)
        for frame in (df, df.repartition(5)):
            out = warc.archive_and_read(frame, "string").collect()
            assert Counter(r.page_id for r in out) == Counter(r[0] for r in rows)
            assert Counter((r.record_type, r.refers_to) for r in out) == {("response", None): 4, ("revisit", "b "): 43}


# sharding


def check_shards(docs):
    got = sharding.shards(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    return by


def test_shards_are_balanced_and_gapless(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = check_shards(docs)
    sums = [sum(r["size"] for r in by[k]) for k in range(8)]
    longest = max(r["size"] for rows in by.values() for r in rows)
    assert max(sums) - min(sums) <= 2 * longest
    check_shards(edge_docs)
    assert sharding.shards(no_docs).count() == 0


def test_a_large_group_of_copies_is_cut(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "copy").otherwise(F.concat(F.lit("own text "), F.col("id").cast("string"))).alias("text"))
    sums = [sum(r["size"] for r in rows) for rows in check_shards(docs).values()]
    assert len(sums) == 8 and max(sums) < 1.05 * min(sums)


# SimHash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_simhash(docs):
    own = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    links = [(i, j) for i in range(len(own)) for j in range(i) if (own[i][1] ^ own[j][1]).bit_count() <= 3]
    comp = union(len(own), links)
    least = {}
    for (doc_id, _), c in zip(own, comp):
        least[c] = min((x for x in (least.get(c), doc_id) if x is not None), default=None)
    want = Counter((d, fp, least[c]) for (d, fp), c in zip(own, comp))
    got = simhash.simhash_groups(docs).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    return want


def test_simhash_equals_brute_force(spark, sf_dir, edge_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_simhash(docs)
    want = check_simhash(edge_docs)
    assert len(simhash.one_of_each_group(edge_docs).collect()) == len({c for _, _, c in want})
    assert simhash.one_of_each_group(docs).columns == docs.columns
    assert simhash.simhash_groups(no_docs).count() == 0 and simhash.one_of_each_group(no_docs).count() == 0
    hexed = simhash.op6_simhash(spark, sf_dir).first()
    assert len(hexed.fingerprint) == 16 and hexed.fingerprint == hexed.fingerprint.lower()


@pytest.mark.parametrize("n", [1, 1 << 25, 1 << 40])
def test_links_span_at_every_width(spark, monkeypatch, n):
    """Every index width, with lists long enough to be dealt into parts."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 63, 6)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for c in centre for _ in range(40)})
    want = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), n).collect()
    at = {f: k for k, f in enumerate(fps)}
    assert union(len(fps), [(at[r.a], at[r.b]) for r in found]) == want
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 3 for r in found)


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 150)] + [tuple(map(int, rng.integers(2000, 2400, 2))) for _ in range(300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    at = {x: k for k, x in enumerate(nodes)}
    want = union(len(nodes), [(at[a], at[b]) for a, b in edges if a != b])
    assert got == {x: nodes[want[at[x]]] for x in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_emits_only_spanning_links():
    f = blocks.Forest(100)
    for shift in range(1, 100):
        f.add(np.arange(100 - shift), np.arange(shift, 100))
    assert len(f.links()[0]) == 99 and (f.label == 0).all()


# embeddings


def check_vectors(spark, vectors, ids=None):
    ids = list(range(len(vectors))) if ids is None else ids
    df = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<float>")
    got = embeddings.near_vectors(df).collect()
    good = [k for k, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = {k: np.array(vectors[k], np.float32).astype(float) for k in good}
    u = {k: x / np.linalg.norm(x) for k, x in u.items()}
    links = [(a, b) for a in good for b in good if a < b and len(u[a]) == len(u[b]) and u[a] @ u[b] >= 0.95]
    n = Counter(x for e in links for x in e)
    comp = union(len(vectors), links)
    least = {}
    for k, c in enumerate(comp):
        least[c] = min((x for x in (least.get(c), ids[k]) if x is not None), default=None)
    want = Counter((ids[k], n[k], least[comp[k]], ids[k] == least[comp[k]]) for k in range(len(vectors)))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 16))
    near = [(base[k % 4] + 0.02 * rng.standard_normal(16)).tolist() for k in range(90)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 0.0], [1.0, 0.01], [2.0, 0.0]]
    rows = [*base.tolist(), *near, *near[:20], *(np.array(near[0]) * 3).reshape(1, -1).tolist(), *odd]
    check_vectors(spark, rows)
    check_vectors(spark, [near[0], near[0], near[4]], [None, 5, None])
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    check_vectors(spark, near)
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    u = embeddings.unit(np.array([r.embedding for r in rows]))
    true = (u @ u.T >= 0.95).sum() - len(rows)
    assert sum(r.n_links for r in embeddings.near_vectors(df).collect()) >= 0.9 * true


# pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs.count()
    for name, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert 0 < docs.count() <= seen
        seen = docs.count()
    want = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert Counter(r.doc_id for r in pipeline.run(spark, sf_dir).collect()) == want


def test_pipeline_stages_on_edge_cases(spark, sf_dir, edge_docs, no_docs):
    import corpus_pipeline as pipeline

    for name, stage in pipeline.STAGES:
        for docs in (edge_docs, no_docs):
            out = stage(spark, docs, sf_dir)
            if name != pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
            assert out.count() <= 3 * docs.count() + 9, name

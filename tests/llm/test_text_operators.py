"""Token counts, BPE, language-model scores, quality rules and toxicity."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as T
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitchline.llm import bpe, common, quality, scoring, token_counts, toxicity

PIECES, WORDS = T.path("piece_bpe_32k.model"), T.path("word_bpe_49k.json")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    t.no_padding()
    t.no_truncation()
    return t


# token counts


def test_token_counts_equal_the_library(spark, sf_dir, texts):
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = rows(token_counts.op1_token_counts(spark, sf_dir))
    for i, t in texts.items():
        n = len(m.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096)


def test_every_prefix_count(spark):
    m, c = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.counter(PIECES)
    rng = random.Random(5)
    parts = ["the ", "  ", "ing", "\n", "▁", "é", "日", "12", "idiot", "\x00", "aaa", "<s>", " ", "x"]
    for _ in range(150):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert c.at_prefixes(t) == [len(m.encode(t[:k])) for k in range(len(t) + 1)]
        assert c.counts([t]) == [len(m.encode(t))]
    df = spark.createDataFrame([(1, "the quick brown fox"), (2, None)], "doc_id long, text string")
    cut = {r.doc_id: r.n_chars for r in token_counts.within_budget(token_counts.prefix_token_counts(df, PIECES), 2).collect()}
    assert cut[2] == 0 and len(m.encode("the quick brown fox"[: cut[1]])) <= 2 < len(m.encode("the quick brown fox"[: cut[1] + 1]))


def test_longest_prefix_within_the_limit(spark):
    m, c = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.counter(PIECES)
    rng = random.Random(7)
    parts = ["the ", "  ", "ing", "\n", "▁", "é", "日", "12", "idiot", "\x00", "aaa", "<s>", " ", "x"]
    for _ in range(80):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        for limit in (0, 1, 3, 6):
            want = max(k for k in range(len(t) + 1) if len(m.encode(t[:k])) <= limit)
            assert c.counts_and_cuts([t], limit) == [(len(m.encode(t)), want)], (t, limit)


def test_token_count_edges(spark, edge_docs, no_docs):
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.token_counts(edge_docs, PIECES).collect()
    want = Counter((r.doc_id, len(m.encode(r.text or ""))) for r in edge_docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(no_docs, PIECES).count() == 0


# BPE


def test_bpe_equals_the_library(spark, sf_dir, texts, library):
    got = rows(bpe.op3_bpe(spark, sf_dir))
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edges(spark, edge_docs, no_docs, library):
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_decode(edge_docs, WORDS, with_ids=True).collect())
    want = []
    for r in edge_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    assert got == Counter(want)
    assert bpe.encode_decode(no_docs, WORDS).count() == 0


def test_merge_rounds_on_random_words(library):
    e, rng = bpe.encoder(WORDS), random.Random(2)
    for _ in range(400):
        t = "".join(rng.choice(["aa", "a", "th", "'re", "\x85", "é", "ΑΣ", "İ", "7", " ", "!!", "<|startoftext|>", "é", "日"]) for _ in range(rng.randint(0, 10)))
        assert e.encode(t) == library.encode(t, add_special_tokens=False).ids
        assert e.decode(e.encode(t)) == library.decode(e.encode(t), skip_special_tokens=False)


def test_long_words_equal_the_library_in_time(library):
    import time

    e, rng = bpe.encoder(WORDS), random.Random(6)
    for t in ("a" * 3000, "ab" * 2000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "hello" * 500 + " x " + "é日" * 400):
        ids = library.encode(t, add_special_tokens=False).ids
        assert e.encode(t) == ids and e.decode(ids) == library.decode(ids, skip_special_tokens=False)
    began = time.perf_counter()
    e.encode("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000)))
    assert time.perf_counter() - began < 20


# language model


def brute_scores(docs):
    """[(id, text)] -> [(id, tokens, known, N, base, score)] and the conditional P."""
    tokens = lambda t: [*"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split(), None]
    triples, uni = Counter(), Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1:
            x = tokens(t)
            uni.update(x)
            s = [0, 0, *x]
            triples.update(zip(s, s[1:], s[2:]))
    pairs = Counter()
    for (u, v, w), c in triples.items():
        pairs[v, w] += c if v == 0 else 1
    left = Counter(w for _, w in pairs)
    n, v_all, total = sum(uni.values()), len(uni), len(pairs)

    def contexts(counts):
        out = defaultdict(lambda: [0, 0, 0, 0])
        for k, c in counts.items():
            out[k[:-1]][0] += c
            out[k[:-1]][min(c, 3)] += 1
        return out

    ctx3, ctx2 = contexts(triples), contexts(pairs)
    seen = lambda z: [sum(x == k for x in z) for k in (1, 2, 3, 4)]
    d3, d2, d1 = ([0, *scoring.discounts(seen(z.values()))] for z in (triples, pairs, left))
    share = sum(d1[min(x, 3)] for x in left.values()) / total if total else 1.0

    def one(w):
        return (left[w] - d1[min(left[w], 3)]) / total + share / (v_all + 1) if total else 1 / (v_all + 1)

    def longer(counts, ctx, d, key, lower):
        if key[:-1] not in ctx:
            return lower
        t, c = ctx[key[:-1]], counts.get(key, 0)
        return (c - d[min(c, 3)]) / t[0] + sum(d[k] * t[k] for k in (1, 2, 3)) / t[0] * lower

    def p(u, v, w):
        return longer(triples, ctx3, d3, (u, v, w), longer(pairs, ctx2, d2, (v, w), one(w)))

    out = []
    for i, t in docs:
        x = tokens(t)
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v_all + 1))) for w in x)
        s = [0, 0, *x]
        out.append((i, len(x), sum(uni[w] > 0 for w in x), n, base, sum(math.log10(p(*z)) for z in zip(s, s[1:], s[2:]))))
    return out, p, left, ctx3


def test_scores_equal_brute_force(spark, sf_dir, texts):
    want, p, left, ctx = brute_scores(list(texts.items()))
    got = rows(scoring.op8_scoring(spark, sf_dir))
    for i, n, known, train, base, score in want:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, train, zlib.crc32(str(i).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(score, abs=1e-6)
    for a in [*list(ctx)[:3], (b"the", b"never seen"), (b"never seen", 0)]:
        assert sum(p(*a, w) for w in [*left, b"never seen"]) == pytest.approx(1)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_score_edges(spark, edge_docs, no_docs):
    from pyspark.sql import functions as F

    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    want = Counter((i, n, round(b, 5), round(s, 5)) for i, n, _, _, b, s in brute_scores(docs)[0])
    lower = edge_docs.select("doc_id", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("text"))
    model = scoring.train(lower.where(scoring.id_crc_mod5(F.col("doc_id")) != 1))
    got = Counter((r.doc_id, r.n_tokens, round(r.base_score, 5), round(r.score, 5)) for r in scoring.score(lower, model).collect())
    assert got == want
    nothing = scoring.train(no_docs.select("text"))
    assert all(r.score == 0 and r.base_score == 0 for r in scoring.score(lower.where("doc_id = 3"), nothing).collect())
    assert scoring.score(no_docs.select("doc_id", "text"), model).count() == 0


def test_scores_do_not_depend_on_cells(spark, texts, monkeypatch):
    """Many cells and many frequent words give the same scores."""
    monkeypatch.setattr(scoring, "CELL_BYTES", 5000)
    monkeypatch.setattr(scoring, "frequent", lambda *_: np.array([scoring.xxhash.xxh64_intdigest(w) for w in (b"the", b"of", b"a", b"and", b"w1")] + [int(scoring.BEGIN)], np.uint64))
    docs = list(texts.items())[:80]
    df = spark.createDataFrame([(i, scoring_lower(t)) for i, t in docs], "doc_id long, text string").repartition(3)
    model = scoring.train(df.where(scoring.id_crc_mod5(scoring.F.col("doc_id")) != 1).select("text"))
    assert model.where.cells > 20
    got = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in scoring.score(df, model).collect()}
    for i, n, known, _, base, score in brute_scores(docs)[0]:
        assert got[i][:2] == (n, known) and got[i][2:] == pytest.approx((base, score), abs=1e-6)


def scoring_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_hash_arrays():
    rng = np.random.default_rng(3)
    for n in (1, 5, 1000, 70_000):
        key = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        value = rng.choice([1, 2, 3, 254, 255, 256, 10**10], n)
        rows = np.stack([value, rng.integers(0, 3, n), rng.integers(0, 300, n), rng.integers(0, 2, n)], axis=1)
        arrays, order = scoring.hash_array("x", key)
        arrays |= scoring.counts_array("x", value[order]) | scoring.sums_array("y", rows[order])
        at, hit = scoring.find(arrays, "x", key)
        assert hit.all() and (scoring.read_counts(arrays, "x", at) == value).all() and (scoring.read_sums(arrays, "y", at) == rows).all()
        assert not scoring.find(arrays, "x", rng.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2) + np.uint64(1))[1].any()


# quality


def brute_quality(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    twice = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice)


def test_quality_counts_equal_brute_force(spark, sf_dir, texts):
    got = rows(quality.op9_quality_rules(spark, sf_dir))
    for i, t in texts.items():
        r, want = got[i], brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed and (r.threshold is None or r.score >= r.threshold))


def test_quality_keeps_good_and_drops_bad(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in quality.op9_quality_rules(spark, d).collect() if r.doc_id in labels and not r.base_failed]
    good, bad = ([r.kept for r in got if labels[r.doc_id] == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_quality_ratio_and_edges(spark, edge_docs, no_docs, no_labels):
    got = quality.quality_rules(edge_docs, no_labels).collect()
    assert Counter((r.doc_id, r.n_words, r.n_repeat_words) for r in got) == Counter((r.doc_id, brute_quality(r.text)[0], brute_quality(r.text)[4]) for r in edge_docs.collect())
    assert all(r.kept != r.base_failed for r in got)
    kept = quality.kept_documents(edge_docs, no_labels)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.quality_rules(no_docs, no_labels).count() == 0
    docs = spark.createDataFrame([(k, " ".join((["good"] if k % 3 else ["bad"]) * 3 + [f"w{k}{j}" for j in range(9)])) for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(150)], "doc_id long, quality int, toxic int")
    ratio, cut = quality.fit(docs, labels)
    sample = {r.doc_id: r.quality for r in quality.labelled_sample(labels).where("fold = 0").collect()}
    raw, target = (np.full(quality.BUCKETS, quality.SMOOTHING) for _ in range(2))
    hashes = quality.WordHashes()
    for r in docs.collect():
        n = np.bincount(quality.features(hashes.of(r.text.encode().split())), minlength=quality.BUCKETS)
        raw += n
        target += n * (sample.get(r.doc_id) == 1)
    assert np.allclose(ratio, np.log(target / target.sum()) - np.log(raw / raw.sum()))
    out = quality.quality_rules(docs, labels).collect()
    assert np.mean([r.kept == (r.doc_id % 3 > 0) for r in out]) > 0.95


def brute_threshold(good, bad):
    values = sorted({*good, *bad})
    cuts = [(values[0] - 1.0, 0.0), *(((x + y) / 2, y - x) for x, y in zip(values, values[1:]))]
    gain = lambda c: len(good) * sum(x < c for x in bad) - 5 * len(bad) * sum(x < c for x in good)
    most = max(gain(c) for c, _ in cuts)
    return max(((gap, -c) for c, gap in cuts if gain(c) == most))[1] * -1


def test_quality_threshold_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    for n, steps in ((400, 1000), (300, 7), (60, 1), (2, 50)):
        data = [(float(np.round(rng.normal(k % 2, 1) * steps) / steps), k % 2) for k in range(n)]
        good, bad = ([x for x, q in data if q == y] for y in (1, 0))
        got = quality.threshold(spark.createDataFrame(data, "score double, quality int").repartition(5))
        assert got == pytest.approx(brute_threshold(good, bad), abs=1e-12)
    assert quality.threshold(spark.createDataFrame([(0.5, 1)], "score double, quality int")) is None


@pytest.mark.parametrize("broadcast", [250_000, 0])
def test_quality_learns_from_every_labelled_row(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    n = 41_500  # more than were once taken
    ids = spark.range(n).select(F.col("id").alias("doc_id"))
    word = F.expr("CASE WHEN doc_id % 3 > 0 THEN 'good fine' ELSE 'bad poor' END")
    docs = ids.select("doc_id", F.concat_ws(" ", word, F.lit("a b c d e f g h"), F.concat(F.lit("w"), F.col("doc_id") % 50)).alias("text"))
    docs = docs.unionByName(docs.where("doc_id < 3")).unionByName(spark.createDataFrame([(None, "good"), (10**9, "bad")], "doc_id long, text string"))  # repeats, no id, no label
    labels = ids.select("doc_id", F.expr("int(doc_id % 3 > 0)").alias("quality"))
    labels = labels.unionByName(spark.createDataFrame([(10**10, 1), (None, 1), (10**9, None)], "doc_id long, quality int"))
    fold = {r.doc_id: r.fold for r in quality.labelled_sample(labels).collect()}
    assert len(fold) == n + 1
    hashes = quality.WordHashes()
    raw, target = (np.full(quality.BUCKETS, quality.SMOOTHING) for _ in range(2))
    for i, text in docs.collect():
        cells = quality.features(hashes.of(text.encode().split()))
        np.add.at(raw, cells, 1)
        if i is not None and i < n and fold[i] == 0 and i % 3 > 0:
            np.add.at(target, cells, 1)
    ratio, cut = quality.fit(docs, labels)
    assert np.allclose(ratio, np.log(target / target.sum()) - np.log(raw / raw.sum()), rtol=1e-12, atol=1e-12)
    scores = {(i, float(ratio[quality.features(hashes.of(text.encode().split()))].mean())) for i, text in docs.collect() if fold.get(i) == 1}
    good, bad = (sorted({s for i, s in scores if (i % 3 > 0) == y}) for y in (True, False))
    assert bad[-1] < cut < good[0] and cut == pytest.approx((bad[-1] + good[0]) / 2, abs=1e-12)


# toxicity


@pytest.fixture(scope="module")
def learned(spark):
    d = "/root/testdata/sf0.01"
    return toxicity.Scorer(*toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")))


@pytest.mark.parametrize("text", ["you 1d10t", "a m0r0n", "c l o w n", "idiooooot", "l.o.s.e.r", "tra5h", "w o r t h l e s s", "PATH3TIC!!", "m-o-r-o-n", "!diot", "idi0+", "iiddiioott", "c  l  o  w  n", "c,\tl, o, w,\nn"])
def test_disguises_are_seen_through(learned, text):
    assert learned.text(text) > 0


@pytest.mark.parametrize("text", ["", "the house", "dd93acb406f036cedd", "of%%% the&&&", "rrrr", "llll", "a a a a a", "12 34 56", "mail7@example.com", "committee", "THE!! A!! IN!!"])
def test_clean_texts_stay_clean(learned, text):
    assert learned.text(text) < 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in toxicity.op10_toxicity(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    hit, false = (np.mean([r.predicted for r in got if labels[r.doc_id] == t]) for t in (1, 0))
    assert hit > 0.85 and false < 0.02  # some junk texts are labelled toxic


def test_no_spaced_span_is_passed_over():
    rng = random.Random(4)
    for _ in range(50_000):
        text = "".join(rng.choices("aé漢𝒳ß .-1@$!|,~x\nZ", k=rng.randint(0, 14)))
        assert toxicity.may_be_spaced(text) or not toxicity._SPACED.search(text), text


def test_scores_do_not_depend_on_what_was_cached(learned, monkeypatch):
    texts = ["you 1d10t of the house", "a m0r0n and !diot", "the house of worthless men", "x" * 100 + " idiooooot", "", "c l o w n"] * 3
    fresh = [toxicity.Scorer.text(learned, t) for t in texts]
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 4)
    assert [learned.text(t) for t in texts] == fresh


def test_lattice_decoding_equals_brute_force(learned):
    """Viterbi's reading is at least as likely as any other path of the lattice."""
    from itertools import product

    m = learned.model

    def likelihood(path):
        x, y, s = 0, 0, sum(c for _, c in path)
        for ch in "".join(r for r, _ in path):
            k = 0 if ch == " " else toxicity.CLASS.get(ch, 1)
            if k == 0 and y == 0:
                continue
            s += m.log[x][y][k]
            x, y = (0, 0) if k == 0 else (y, k)
        return s

    for span in ("1d10t", "m0r0n", "tra5h", "a c l o w"):
        best = max(product(*m.lattice(span), [(" ", 0.0)]), key=likelihood)
        assert "".join(r for r, _ in best).strip() == m.restore(span)


def test_toxicity_edges(spark, edge_docs, no_docs, no_labels):
    got = toxicity.toxicity(edge_docs, no_labels).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score < 0.5 and r.predicted == 0 for r in got)
    assert toxicity.clean_documents(edge_docs, no_labels).columns == edge_docs.columns
    assert toxicity.toxicity(no_docs, no_labels).count() == 0


def test_near_copies_teach_once():
    signed = [(1, [7, 8]), (2, [8, 9]), (3, [1, 2]), (4, [9, 5])]
    assert toxicity.firsts(signed) == {1, 3}


def test_marks_and_ratios_equal_brute_force(spark):
    """What training learns, from plain counts, and a text's score from what is learned."""
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("re", "su", "ta", "vo") for c in ("n", "rt", "lle", "x")]
    data = []
    for k in range(400):
        own = [rng.choice(words) for _ in range(25)]
        if k % 4 == 0:
            own[rng.randrange(25)] = rng.choice(["grobian", "flegel"])
        data.append((k, " ".join(own), int(k % 4 == 0)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in data], "doc_id long, quality int, toxic int")
    model, odds, ratio = toxicity.train(docs, labels)
    teach = [(set(t.split()), y) for k, t, y in data if zlib.crc32(str(k).encode()) % 5]
    seen, toxic = Counter(), Counter()
    for own, y in teach:
        for f in {f for w in own for f in toxicity.features(w)}:
            seen[f] += 1
            toxic[f] += y
    base = sum(y for _, y in teach) / len(teach)
    prior = toxicity.MARKS_EXPECTED / len(seen)
    want = {}
    for f, n in seen.items():
        right = toxicity.MARK_PRECISION
        o = math.log(prior / (1 - prior)) + toxic[f] * math.log(right / base) + (n - toxic[f]) * math.log((1 - right) / (1 - base))
        if o > 0 and toxic[f] >= toxicity.LEAST_PRECISION * n:
            want[f] = min(o, 12.0)
    assert odds == pytest.approx(want) and {"grobian", "flegel"} <= set(odds)
    cells = defaultdict(lambda: [0, 0])
    for f in seen:
        if not f.endswith("~"):
            cells[toxicity.bucket(f)][0] += seen[f]
            cells[toxicity.bucket(f)][1] += toxic[f]
    for k, (n, n1) in cells.items():
        share = (n1 + toxicity.BUCKET_PRIOR * base) / (n + toxicity.BUCKET_PRIOR)
        assert ratio[k] == pytest.approx(math.log(share / base) - math.log((1 - share) / (1 - base)))
    assert np.count_nonzero(ratio) <= len(cells)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    for k, t, y in data:
        strengths = sorted((max(odds.get(f, -1) for f in toxicity.features(w)) for w in set(t.split())), reverse=True)
        strengths = [x for x in strengths if x > 0]
        mean = np.mean([ratio[toxicity.bucket(w)] for w in set(t.split())])
        x = strengths[0] + toxicity.MORE * sum(strengths[1:]) if strengths else min(max(toxicity.NO_MARK + toxicity.GRADE * mean, toxicity.LOWEST), toxicity.HIGHEST)
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-x))) and got[k].predicted == y


def test_long_spans_take_time_in_proportion(learned):
    import time

    def took(text):
        began = time.perf_counter()
        learned.text(text)
        return time.perf_counter() - began

    for unit in ("a1", "q ", "7 "):
        assert took(unit * 64_000) < 12 * took(unit * 8_000) + 1
    assert took("a" + "!" * 300_000 + "b") < 5

"""Quality rules: hashed n-gram log-likelihood ratio between the multinomial of
trusted documents and that of the whole corpus, length-normalised, with one
threshold for every document, besides exact counts of repetition and symbols.

Passes over whole texts, each one narrow Arrow map: hashed words and word pairs are
counted (raw corpus: all rows; target: all trusted rows) into ``BUCKETS`` cells, summed
by Spark, at most ``BUCKETS`` rows to the driver; then texts are scored. Labels are
used whole: by hash of the id one half of all labelled documents teaches the target,
and all documents of the other half set the threshold. Labelled ids are met by
:func:`labelled_texts`, never collected, and the threshold is found in Spark.

Defined cases: null or empty text has no words, so ``base_failed``; rows that
repeat are judged alike; a null id is kept as null; without labels (empty, or one
class only) the ratio decides nothing and ``kept`` is ``not base_failed``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import ranged
from . import common
from .common import WordHashes, joined, paired, release, staged, table, texts_of, tidied

BUCKETS = 1 << 14
#: Words of 64 bits in the filter of labelled ids (2 MB of bits).
FILTER_WORDS = 1 << 18
#: What a good document weighs in the threshold, against a bad one.
GOOD_WEIGHT = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
SMOOTHING = 0.5
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"


def repeated_words(h: np.ndarray) -> int:
    """Words in windows of five words that occur twice or more, the first included."""
    if len(h) <= WINDOW:
        return 0
    n = len(h) - WINDOW + 1
    w = h[:n]
    for k in range(1, WINDOW):
        w = paired(w, h[k : k + n])
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    if not len(starts):
        return 0
    edge = np.zeros(len(h) + 1, np.int32)
    edge[starts] += 1
    np.subtract.at(edge, starts + WINDOW, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines (split at \\n) with a word, equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def features(h: np.ndarray) -> np.ndarray:
    """Cells of the words and of the word pairs."""
    mask = np.uint64(BUCKETS - 1)
    return np.concatenate([h & mask, paired(h[:-1], h[1:]) & mask]).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, total = WordHashes(), np.zeros(BUCKETS, np.int64)
    for b in batches:
        for text in texts_of(b.column(0)):
            total += np.bincount(features(hashes.of(text.split())), minlength=BUCKETS)
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["cell", "n"])


def cells(texts: DataFrame) -> np.ndarray:
    """Smoothed counts of each cell over the whole of ``text``."""
    found = texts.select("text").mapInArrow(tidied(_counts), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most BUCKETS rows
    out = np.full(BUCKETS, SMOOTHING)
    for c in found:
        out[c.cell] += c.n
    return out


def _scorer(ratio: np.ndarray | None) -> Callable:
    """Adds to (doc_id, text) the counts and the length-normalised ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            n, chars, symbols, lines, repeats, score = [], [], [], [], [], []
            for text in texts_of(b.column(1)):
                h = hashes.of(text.split())
                n.append(len(h))
                chars.append(len(text.decode("utf-8", "replace")) - sum(text.count(c) for c in BLANKS))
                symbols.append(sum(text.count(c) for c in SYMBOLS))
                lines.append(duplicate_lines(text))
                repeats.append(repeated_words(h))
                score.append(float(ratio[features(h)].mean()) if ratio is not None and len(h) else 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (n, chars, symbols, lines, repeats)), pa.array(score, pa.float64())],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"],
            )

    return run


SCORED = "doc_id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def labelled_folds(labels: DataFrame) -> DataFrame:
    """Every labelled id once. By hash of the id ``fold`` 0 teaches the target, 1 sets the
    threshold."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return one.select("doc_id", "quality", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold"))


#: Earlier name; nothing is sampled any more.
labelled_sample = labelled_folds


def labelled_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with an id in ``rows`` (staged, unique by doc_id), with the
    columns of ``rows``. Few ids are broadcast. Of many, a filter of fixed size goes
    ahead: it lets all their texts pass and, the more ids there are, some others; only
    those texts are shuffled, and the join is exact."""
    if rows.count() > common.BROADCAST_ROWS:
        word, bit = (F.expr(x) for x in (f"pmod(shiftright(xxhash64(doc_id), 6), {FILTER_WORDS})", "shiftleft(1L, cast(xxhash64(doc_id) & 63 AS int))"))
        bits = rows.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))  # at most FILTER_WORDS rows
        flagged = docs.select("doc_id", "text", word.alias("at"), bit.alias("bit"))
        docs = flagged.join(F.broadcast(bits), (F.col("at") == F.col("word")) & (F.col("bit").bitwiseAND(F.col("bits")) != 0), "left_semi").select("doc_id", "text")
    return joined(docs, rows, ["doc_id"], "inner", salt=F.xxhash64("text"))


def threshold(seen: DataFrame) -> float | None:
    """The cut of (score, quality 0 or 1, a row for each document) with the most balanced
    accuracy; good documents weigh five times, and of equal cuts the middle of the
    widest gap counts. None without both kinds. No task holds more than a range of the
    distinct scores."""
    values = seen.groupBy("score").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("good"), F.count(F.when(F.col("quality") == 0, 1)).alias("bad"))
    values = ranged(values, ["score"], "scores")
    parts = values.groupBy("_part").agg(F.sum("good").alias("p_good"), F.sum("bad").alias("p_bad"), F.max("score").alias("p_last"))  # a row for each range
    total = parts.agg(F.sum("p_good").alias("good"), F.sum("p_bad").alias("bad")).first()
    if not total.good or not total.bad:
        release(values)
        return None
    whole = Window.orderBy("_part")
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("p_good", "p_bad")), F.lag("p_last").over(whole).alias("p_last"))
    inside = Window.partitionBy("_part").orderBy("score")
    lesser = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = values.select("_part", "score", *(F.coalesce(F.sum(c).over(lesser), F.lit(0)).alias(c) for c in ("good", "bad")), F.lag("score").over(inside).alias("last"))
    rows = rows.join(F.broadcast(parts), "_part")
    below = {c: (F.col(c) + F.col(f"p_{c}")).cast("decimal(18,0)") for c in ("good", "bad")}
    gain = below["bad"] * F.lit(total.good).cast("decimal(18,0)") - F.lit(GOOD_WEIGHT) * below["good"] * F.lit(total.bad).cast("decimal(18,0)")
    last = F.coalesce("last", "p_last")
    middle = (last + F.col("score")) / 2
    cut = F.when(last.isNull(), F.col("score") - 1.0).when(middle > last, middle).otherwise(F.col("score"))
    best = rows.select(F.struct(gain.alias("gain"), F.coalesce(F.col("score") - last, F.lit(0.0)).alias("gap"), (-F.col("score")).alias("low"), cut.alias("cut")).alias("x")).agg(F.max("x").alias("x")).first().x
    release(values)
    return float(best.cut)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray | None, float | None]:
    """The log ratio of each cell and the threshold; None where labels don't tell."""
    own = docs.select("doc_id", "text")
    known = labelled_folds(labels.select(F.col("doc_id").try_cast(own.schema["doc_id"].dataType).alias("doc_id"), "quality"))
    trusted = staged(known.where("fold = 0 AND quality = 1").select("doc_id"), "trusted")
    held = staged(known.where("fold = 1 AND quality IN (0, 1)").select("doc_id", "quality"), "held")
    try:
        if trusted.isEmpty() or held.agg(F.count_distinct("quality")).first()[0] < 2:
            return None, None
        raw, target = cells(own), cells(labelled_texts(own, trusted))
        ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
        texts = labelled_texts(own, held).select(F.struct("doc_id", "quality").alias("doc_id"), "text")
        seen = texts.mapInArrow(tidied(_scorer(ratio)), SCORED.format(id=texts.schema["doc_id"].dataType.simpleString()))
        seen = seen.where(f"n_words >= {MIN_WORDS}").groupBy("doc_id").agg(F.max("score").alias("score")).select("score", "doc_id.quality")
        cut = threshold(seen)
        return (None, None) if cut is None else (ratio, cut)
    finally:
        release(trusted)
        release(held)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score,
    threshold, base_failed, kept) for each row of ``docs`` (doc_id, text)."""
    ratio, cut = fit(docs, labels)
    own = docs.select("doc_id", "text")
    scored = own.mapInArrow(tidied(_scorer(ratio)), SCORED.format(id=own.schema["doc_id"].dataType.simpleString()))
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED_PERCENT) * F.col("n_words"))
    verdict = F.lit(True) if cut is None else F.col("score") >= F.lit(cut)
    return scored.select("*", F.lit(cut).cast("double").alias("threshold"), failed.alias("base_failed"), (~failed & verdict).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    ratio, cut = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            keep = []
            for text in texts_of(b.column("text")):
                h = hashes.of(text.split())
                good = len(h) >= MIN_WORDS and 100 * repeated_words(h) <= MAX_REPEATED_PERCENT * len(h)
                keep.append(good and (cut is None or float(ratio[features(h)].mean()) >= cut))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "threshold")

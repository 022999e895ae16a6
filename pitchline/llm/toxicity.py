"""Toxicity by noisy-channel deobfuscation.

A clean word may reach the text through a channel that writes digits and signs for
letters, repeats letters, or puts blanks and dots between letters. Suspicious spans
(signs inside words, letters three times in a row, runs of single letters) become
lattices of what each character may stand for, and Viterbi finds the likeliest clean
words under a character trigram model. The restored text is scored.

Character model: trigrams of the whole corpus, mixed with those of the learned words,
over 64 character classes, so at most 2^18 counts whatever the corpus. A span is read
from left to right with back pointers; what all open readings agree on is settled at
once, and after ``OPEN`` characters the best reading so far is, so a span of any length
takes time in proportion.

Score: words and their first four to six letters are features; each has two readings,
"marks toxic texts" and "has no bearing", weighed by the labelled texts with and without
it, with a prior of few marks among all features seen. A mark must also be right in
``LEAST_PRECISION`` of the texts that hold it. With a mark, the log odds are those of
the strongest marked word and ``MORE`` of what the other marked words have. Without one
they start at ``NO_MARK`` and move by ``GRADE`` times the mean log likelihood ratio of
the text's words (hashed into ``BUCKETS``), within bounds that keep the text clean.

Labels come only from rows whose crc32 of the id modulo 5 is not 0, at most
``MAX_LABELLED`` of them, those of the smallest hashes; near copies among these teach
once, else the rare words of one much-copied toxic text would be marks. Neither
labels, language, source nor id enter a score.

Defined cases: null and empty texts have no features and get the score of ``NO_MARK``;
rows that repeat are scored alike; null ids teach nothing; without labels nothing is
toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_WORDS, WordHashes, id_crc_mod5, mixed, paired, release, staged, table, texts_of, tidied

MAX_LABELLED = 40_000
#: Of toxic texts that hold a mark, and of marks among the features seen.
MARK_PRECISION = 0.97
LEAST_PRECISION = 0.93
MARKS_EXPECTED = 20.0
PREFIXES = (4, 5, 6)
NO_MARK = -4.0
#: Of the other marked words' odds; of a mean log ratio, and how far that moves a text.
MORE, GRADE, LOWEST, HIGHEST = 0.1, 4.0, -7.0, -1.0
BUCKETS = 1 << 16
#: Smoothing of a bucket: so many texts of the usual share of toxic ones.
BUCKET_PRIOR = 4.0
#: Characters of a span whose reading may stay open.
OPEN = 512
CLASSES = 64
#: Near copies: triples of words, bands of least hashes.
BANDS, BAND_ROWS = 8, 4
LEXICON_SHARE = 0.5

# What a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "(": "c", "<": "c", "£": "l", "*": "aeiou", "#": "aeiou",
}
SEPARATORS = " .-_*'~,\t\n\r"
COST_SIGN, COST_WILD, COST_DROP, COST_JOIN, COST_SPLIT, COST_REPEAT = -1.0, -2.5, -5.0, -0.2, -1.5, -0.6

_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüÿßœ"
CLASS = {c: k for k, c in enumerate(_LETTERS, 2)}  # 0: no letter (a word's edge), 1: other letters
_TABLE = np.zeros(0x110000, np.uint8)


def _fill() -> None:
    for c, k in CLASS.items():
        _TABLE[ord(c)] = _TABLE[ord(c.upper()) if len(c.upper()) == 1 else ord(c)] = k
    for lo, hi in ((0x100, 0x24F), (0x370, 0x52F), (0x530, 0x2000), (0x3040, 0xD7FF)):
        part = _TABLE[lo:hi]
        part[part == 0] = 1


_fill()

_FIRST, _LAST = regex.compile(r"[\p{L}\p{N}@$]"), regex.compile(r"(?r)[\p{L}\p{N}]")
#: Letters one by one, up to three separators between them.
_UNIT = r"[\p{L}0-9@$!|][ .\-_*'~,\t\n\r]{1,3}"
_SPACED = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{_UNIT}){{2,}}[\p{{L}}0-9@$!|](?![\p{{L}}\p{{N}}])")
_HEAD, _TAIL = regex.compile(_UNIT), regex.compile(r"[ .\-_*'~,\t\n\r]{1,3}[\p{L}0-9@$!|]$")
_SIGNS = regex.compile(r"[0-9@$!|+€(<£*#.\-_'~]")
_THRICE = regex.compile(r"(\p{L})\1\1")
_DOUBLED = regex.compile(r"(\p{L})\1")
_TWICE = re.compile(r"(.)\1", re.DOTALL)
_LETTER = regex.compile(r"\p{L}")
#: A sign for a letter at a word's edge: one or two of a kind, but two ! are stress.
_EDGE_SIGN = regex.compile(r"^(?:!(?!!)|([|(<£€+*#0-9])(?!\1\1))|(?<!!)!$|([@$|+€(<£*#])(?<!\2\2\2)$")
PLAIN_EDGES = ".,;:?\"'()[]{}-_~`´’“”«»…"
#: Letters of a span beside which a word of one letter may stand.
SHORT_SPAN = 64


#: Kinds of characters: 0 others, 1 separators, 2 signs of a unit, 3 what may be a letter, 4 letters and digits.
_KINDS = np.full(0x110000, 3, np.uint8)
_KINDS[:0x80] = [1 if chr(c) in SEPARATORS else 2 if chr(c) in "@$!|" else 4 * chr(c).isalnum() for c in range(0x80)]
_KINDS[0xC0:0x250] = [4 * chr(c).isalpha() for c in range(0xC0, 0x250)]


def may_be_spaced(text: str) -> bool:
    """False only if ``_SPACED`` finds nothing: no letter or sign stands alone before a
    separator, with another one, a separator on both sides, as near as in one span."""
    kinds = _KINDS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.flatnonzero(kinds[1:] == 1)  # what stands before a separator
    before = kinds[np.maximum(ends - 1, 0)]
    first = (kinds[ends] >= 2) & ((before != 4) | (ends == 0))
    ends, before = ends[first], before[first]
    return bool(((before[1:] == 1) & (np.diff(ends) <= 4)).any())


def core(word: str) -> str:
    """The word from its first letter, digit, @ or $ to its last letter or digit."""
    if word.isalpha():
        return word
    inner = word.strip(PLAIN_EDGES)
    if inner.isalpha():
        return inner
    first = _FIRST.search(word)
    last = _LAST.search(word)
    if first is None:
        return ""
    return word[first.start() : last.end() if last is not None and last.end() > first.start() else first.start()]


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}~" for k in PREFIXES if len(word) > k)]


class CharModel:
    """Log probabilities of a character class after two others, and lattice decoding."""

    def __init__(self, counts: np.ndarray, lexicon: list[str]):
        own = np.zeros(CLASSES**3)
        for w in lexicon:
            c = np.concatenate([[0, 0], codes(w), [0]]).astype(np.int64)
            np.add.at(own, c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], 1.0)
        p = (1 - LEXICON_SHARE) * self.smooth(counts) + LEXICON_SHARE * self.smooth(own) if own.any() else self.smooth(counts)
        self.log = np.log(p).reshape(CLASSES, CLASSES, CLASSES).tolist()

    @staticmethod
    def smooth(counts: np.ndarray) -> np.ndarray:
        """Interpolated with the shorter contexts, as Witten and Bell weigh them."""
        three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p = (one + 0.5) / (one.sum() + 0.5 * CLASSES)
        for c in (two, three):
            kinds, n = (c > 0).sum(axis=-1, keepdims=True), c.sum(axis=-1, keepdims=True)
            p = np.where(n > 0, (c + kinds * p) / np.maximum(n + kinds, 1), p)
        return p

    def lattice(self, span: str) -> list[list[tuple[str, float]]]:
        """For each character (or run of one letter) its readings, with their cost."""
        out, k = [], 0
        while k < len(span):
            c = span[k]
            run = 1
            while k + run < len(span) and span[k + run] == c:
                run += 1
            if c in STANDS_FOR and c not in SEPARATORS:
                cost = COST_WILD if len(STANDS_FOR[c]) > 2 else COST_SIGN
                out += [[(x, cost) for x in STANDS_FOR[c]] + [("", COST_DROP)]] * min(run, 2)
                out += [[("", 0.0)]] * (run - min(run, 2))
            elif c in SEPARATORS:
                wild = [(x, COST_WILD) for x in STANDS_FOR.get(c, "")] if run == 1 else []
                out.append([("", COST_JOIN), (" ", COST_SPLIT), *wild])
            elif run >= 2 and _LETTER.match(c):
                out.append([(c * n, COST_REPEAT * (n != run)) for n in {1, 2, min(run, 3)}])
            else:
                out += [[(c, 0.0)]] * run
            k += run
        return out

    def restore(self, span: str) -> str:
        """The likeliest clean reading of a lower-case span."""
        log, states = self.log, {(0, 0): 0.0}
        back: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
        done: list[str] = []

        def settle(state: tuple[int, int]) -> None:
            read = []
            for step in reversed(back):
                state, reading = step[state]
                read.append(reading)
            done.extend(reversed(read))
            back.clear()

        for readings in [*self.lattice(span), [(" ", 0.0)]]:
            new: dict[tuple[int, int], float] = {}
            step: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
            for state, score in states.items():
                for reading, cost in readings:
                    x, y = state
                    s = score + cost
                    for ch in reading:
                        k = 0 if ch == " " else CLASS.get(ch, 1)
                        if k == 0 and y == 0:
                            continue  # edges fold into one
                        s += log[x][y][k]
                        x, y = (0, 0) if k == 0 else (y, k)
                    if (x, y) not in new or s > new[x, y]:
                        new[x, y] = s
                        step[x, y] = (state, reading)
            back.append(step)
            states = new
            if len(states) == 1 or len(back) >= OPEN:
                best = max(states, key=states.__getitem__)
                settle(best)
                states = {best: 0.0}
        if back:
            settle(max(states, key=states.__getitem__))
        return "".join(done).strip()


def codes(text: str) -> np.ndarray:
    return _TABLE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def trigrams(text: str) -> np.ndarray:
    """Cells of the trigrams of a text's words, edges in pairs before a word."""
    c = codes(text).astype(np.int64)
    c = np.concatenate([[0], c, [0]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    c = np.insert(c, np.flatnonzero(c == 0), 0)  # two edges before each word
    cells = c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:]
    return cells[(c[1:-1] != 0) | (c[2:] != 0)]


def repeats(word: str) -> bool:
    """A letter three times in a row, or three letters twice."""
    return _TWICE.search(word) is not None and bool(_DOUBLED.search(word)) and bool(_THRICE.search(word) or len(_DOUBLED.findall(word)) >= 3)


def disguised(word: str) -> bool:
    if word.isalpha():
        return repeats(word)
    return bool(_LETTER.search(word)) and bool(_SIGNS.search(word) or repeats(word))


def bucket(word: str) -> int:
    """As Spark's xxhash64 of the word, modulo a power of two."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42) % BUCKETS


class Scorer(dict):
    """Scores of texts, from the character model, the marks' odds and the log likelihood
    ratios of hashed words. As a mapping: a word as it stands to its log ratio, filled on
    demand and bounded."""

    def __init__(self, model: CharModel, odds: dict[str, float], ratio: np.ndarray | None = None):
        super().__init__()
        self.model, self.odds = model, odds
        self.ratio = [0.0] * BUCKETS if ratio is None else ratio.tolist()
        #: First four characters of every mark: other words hold none.
        self.starts = {f[:4] for f in odds}
        #: What the mapping held before it last was full: frequent words come back from there.
        self.older: dict[str, float] = {}
        #: Words of both that are marked, and marks of words too long to keep.
        self.marked: dict[str, float] = {}
        self.marked_words: set[str] = set()
        self.long_marks: list[float] = []
        self.spans: dict[str, str] = {}

    def restored(self, span: str) -> str:
        if len(self.spans) > CACHE_WORDS:
            self.spans.clear()
        out = self.spans.get(span)
        if out is None:
            out = self.model.restore(span)
            if len(span) <= SHORT_SPAN:
                self.spans[span] = out
        return out

    def plain(self, word: str) -> float:
        if word[:4] not in self.starts:
            return NO_MARK
        return max((self.odds.get(f, NO_MARK) for f in features(word)), default=NO_MARK)

    def word(self, raw: str) -> tuple[float, float]:
        """(odds of the strongest feature, log ratio) of a word as it stands."""
        whole = raw if raw.isalpha() else raw.strip(PLAIN_EDGES)
        letters = whole.isalpha()  # then it has no signs
        if letters and whole[:4] not in self.starts and _TWICE.search(whole) is None:
            return NO_MARK, self.ratio[bucket(whole)]
        w = whole if letters else core(whole)
        best, reading = self.plain(w), w
        if best < 0 and disguised(w):
            found = self.restored(w).split()
            best = max([best, *map(self.plain, found)])
            reading = found[0] if len(found) == 1 else w
        if best < 0 and not letters and _EDGE_SIGN.search(whole) and _LETTER.search(whole):
            # a sign at the edge may be a letter or not; only whole words count here
            best = max([best, *(self.odds.get(x, NO_MARK) for x in self.restored(whole).split())])
        return best, self.ratio[bucket(reading)] if reading else 0.0

    def __missing__(self, raw: str) -> float:
        if len(self) >= CACHE_WORDS // 2:
            self.older = dict(self)
            self.clear()
        if (ratio := self.older.get(raw)) is not None:
            self[raw] = ratio
            return ratio
        odds, ratio = self.word(raw)
        if len(raw) > SHORT_SPAN:
            if odds > 0:
                self.long_marks.append(odds)
            return ratio
        if odds > 0:
            self.marked[raw] = odds
            self.marked_words.add(raw)
        self[raw] = ratio
        return ratio

    def text(self, text: str) -> float:
        """Log odds of the restored text."""
        if len(self.marked) > CACHE_WORDS:
            self.clear()
            self.older = {}
            self.marked.clear()
            self.marked_words.clear()
        text = text.lower()
        words = set(text.split())
        self.long_marks.clear()
        total = math.fsum(map(self.__getitem__, words))
        marks = [self.marked[w] for w in words & self.marked_words] + self.long_marks
        if not marks and may_be_spaced(text):
            for m in _SPACED.finditer(text):
                span = m.group()
                if _LETTER.search(span):
                    parts = [span]
                    if len(span) <= SHORT_SPAN:  # a word of one letter may stand beside it
                        parts += [span[_HEAD.match(span).end() :], span[: _TAIL.search(span).start()]]
                    marks += [x for part in parts if (x := max(map(self.plain, self.restored(part).split()), default=NO_MARK)) > 0]
        if marks:
            best = max(marks)
            return best + MORE * (math.fsum(marks) - best)
        return min(max(NO_MARK + GRADE * total / len(words), LOWEST), HIGHEST) if words else NO_MARK

    def clean(self, text: str) -> str:
        """The restored text itself."""
        text = _SPACED.sub(lambda m: self.restored(m.group()) if _LETTER.search(m.group()) else m.group(), text.lower())
        return " ".join(self.restored(core(w)) if disguised(core(w)) else w for w in text.split())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands of least hashes of the texts' word triples: near copies share one."""
    hashes = WordHashes()
    seeds = mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64))
    for b in batches:
        out = []
        for text in texts_of(b.column(1)):
            h = hashes.of(text.lower().split())
            h = paired(paired(h[:-2], h[1:-1]), h[2:]) if len(h) > 2 else h
            low = [int(mixed(h ^ s).min()) if len(h) else 0 for s in seeds]
            out.append([xxhash.xxh64_intdigest(repr((k, low[k * BAND_ROWS : (k + 1) * BAND_ROWS]))) >> 1 for k in range(BANDS)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "bands"])


def firsts(signed: list[tuple]) -> set:
    """Of (id, bands) the least id of each group that bands hold together."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for doc_id, bands in sorted(signed):
        own = root(("id", doc_id))
        for x in bands:
            parent[root(x)] = own
    least: dict = {}
    for doc_id, _ in sorted(signed):
        least.setdefault(root(("id", doc_id)), doc_id)
    return set(least.values())


def _teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of character trigrams of all texts, and of features of labelled ones."""
    cells, held, held_n = np.zeros(CLASSES**3, np.int64), [], 0
    seen: Counter = Counter()
    marked: Counter = Counter()

    def out(names: list, n: list, n1: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(n1, pa.int64())], ["feature", "n", "n_toxic"])

    def flush() -> Iterator[pa.RecordBatch]:
        names = list(seen)
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield out(part, [seen[x] for x in part], [marked[x] for x in part])
        seen.clear()
        marked.clear()

    for b in batches:
        for text, label in zip(b.column(0), b.column(1).to_pylist()):
            text = text.as_py() or ""
            held.append(trigrams(text))
            held_n += len(held[-1])
            if held_n > 1_000_000:
                cells += np.bincount(np.concatenate(held), minlength=CLASSES**3)
                held, held_n = [], 0
            if label is not None:
                own = {f for w in {core(w) for w in text.lower().split()} if w for f in features(w)}
                seen.update(own)
                if label:
                    marked.update(own)
        if len(seen) > CACHE_WORDS:
            yield from flush()
    yield from flush()
    if held:
        cells += np.bincount(np.concatenate(held), minlength=CLASSES**3)
    full = np.flatnonzero(cells)
    yield out([f"\0{k}" for k in full], cells[full].tolist(), [0] * len(full))


def train(docs: DataFrame, labels: DataFrame, at_most: int = MAX_LABELLED) -> tuple[CharModel, dict[str, float], np.ndarray]:
    """The character model, the marks and the buckets' log ratios, from ``docs`` (doc_id, text) and ``labels``
    (doc_id, toxic) of rows that may teach."""
    spark = docs.sparkSession
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (id_crc_mod5(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most).collect()  # at most MAX_LABELLED small rows
    id_type = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", "text")
    if rows:
        ids = spark.createDataFrame([(r.doc_id, int(r.toxic)) for r in rows], f"l_id {id_type}, toxic int")
        signed = own.join(F.broadcast(ids), own.doc_id == ids.l_id).select("doc_id", "text").mapInArrow(tidied(_signatures), f"doc_id {id_type}, bands array<long>")
        held = firsts([(r.doc_id, r.bands) for r in signed.groupBy("doc_id").agg(F.min("bands").alias("bands")).collect()])  # at most MAX_LABELLED rows
        rows = [r for r in rows if r.doc_id in held]
    n1 = sum(r.toxic for r in rows)
    base = min(0.9, max(0.01, n1 / len(rows))) if rows else 0.5
    ids = spark.createDataFrame([(r.doc_id, int(r.toxic)) for r in rows], f"l_id {id_type}, toxic int")
    counted = own.join(F.broadcast(ids), own.doc_id == ids.l_id, "left").select("text", "toxic").mapInArrow(tidied(_teach), "feature string, n long, n_toxic long")
    counted = staged(counted.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic")), "toxic-features")
    is_cell = F.col("feature").startswith("\0")
    cells = np.zeros(CLASSES**3)
    for r in counted.where(is_cell).collect():  # at most 2^18 rows
        cells[int(r.feature[1:])] = r.n
    found = counted.where(~is_cell)
    trials = found.count()
    prior = min(0.5, MARKS_EXPECTED / max(trials, 1))
    odds = F.lit(math.log(prior / (1 - prior))) + F.col("n_toxic") * F.lit(math.log(MARK_PRECISION / base)) + (F.col("n") - F.col("n_toxic")) * F.lit(math.log((1 - MARK_PRECISION) / (1 - base)))
    marks = found.withColumn("odds", odds).where(f"odds > 0 AND n_toxic >= {LEAST_PRECISION} * n").collect()  # marks of at most MAX_LABELLED texts
    odds = {r.feature: min(r.odds, 12.0) for r in marks}
    ratio = np.zeros(BUCKETS)
    whole = found.where(~F.col("feature").endswith("~")).groupBy(F.pmod(F.xxhash64("feature"), F.lit(BUCKETS)).alias("k")).agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    for r in whole.collect():  # at most BUCKETS rows
        share = (r.n_toxic + BUCKET_PRIOR * base) / (r.n + BUCKET_PRIOR)
        ratio[r.k] = math.log(share / base) - math.log((1 - share) / (1 - base))
    release(counted)
    return CharModel(cells, [f for f in odds if not f.endswith("~")]), odds, ratio


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            x = np.array([scorer.text(t.as_py() or "") for t in b.column(1)])
            p = 1 / (1 + np.exp(-x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    own = docs.select("doc_id", "text")
    return own.mapInArrow(tidied(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            yield b.filter(pa.array([scorer.text(t.as_py() or "") < 0 for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (id_crc_mod5(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")

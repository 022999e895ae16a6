"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round forms the key of every
adjacent pair inside a word, finds the pairs' ranks by binary search over the
sorted keys of the merge list, takes each word's lowest rank and merges all its
places from left to right, in every word at once; words without a pair leave.
A merge's parts always come before it in the list, so merging all places of the
lowest pair in one round gives what merging one place at a time gives. A word of more
than ``LONG`` bytes is merged by itself from a heap: its many rounds would read all
symbols each time.

Texts are split as the vocabulary's own file says (special strings first, then
NFC, lower case, the split pattern). Distinct words are encoded once a worker and
kept in a bounded cache. Decoding joins the ids' surfaces by one blank, as the
file has no decoder.

Defined cases: null text counts as empty: no ids, decoded to the empty text; ids of
documents are passed through, null and repeated ones too.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import CACHE_WORDS, table, tidied

CHUNK_CHARS = 1_000_000
#: Bytes of a word from which on its merges come from a heap, not in rounds.
LONG = 200


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself if printable in Latin-1, else the
    next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a vocabulary with word ends."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        for t in spec["added_tokens"]:
            self.vocab.setdefault(t["content"], t["id"])
        self.surface = {i: t for t, i in self.vocab.items()}
        self.end = model["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the file's \s is Unicode's White_Space
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = max(self.surface) + 1
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        a = np.array([self.vocab[x] for x, _ in merges], np.int64)
        b = np.array([self.vocab[y] for _, y in merges], np.int64)
        keys = a * self.size + b
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.results = np.array([self.vocab[x + y] for x, y in merges], np.int64)
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.final = np.array([self.vocab[c + self.end] for c in letters], np.int64)
        self.cache: dict[str, tuple[str, str, int]] = {}
        self.pairs: dict[int, tuple[int, int]] | None = None

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of each word's ids."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[raw]
        ends = np.cumsum(size) - 1
        ids[ends[size > 0]] = self.final[raw[ends[size > 0]]]
        word = np.repeat(np.arange(len(words)), size)
        done_ids, done_words = [], []
        none = np.int32(len(self.results))
        while len(ids) > 1:
            key = ids[:-1] * self.size + ids[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(ids)))
            low = np.repeat(lowest, counts)
            hit = (rank == low) & (low < none)
            # of places that overlap (equal symbols in a row) every other one, from the left
            touch = np.flatnonzero(hit[1:] & hit[:-1])
            if len(touch):
                where = np.flatnonzero(hit)
                run = np.cumsum(np.concatenate([[True], np.diff(where) > 1]))
                begin = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
                place = np.arange(len(where)) - np.repeat(begin, np.diff(np.append(begin, len(where))))
                hit[where[place % 2 == 1]] = False
            places = np.flatnonzero(hit)
            ids[places] = self.results[rank[places]]
            keep = np.ones(len(ids), bool)
            keep[places + 1] = False
            over = low == none
            if over.any():
                done_ids.append(ids[over])
                done_words.append(word[over])
                keep &= ~over
            ids, word = ids[keep], word[keep]
        done_ids.append(ids)
        done_words.append(word)
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one long word: merges by rank from a heap over linked symbols, so in
        time n log n where rounds over all symbols would take n squared."""
        if self.pairs is None:
            self.pairs = {k: (r, int(self.results[r])) for k, r in zip(self.keys.tolist(), self.ranks.tolist())}
        ids = [*self.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.final[word[-1]])]
        n, size, pairs = len(ids), self.size, self.pairs
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(pairs[k][0], i, k) for i in range(n - 1) if (k := ids[i] * size + ids[i + 1]) in pairs]
        heapify(heap)
        while heap:
            _, i, k = heappop(heap)
            j = after[i]
            if j < 0 or ids[i] < 0 or ids[i] * size + ids[j] != k:
                continue  # one of the two has merged since
            ids[i], ids[j] = pairs[k][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (k := ids[x] * size + ids[y]) in pairs:
                    heappush(heap, (pairs[k][0], x, k))
        return [i for i in ids if i >= 0]

    def learn(self, words: set[str]) -> None:
        """Encode the new ones among these words."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = [w for w in words if w not in self.cache]
        if not new:
            return
        raw = {w: w.encode("utf-8", "replace") for w in new}
        for w in [w for w in new if len(raw[w]) > LONG]:
            self.remember(w, self.merge_long(raw[w]))
        new = [w for w in new if len(raw[w]) <= LONG]
        ids, size = self.merge_words([raw[w] for w in new])
        ids, at = ids.tolist(), 0
        for w, n in zip(new, size.tolist()):
            self.remember(w, ids[at : at + n])
            at += n

    def remember(self, word: str, ids: list[int]) -> None:
        surface = self.surface
        self.cache[word] = (" ".join(map(str, ids)), " ".join([surface[i] for i in ids]), len(ids))

    def words(self, text: str) -> list[str]:
        """Words as they go into the merges; special strings stand as they are."""
        parts = self.special_at.split(text) if self.special_at and any(s in text for s in self.special) else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append("\0" + part)  # no word of the pattern mixes these with letters
            elif part:
                part = unicodedata.normalize("NFC", part)
                if "Σ" in part:  # lower() would look at its neighbours
                    part = part.replace("Σ", "σ")
                out += self.pattern.findall(part.lower())
        return out

    def encode_all(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by a blank, decoded text) of each text."""
        k = 0
        while k < len(texts):
            parts, size = [], 0
            while k + len(parts) < len(texts) and size < CHUNK_CHARS:
                size += len(texts[k + len(parts)])
                parts.append(self.words(texts[k + len(parts)]))
            distinct = set().union(*parts)
            marked = {w for w in distinct if w[0] == "\0" and w[1:] in self.special}
            self.learn(distinct - marked)
            for w in marked:
                self.cache[w] = (str(self.special[w[1:]]), w[1:], 1)
            for p in parts:
                found = list(map(self.cache.__getitem__, p))
                yield sum([f[2] for f in found]), " ".join([f[0] for f in found]), " ".join([f[1] for f in found])
            k += len(parts)

    def encode(self, text: str) -> list[int]:
        _, ids, _ = next(self.encode_all([text]))
        return list(map(int, ids.split()))

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.surface[i] for i in ids if i in self.surface)


@cache
def encoder(path: str) -> WordBpe:
    with open(path, encoding="utf-8") as f:
        return WordBpe(json.load(f))


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs``
    (doc_id, text); with_ids adds ``ids`` and ``decoded`` themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = encoder(path), hashlib.sha256
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            n, a, d, ids, decoded = [], [], [], [], []
            for count, i, t in bpe.encode_all(texts):
                n.append(count)
                a.append(sha(i.encode()).hexdigest())
                d.append(sha(t.encode()).hexdigest())
                if with_ids:
                    ids.append(list(map(int, i.split())))
                    decoded.append(t)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)
        bpe.cache.clear()

    own = docs.select("doc_id", "text")
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return own.mapInArrow(tidied(run), schema + (", ids array<int>, decoded string" if with_ids else ""))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

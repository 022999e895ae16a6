"""Token counts by prefix dynamic programming.

For a merge vocabulary the encoding of every prefix of a word ends in exactly one
piece that is compatible with the encoding of the shorter prefix before it: two
adjacent pieces are compatible if encoding their concatenation gives them back.
So one left-to-right pass stores, for every prefix, its last piece and its exact
token count. No piece joins a letter to a following blank mark, so words are
independent and a text's count at any prefix is the sum over whole words plus the
count at a prefix of one word. Truncation ("how much text fits a budget") and
budget questions then read these counts and never encode again.

Defined cases: null text counts as empty, 0 tokens; ids are passed through, null
and repeated ones too; characters in no piece count one token for each UTF-8 byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_WORDS, table, tidied

MARK = "▁"
LIMIT = 4096
#: Words up to so many characters are counted in bulk.
SHORT = 48
#: Texts are split into words this many characters at a time.
CHUNK_CHARS = 2_000_000
_SEGMENT = regex.compile(f"{MARK}*[^{MARK}]*")


class IntMap:
    """A fixed map from int64 keys (not negative) to int32, looked up in bulk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(62 - max(2, int(len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask, self.keys, self.values = size - 1, np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        at = self.place(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & self.mask

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where absent."""
        out, at = np.full(len(keys), -1, np.int32), self.place(keys)
        found = self.keys[at]
        hit = found == keys
        out[hit] = self.values[at[hit]]
        todo = np.flatnonzero(~hit & (found >= 0))
        while len(todo):
            at = (at + 1) & self.mask if len(at) == len(todo) else (at[todo] + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (found >= 0)
            todo, at = todo[more], at[more]
        return out


class PrefixCounter:
    """Exact counts of a sentencepiece merge model at every prefix."""

    def __init__(self, pieces: dict[str, float]):
        """pieces: surface -> score; a higher score merges first."""
        self.rank = {p: -s for p, s in pieces.items()}
        self.tails = {p[k:] for p in pieces for k in range(len(p))}
        self.longest = max(map(len, pieces))
        self.inner = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.breaks = not any("\n" in p for p in pieces)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.totals: dict[str, int] = {}
        self._tables()
        if not (self.inner and self.breaks):
            raise ValueError("this vocabulary joins words, so words are not independent")

    def merged(self, text: str) -> list[str]:
        """The plain merge loop; for short strings."""
        s, rank = list(text), self.rank
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                r = rank.get(s[i] + s[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def compatible(self, a: str, b: str) -> bool:
        if len(self.pairs) > 2 * CACHE_WORDS:
            self.pairs.clear()
        ok = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return ok

    def whole(self, a: str) -> bool:
        ok = self.alone[a] = self.merged(a) == [a]
        return ok

    def prefixes(self, word: str) -> list[int]:
        """Token counts of word[:0], word[:1], ... word[:len(word)]."""
        n = len(word)
        counts, last = [0] * (n + 1), [""] * (n + 1)
        rank, tails, pairs, alone = self.rank, self.tails, self.pairs, self.alone
        for i in range(1, n + 1):
            found = []
            j = i - 1
            while j >= 0 and (p := word[j:i]) in tails:
                if p in rank:
                    found.append((j, p))
                j -= 1
            for j, p in reversed(found):
                before = last[j]
                if before:
                    ok = pairs.get((before, p))
                    if ok is None:
                        ok = self.compatible(before, p)
                else:
                    ok = alone.get(p)
                    if ok is None:
                        ok = self.whole(p)
                if ok:
                    counts[i], last[i] = counts[j] + 1, p
                    break
            else:
                if found:
                    raise AssertionError(f"no piece ends {word[:i]!r}")
                counts[i] = counts[i - 1] + len(word[i - 1].encode("utf-8", "replace"))  # last[i] stays "": nothing merges over it
        return counts

    def _tables(self) -> None:
        """The pieces as a trie of their reversed characters, and a cache of pairs."""
        self.surfaces = ["", *self.rank]
        chars = sorted({c for p in self.rank for c in p})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.n_codes = len(chars) + 1
        nodes, piece_at = {"": 0}, [-1]
        edges: list[tuple[int, int]] = []
        for k, p in enumerate(self.surfaces[1:], 1):
            for d in range(1, len(p) + 1):
                tail = p[len(p) - d :]
                if tail not in nodes:
                    nodes[tail] = len(piece_at)
                    piece_at.append(-1)
                    edges.append((nodes[tail[1:]] * self.n_codes + int(self.code[ord(tail[0])]), nodes[tail]))
            piece_at[nodes[p]] = k
        keys, to = np.array(edges, np.int64).T
        self.edges, self.piece_at = IntMap(np.ascontiguousarray(keys), to.astype(np.int32)), np.array(piece_at, np.int32)
        self.pair_keys, self.pair_ok = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)

    def fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the piece before it (0: nothing to merge with)."""
        key = before.astype(np.int64) * len(self.surfaces) + piece
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        miss = self.pair_keys[at] != key
        if not miss.any():
            return self.pair_ok[at]
        out = self.pair_ok[at]
        new, where = np.unique(key[miss], return_inverse=True)
        ok = np.empty(len(new), bool)
        for k, x in enumerate(new.tolist()):
            a, b = (self.surfaces[i] for i in divmod(x, len(self.surfaces)))
            v = self.pairs.get((a, b)) if a else self.alone.get(b)
            ok[k] = (self.compatible(a, b) if a else self.whole(b)) if v is None else v
        out[miss] = ok[where]
        self.pair_keys[at[miss]], self.pair_ok[at[miss]] = key[miss], ok[where]
        return out

    def batch(self, words: list[str]) -> np.ndarray:
        """Prefix counts of many short words at once: row k, column i is the count of
        words[k][:i]; beyond a word's end the columns mean nothing."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        long, start = int(size.max()), np.concatenate([[0], np.cumsum(size)[:-1]])
        chars = np.zeros((long, len(words)), np.int32)  # by position, words from long to short
        width = [int((size > i).sum()) for i in range(long)]
        utf8 = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
        bytes_of = np.zeros((long, len(words)), np.int32)
        for i in range(long):
            at = start[order[: width[i]]] + i
            chars[i, : width[i]] = self.code[points[at]]
            bytes_of[i, : width[i]] = utf8[at]
        counts = np.zeros((long + 1, len(words)), np.int32)
        last = np.zeros((long + 1, len(words)), np.int32)
        for i in range(1, long + 1):
            w = width[i - 1]
            alive, node, ends = np.arange(w), np.zeros(w, np.int64), []
            for d in range(1, min(i, self.longest) + 1):
                node = self.edges.get(node * self.n_codes + chars[i - d, alive]).astype(np.int64)
                go = node >= 0
                alive, node = alive[go], node[go]
                if not len(alive):
                    break
                piece = self.piece_at[node]
                is_end = piece >= 0
                ends.append((d, alive[is_end], piece[is_end]))
            open_ = np.ones(w, bool)
            for d, who, piece in reversed(ends):
                still = open_[who]
                who, piece = who[still], piece[still]
                if len(who):
                    ok = self.fits(last[i - d, who], piece)
                    who, piece = who[ok], piece[ok]
                    counts[i, who], last[i, who] = counts[i - d, who] + 1, piece
                    open_[who] = False
            rest = np.flatnonzero(open_)  # characters of no piece: bytes
            counts[i, rest] = counts[i - 1, rest] + bytes_of[i - 1, rest]
        out = np.empty((len(words), long + 1), np.int32)
        out[order] = counts.T
        return out

    def learn(self, parts: set[str]) -> None:
        """Fill the cache of whole words with the new ones among ``parts``."""
        if len(self.totals) > CACHE_WORDS:
            self.totals.clear()
        new = [p for p in parts if p not in self.totals]
        for p in [p for p in new if len(p) > SHORT]:
            self.totals[p] = self.prefixes(p)[-1]
        new = [p for p in new if len(p) <= SHORT]
        for k in range(0, len(new), 1 << 15):
            some = new[k : k + (1 << 15)]
            self.totals.update(zip(some, self.batch(some)[np.arange(len(some)), [len(x) for x in some]].tolist()))

    def words(self, text: str) -> list[str]:
        """Independent parts; their concatenation is the marked text."""
        out = []
        for k, line in enumerate((MARK + text.replace(" ", MARK)).split("\n") if text else ()):
            if k:
                out.append("\n")
            if MARK + MARK in line:
                out += filter(None, _SEGMENT.findall(line))
            else:
                first, *rest = line.split(MARK)
                out += [first] if first else []
                out += [MARK + x for x in rest]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        return [n for n, _ in self.counts_and_cuts(texts, None)]

    def counts_and_cuts(self, texts: list[str], limit: int | None) -> list[tuple[int, int]]:
        """Tokens of each text, and the characters of its longest prefix of at most
        ``limit`` tokens (all, without one), from the counts of words and their prefixes."""
        out: list[tuple[int, int]] = []
        k = 0
        while k < len(texts):
            parts, size, begin = [], 0, k
            while k < len(texts) and size < CHUNK_CHARS:
                size += len(texts[k])
                parts.append(self.words(texts[k]))
                k += 1
            self.learn(set().union(*parts))
            for text, p in zip(texts[begin:k], parts):
                own = list(map(self.totals.__getitem__, p))
                n = sum(own)
                out.append((n, len(text) if limit is None or n <= limit else self.cut(p, own, limit)))
        return out

    def cut(self, words: list[str], totals: list[int], limit: int) -> int:
        """Characters of the longest prefix within the limit. A prefix that ends in a word
        counts all words before it, and at least one more; so the last word that begins
        below the limit holds it, or the end of the word before."""
        before = np.cumsum([0, *totals])
        last = max(0, int(np.searchsorted(before[:-1], limit, "left")) - 1)
        inside = self.prefixes(words[last])
        most = max((i for i, c in enumerate(inside) if before[last] + c <= limit), default=0)
        return max(0, sum(map(len, words[:last])) + most - 1)  # less the mark before the text

    def at_prefixes(self, text: str) -> list[int]:
        """Counts of text[:0] ... text[:len(text)]."""
        out, base = [], 0
        for word in self.words(text):
            counts = self.prefixes(word)
            out += [base + c for c in counts[1:]]
            base += counts[-1]
        return [0, *out[1:]] if text else [0]


@cache
def counter(model_path: str) -> PrefixCounter:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return PrefixCounter({m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))})


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, limit_chars) for each row of ``docs``
    (doc_id, text); limit_chars is the length in characters of the text's longest prefix
    of at most ``limit`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).counts_and_cuts
        for b in batches:
            found = count([t.as_py() or "" for t in b.column(1)], limit)
            n, cuts = ([x[k] for x in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(cuts, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    own = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return own.mapInArrow(tidied(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")


def prefix_token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, counts): for each row, the exact token count of text[:k] for every k
    from 0 to its number of characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = counter(model_path).at_prefixes
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], b.column(0).type), pa.array([at(t.as_py() or "")], pa.list_(pa.int32()))], ["doc_id", "counts"])

    own = docs.select("doc_id", "text")
    return own.mapInArrow(tidied(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, counts array<int>")


def within_budget(counts: DataFrame, budget: int) -> DataFrame:
    """From :func:`prefix_token_counts`: (doc_id, n_chars), the longest prefix of at
    most ``budget`` tokens. Counts can fall as a prefix grows, so the last fitting one."""
    c = F.col("counts")
    fits = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda k: c[k] <= budget)
    return counts.select("doc_id", F.array_max(fits).alias("n_chars"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

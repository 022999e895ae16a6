"""Language-model scores: interpolated modified Kneser-Ney over word triples.

Counting is one Spark job with two shuffles of compact blocks. Map tasks turn whole
training texts into counts of triples (u, v, w), each in the cell of its middle word v,
so that one reduce task holds all of a triple's count, of its context (u, v), and of the
distinct words before (v, w). Words that a bounded sample shows to be frequent (and the
begin mark) are spread over cells by (v, w) instead, and the sums of their contexts (u, v)
are brought together by a second shuffle, with the per-word sums. What is frequent decides
only where a count lies, never what it is. A cell is one file of sorted hash arrays in
the shared folder; workers memory-map the files and look hashes up by binary search.

Model, with c the counts of triples, a(vw) the distinct words before (v, w) (after the
begin mark: its count), b(w) the distinct words before w:
P(w|uv) = max(c(uvw) - D3, 0) / c(uv) + g(uv) P(w|v),
P(w|v) = max(a(vw) - D2, 0) / a(v) + g(v) P(w),
P(w) = max(b(w) - D1, 0) / B + g / (V + 1), the last share for an unknown word.
Discounts follow from the counts of counts (a usual fixed choice where those are too
few). A text is two begin marks, its words and one end mark. All counts cover every
training row; nothing is pruned.

Hashes of triples and pairs are stored with 32 bits and their bucket's number, some 48
bits a cell: an unseen one is taken for a seen one with a chance of about 1e-8. Hashes
of words are stored whole.

Defined cases: null text counts as empty, one token (the end); a null id counts as the
empty text in the split; rows that repeat count each; without training rows V = N = 0
and every score is 0.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, id_crc_mod5, local_path, mixed, new_folder, paired, table, texts_of

#: Fixed hashes of the marks: no word's bytes hash to them but by chance.
BEGIN = np.uint64(0x5851F42D4C957F2D)
END = np.uint64(0x14057B7EF767814F)
#: Tokens that a map task gathers before it passes their counts on.
GATHER = 5_000_000
#: Per-word sums that a reduce task holds together before it passes them on.
HOLD = 2_000_000
#: Files that a worker keeps mapped; systems allow some 65,000.
MAX_MAPS = 30_000
#: Bytes of text for each cell, so that a cell's triples fit a worker.
CELL_BYTES = 24 << 20
#: Texts are scored so many tokens at a time.
SCORE_TOKENS = 500_000
#: Rows of the sample that shows frequent words, and their least share in it.
SAMPLE, LEAST_SHARE = 5_000, 1e-5
FALLBACK = (0.5, 1.0, 1.5)
_MARKS = np.array([BEGIN, BEGIN]), np.array([END])


# -- blocks and files -----------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays, each in the narrowest type, byte by byte, compressed."""
    out = []
    for a in arrays:
        a = narrow(a)
        out.append(np.array([a.itemsize, len(a)], np.int64).tobytes() + a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    blob = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    while at < len(blob):
        item, n = np.frombuffer(blob, np.int64, 2, at).tolist()
        out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, item * n, at + 16).reshape(item, n).T).view(f"u{item}").ravel())
        at += 16 + item * n
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0), copy=False)


def path_of(folder: str, kind: str, cell: int) -> str:
    return f"{folder}/{cell % 256}/{kind}-{cell}"


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file, put under its name in one step, so that a task that runs again does no
    harm."""
    head, parts, at = {}, [], 0
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = [a.dtype.str, list(a.shape), at]
        parts.append(a.tobytes() + b"\0" * (-a.nbytes % 8))
        at += len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(np.array([len(text)], np.int64).tobytes() + text)
        f.writelines(parts)
    os.replace(own, path)


def load(path: str) -> dict[str, np.ndarray] | None:
    if not os.path.exists(path):
        return None
    whole = np.memmap(path, np.uint8, "r")
    n = int(whole[:8].view(np.int64)[0])
    out = {}
    for name, (kind, shape, at) in json.loads(whole[8 : 8 + n].tobytes()).items():
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = whole[8 + n + at : 8 + n + at + size].view(kind).reshape(shape)
    return out


# -- sorted hash arrays ------------------------------------------------------------


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def bits_for(n: int) -> int:
    """Bits of a hash that its bucket stands for: some 32 hashes a bucket."""
    return max(1, n.bit_length() - 5)


def split_key(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, the 32 bits after it)."""
    return (key >> np.uint64(64 - bits)).astype(np.int64), (key >> np.uint64(32 - bits)).astype(np.uint32)


def hash_array(name: str, key: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Buckets and sorted hashes, and the order in which values belong to them."""
    order = np.argsort(key)
    bits = bits_for(len(key))
    bucket, low = split_key(key[order], bits)
    begin = np.searchsorted(bucket, np.arange((1 << bits) + 1)).astype(np.uint32)
    return {f"{name}.begin": begin, f"{name}.low": low}, order


def find(arrays: dict[str, np.ndarray], name: str, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of each hash."""
    begin, low = arrays[f"{name}.begin"], arrays[f"{name}.low"]
    bucket, want = split_key(key, int(len(begin) - 1).bit_length() - 1)
    lo, end = begin[bucket].astype(np.int64), begin[bucket + 1].astype(np.int64)
    hi = end.copy()
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = (lo + hi) >> 1
        less = (lo < hi) & (low[np.minimum(mid, len(low) - 1)] < want)
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
    hit = lo < end
    hit[hit] = low[lo[hit]] == want[hit]
    return lo, hit


def counts_array(name: str, value: np.ndarray) -> dict[str, np.ndarray]:
    """One byte a count; larger ones apart."""
    large = np.flatnonzero(value >= 255)
    return {f"{name}.count": np.minimum(value, 255).astype(np.uint8), f"{name}.at": large.astype(np.uint32), f"{name}.large": narrow(value[large].astype(np.uint64))}


def read_counts(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    out = arrays[f"{name}.count"][at].astype(np.int64)
    big = np.flatnonzero(out == 255)
    if len(big):
        out[big] = arrays[f"{name}.large"][np.searchsorted(arrays[f"{name}.at"], at[big])]
    return out


def sums_array(name: str, rows: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of four sums, one byte each: the commonest rows are a palette, others apart."""
    small = (rows < 1 << 15).all(axis=1)
    packed = np.where(small, rows @ np.array([1 << 48, 1 << 32, 1 << 16, 1], np.int64), -1)
    kinds, of, n = np.unique(packed, return_inverse=True, return_counts=True)
    best = np.argsort(-n, kind="stable")[:256]
    best = best[kinds[best] >= 0][:255]
    code = np.full(len(kinds), 255)
    code[best] = np.arange(len(best))
    code = code[of]
    rest = np.flatnonzero(code == 255)
    palette = np.stack([kinds[best] >> s & 0xFFFF for s in (48, 32, 16, 0)], axis=1)
    return {f"{name}.code": code.astype(np.uint8), f"{name}.palette": palette, f"{name}.at": rest.astype(np.uint32), f"{name}.rows": rows[rest]}


def read_sums(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    code = arrays[f"{name}.code"][at]
    out = np.zeros((len(at), 4), np.int64)
    plain = code < 255
    out[plain] = arrays[f"{name}.palette"][code[plain]]
    out[~plain] = arrays[f"{name}.rows"][np.searchsorted(arrays[f"{name}.at"], at[~plain])]
    return out


def first_of(key: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and each value's sums."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = first_of(key)
    return (key[first], *(np.add.reduceat(v[order].astype(np.int64), first) if len(first) else v.astype(np.int64) for v in values))


def by_count(count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (sum, ones, twos, more) of each run of counts."""
    return np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (count, count == 1, count == 2, count >= 3)], axis=1)


def seen_counts(count: np.ndarray) -> np.ndarray:
    """How many are 1, 2, 3, 4."""
    return np.bincount(np.minimum(count, 5), minlength=6)[1:5]


# -- counting ----------------------------------------------------------------------


def stream(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words with their marks in one array, and where triples begin."""
    s = np.concatenate([x for h in texts for x in (_MARKS[0], h, _MARKS[1])])
    ends = np.cumsum([len(h) + 3 for h in texts])
    begins = np.ones(len(s), bool)
    begins[ends - 1] = begins[ends - 2] = False
    return s, np.flatnonzero(begins)


class Cells:
    """In which cell a pair's (and its triples') counts lie."""

    def __init__(self, cells: int, hot: np.ndarray):
        self.cells, self.hot = cells, np.sort(hot)

    def is_hot(self, v: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hot, v)
        at[at == len(self.hot)] = 0
        return self.hot[at] == v

    def of(self, v: np.ndarray, hot: np.ndarray, pair: np.ndarray) -> np.ndarray:
        return range_of(np.where(hot, pair, v), self.cells)


def _triples(where: Cells):
    """Training texts to (cell, block of counts of triples)."""

    def flush(texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        s, begin = stream(texts)
        words, at = np.unique(s, return_inverse=True)
        del s
        bits = max(1, int(len(words) - 1).bit_length())
        if 3 * bits > 63:  # too many words for one key
            v, w, u = at[begin + 1], at[begin + 2], at[begin]
            v, w, u, count = distinct(v, w, u, np.ones(len(v), np.int64))
        else:
            key = at[begin + 1]
            for part in (at[begin + 2], at[begin]):
                key <<= bits
                key |= part
            del at, begin, part
            key.sort()
            first = first_of(key)
            count = np.diff(np.append(first, len(key)))
            v, w, u = parts_of(key[first], bits)
            del key, first
        hot = where.is_hot(words)
        cell = range_of(words, where.cells)[v]
        spread = np.flatnonzero(hot[v])
        cell[spread] = range_of(paired(words[v[spread]], words[w[spread]]), where.cells)
        order = np.argsort(cell.astype(np.uint16) if where.cells <= 1 << 16 else cell, kind="stable")  # keeps (v, w, u)
        edge = np.searchsorted(cell[order], np.arange(where.cells + 1))
        full, blocks = np.flatnonzero(np.diff(edge)).tolist(), []
        for k in full:
            some = order[edge[k] : edge[k + 1]]
            v1, w1, u1 = v[some], w[some], u[some]
            used = np.zeros(len(words), bool)
            used[v1] = used[w1] = used[u1] = True
            number = np.cumsum(used) - 1
            pair = first_of(v1.astype(np.int64) * len(words) + w1)
            head = first_of(v1[pair])
            blocks.append(pack(np.diff(words[used], prepend=np.uint64(0)), number[v1[pair[head]]], np.diff(np.append(head, len(pair))), number[w1[pair]], np.diff(np.append(pair, len(v1))), number[u1], count[some]))
        for k in range(0, len(full), 16):
            yield pa.RecordBatch.from_arrays([pa.array(full[k : k + 16], pa.int32()), pa.array(blocks[k : k + 16], pa.binary())], ["cell", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = WordHashes(), [], 0
        for b in batches:
            for text in texts_of(b.column(0)):
                held.append(hashes.of(text.split()))
                n += len(held[-1]) + 3
                if n >= GATHER:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return run


def parts_of(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = (1 << bits) - 1
    return (key >> 2 * bits).astype(np.int32), (key >> bits & mask).astype(np.int32), (key & mask).astype(np.int32)


def distinct(v: np.ndarray, w: np.ndarray, u: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by (v, w, u), equal ones summed; for numbers too large for one key."""
    order = np.lexsort((u, w, v))
    v, w, u = v[order], w[order], u[order]
    first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (u[1:] != u[:-1])]))
    return v[first], w[first], u[first], np.add.reduceat(count[order], first)


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blocks of one cell after another, from sorted rows."""
    now, held = None, []
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1)):
            if k != now:
                if held:
                    yield now, held
                now, held = k, []
            held.append(x.as_py())
    if held:
        yield now, held


def merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, v, w, u, count) of all blocks of a cell, sorted by (v, w, u), distinct."""
    parts = [unpack(x) for x in blobs]
    for p in parts:
        p[0] = np.cumsum(p[0], dtype=np.uint64)
    words = np.unique(np.concatenate([p[0] for p in parts]))
    bits = max(1, int(len(words) - 1).bit_length())
    one_key, held, counts = 3 * bits <= 63, [], []
    while parts:
        own, heads, runs, seconds, sizes, thirds, count = parts.pop()
        at = np.searchsorted(words, own)
        vwu = [np.repeat(np.repeat(at[heads], runs), sizes), np.repeat(at[seconds], sizes), at[thirds]]
        if one_key:
            key = vwu[0]
            for part in vwu[1:]:
                key <<= bits
                key |= part
            vwu = [key]
        held.append(vwu)
        counts.append(count.astype(np.int64))
    columns, count = [np.concatenate(x) for x in zip(*held)], np.concatenate(counts)
    del held, counts
    if one_key:
        key, count = summed(columns.pop(), count)
        return words, *parts_of(key, bits), count
    return words, *distinct(*columns, count)


#: What the second shuffle brings together: of a context word, of a token, of a context
#: whose second word is frequent; below 0 counts of counts.
CONTEXT, TOKEN, HOT = range(3)


def _cells(folder: str, where: Cells):
    """Blocks of triples to a file for each cell; passes on blocks of sums."""

    def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["slot", "block"])

    def flush(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        """The sums of several cells together: fewer and larger blocks."""
        out = []
        for tag, parts in held.items():
            h, *sums = summed(*(np.concatenate(x) for x in zip(*parts)))
            edge = np.searchsorted(range_of(h, where.cells), np.arange(where.cells + 1))
            for r in np.flatnonzero(np.diff(edge)).tolist():
                s = slice(edge[r], edge[r + 1])
                out.append((3 * r + tag, pack(h[s], *(x[s] for x in sums))))
        for k in range(0, len(out), 1000):
            yield batch(out[k : k + 1000])

    def one(cell: int, blobs: list[bytes]) -> tuple[bytes, dict[int, tuple[np.ndarray, ...]]]:
        words, v, w, u, count = merged(blobs)
        pair = first_of(v.astype(np.int64) * len(words) + w)
        pv, pw = v[pair], w[pair]
        total = np.add.reduceat(count, pair)
        before = np.where(words[pv] == BEGIN, total, np.diff(np.append(pair, len(v))))
        context_hash = paired(words[u], words[v])
        del u
        arrays, order = hash_array("triple", mixed(paired(context_hash, words[w])))
        arrays |= counts_array("triple", count[order])
        del w
        own, order = hash_array("pair", mixed(paired(words[pv], words[pw])))
        arrays |= own | counts_array("pair", before[order])
        # contexts (u, v): triples by hash of the context
        order = np.argsort(context_hash)
        first = first_of(context_hash[order])
        ctx, rows = context_hash[order[first]], by_count(count[order], first)
        spread = where.is_hot(words)[v[order[first]]]
        own, order = hash_array("context", mixed(ctx[~spread]))
        arrays |= own | sums_array("context", rows[~spread][order])
        save(path_of(folder, "cell", cell), arrays)
        head = first_of(pv)
        sums = {
            CONTEXT: (words[pv[head]], *by_count(before, head).T),
            TOKEN: summed(words[pw], np.ones(len(pw), np.int64), total),
            HOT: (ctx[spread], *rows[spread].T),
        }
        return pack(seen_counts(count), seen_counts(before)), {k: (x[0], *(narrow(y) for y in x[1:])) for k, x in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0
        for cell, blobs in by_range(batches):
            seen, sums = one(cell, blobs)
            yield batch([(-1 - cell, seen)])
            for tag, part in sums.items():
                if len(part[0]):
                    held.setdefault(tag, []).append(part)
                    size += len(part[0])
            if size >= HOLD:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    return run


def _sums(folder: str):
    """Blocks of sums to files; passes on totals and counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triples, pairs, words = (np.zeros(4, np.int64) for _ in range(3))
        distinct, tokens, kinds = 0, 0, 0
        for slot, blobs in by_range(batches):
            parts = [unpack(x) for x in blobs]
            if slot < 0:
                triples = triples + sum(x[0].astype(np.int64) for x in parts)
                pairs = pairs + sum(x[1].astype(np.int64) for x in parts)
                continue
            r, tag = divmod(slot, 3)
            h, *sums = summed(*(np.concatenate([x[k].astype(np.uint64 if k == 0 else np.int64) for x in parts]) for k in range(len(parts[0]))))
            if tag == HOT:
                arrays, order = hash_array("context", mixed(h))
                save(path_of(folder, "hot", r), arrays | sums_array("context", np.stack(sums, axis=1)[order]))
            else:
                save(path_of(folder, ("context", "token")[tag], r), {"key": h, "sums": narrow(np.stack(sums, axis=1).astype(np.uint64).ravel()).reshape(-1, len(sums))})
            if tag == TOKEN:
                b, c = sums
                words += seen_counts(b)
                distinct, tokens, kinds = distinct + int(b.sum()), tokens + int(c.sum()), kinds + len(h)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.int64()) if isinstance(x, list) else pa.int64()) for x in (triples.tolist(), pairs.tolist(), words.tolist(), distinct, tokens, kinds)], ["triples", "pairs", "words", "distinct", "tokens", "kinds"])

    return run


def discounts(seen: list[int]) -> tuple[float, float, float]:
    """For counts of 1, 2 and more, from the counts of counts 1 to 4."""
    if min(seen) <= 0:
        return FALLBACK
    y = seen[0] / (seen[0] + 2 * seen[1])
    d = [k - (k + 1) * y * seen[k] / seen[k - 1] for k in (1, 2, 3)]
    return tuple(x if 0 < x < k else FALLBACK[k - 1] for k, x in zip((1, 2, 3), d))


# -- scoring -----------------------------------------------------------------------


class Model:
    """Memory-mapped cells and the scores from them."""

    def __init__(self, folder: str, where: Cells, spec: dict):
        self.folder, self.where, self.spec = folder, where, spec
        self.maps: dict[tuple[str, int], dict | None] = {}

    def mapped(self, kind: str, cell: int) -> dict[str, np.ndarray] | None:
        got = self.maps.get((kind, cell), self)
        if got is self:
            if len(self.maps) >= MAX_MAPS:
                del self.maps[next(iter(self.maps))]  # the one mapped first
            got = self.maps[kind, cell] = load(path_of(self.folder, kind, cell))
        return got

    def words(self, kind: str, h: np.ndarray, width: int) -> np.ndarray:
        """Sums of sorted distinct words, 0 where absent."""
        out = np.zeros((len(h), width), np.int64)
        edge = np.searchsorted(range_of(h, self.where.cells), np.arange(self.where.cells + 1))
        for r in np.flatnonzero(np.diff(edge)).tolist():
            have = self.mapped(kind, r)
            if have is not None:
                s = slice(edge[r], edge[r + 1])
                at = np.searchsorted(have["key"], h[s])
                at[at == len(have["key"])] = 0
                hit = have["key"][at] == h[s]
                out[s][hit] = have["sums"][at[hit]]
        return out

    def hashes(self, kind: str, name: str, cell: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Counts (or rows of four sums, of contexts) by cell and hash, 0 where absent."""
        rows = name == "context"
        out = np.zeros((len(h), 4) if rows else len(h), np.int64)
        order = np.argsort(cell.astype(np.uint16) if self.where.cells <= 1 << 16 else cell, kind="stable")
        edge = np.searchsorted(cell[order], np.arange(self.where.cells + 1))
        key = mixed(h)
        for r in np.flatnonzero(np.diff(edge)).tolist():
            have = self.mapped(kind, r)
            if have is not None and len(have[f"{name}.low"]):
                own = order[edge[r] : edge[r + 1]]
                at, hit = find(have, name, key[own])
                out[own[hit]] = (read_sums if rows else read_counts)(have, name, at[hit])
        return out

    def scores(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, score) of texts given as word hashes."""
        spec, where = self.spec, self.where
        s, begin = stream(texts)
        words, at = np.unique(s, return_inverse=True)
        hot, own = where.is_hot(words), range_of(words, where.cells)
        n_all, n_words = spec["tokens"], spec["kinds"]
        tokens, contexts = self.words("token", words, 2), self.words("context", words, 4).astype(np.float64)
        # distinct pairs, as context of the next word and as a pair of the word before
        pairs, pair_at = np.unique(at[:-1] * len(words) + at[1:], return_inverse=True)
        first, second = np.divmod(pairs, len(words))
        h = paired(words[first], words[second])
        cell = where.of(words[first], hot[first], h)
        a = self.hashes("cell", "pair", cell, h)
        sums = np.zeros((len(pairs), 4))
        cold = np.flatnonzero(~hot[second])
        sums[cold] = self.hashes("cell", "context", own[second[cold]], h[cold])
        warm = np.flatnonzero(hot[second])
        sums[warm] = self.hashes("hot", "context", range_of(h[warm], where.cells), h[warm])
        before, after, w = pair_at[begin], pair_at[begin + 1], at[begin + 2]
        c = self.hashes("cell", "triple", cell[after], paired(h[before], words[w]))
        base = np.log10((tokens[:, 1] + 0.5) / (n_all + 0.5 * (n_words + 1)))
        d1, d2, d3 = (np.array([0.0, *spec[k]]) for k in ("d1", "d2", "d3"))
        b = tokens[:, 0]
        p1 = (b - d1[np.minimum(b, 3)]) / spec["distinct"] + spec["share"] / (n_words + 1) if spec["distinct"] else np.full(len(words), 1.0 / (n_words + 1))

        def shares(rows: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(total, share of the shorter context) of contexts; unseen: 1, all."""
            seen = rows[:, 0] > 0
            total = np.where(seen, rows[:, 0], 1.0)
            return total, np.where(seen, rows[:, 1:] @ d[1:] / total, 1.0)

        total, share = shares(contexts, d2)
        p2 = (a - d2[np.minimum(a, 3)]) / total[first] + share[first] * p1[second]
        total, share = shares(sums, d3)
        score = np.log10((c - d3[np.minimum(c, 3)]) / total[before] + share[before] * p2[after])
        size = np.array([len(x) + 1 for x in texts])
        starts = np.cumsum(size) - size
        known = np.add.reduceat((tokens[:, 1] > 0)[w].astype(np.int64), starts)
        yield from zip(size.tolist(), known.tolist(), np.add.reduceat(base[w], starts).tolist(), np.add.reduceat(score, starts).tolist())


def frequent(texts: DataFrame, rows: int, cells: int) -> np.ndarray:
    """Hashes of words whose share in a sample could fill a quarter of a cell, and of the
    begin mark."""
    some = texts.sample(min(1.0, SAMPLE / max(rows, 1)), seed=7)
    counts = some.select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(20.0, total * max(LEAST_SHARE, 0.25 / cells))
    words = counts.where((F.col("n") >= least) & (F.col("w") != "")).select("w").collect()  # at most 1 / LEAST_SHARE words
    found = [xxhash.xxh64_intdigest(r.w.encode()) for r in words]
    return np.array([*found, int(BEGIN)], np.uint64)


def train(texts: DataFrame) -> Model:
    """The model of all rows of ``texts`` (text)."""
    spark = texts.sparkSession
    own = texts.select("text")
    size = own.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).first()
    cells = max(4, -(-(size["n"] or 0) // CELL_BYTES))
    where = Cells(cells, frequent(own, size["rows"], cells))
    folder = local_path(new_folder(spark, "lm"))
    os.makedirs(folder)
    triples = own.mapInArrow(_triples(where), "cell int, block binary")
    triples = triples.repartition("cell").sortWithinPartitions("cell")
    sums = triples.mapInArrow(_cells(folder, where), "slot int, block binary")
    sums = sums.repartition("slot").sortWithinPartitions("slot")
    rows = sums.mapInArrow(_sums(folder), "triples array<long>, pairs array<long>, words array<long>, distinct long, tokens long, kinds long").collect()  # one for each task
    spec = {k: sum(r[k] for r in rows) for k in ("distinct", "tokens", "kinds")}
    seen = {k: [sum(r[k][i] for r in rows) for i in range(4)] for k in ("triples", "pairs", "words")}
    spec |= {"d3": discounts(seen["triples"]), "d2": discounts(seen["pairs"]), "d1": discounts(seen["words"])}
    ones, twos = seen["words"][:2]
    kept = spec["d1"][0] * ones + spec["d1"][1] * twos + spec["d1"][2] * (spec["kinds"] - ones - twos)
    spec["share"] = kept / spec["distinct"] if spec["distinct"] else 1.0
    return Model(folder, where, spec)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row of ``docs`` (doc_id,
    text); other columns named in ``docs`` are kept in front."""
    keep = [c for c in docs.columns if c != "text"]
    own = docs.select(*keep, "text")
    folder, where, spec = model.folder, model.where, model.spec

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, m = WordHashes(), Model(folder, where, spec)
        for b in batches:
            found, held, n = [], [], 0
            for text in texts_of(b.column(len(keep))):
                held.append(hashes.of(text.split()))
                n += len(held[-1]) + 1
                if n >= SCORE_TOKENS:
                    found += m.scores(held)
                    held, n = [], 0
            if held:
                found += m.scores(held)
            new = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *new], [*keep, "n_tokens", "n_known", "base_score", "score"])

    types = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in keep)
    return own.mapInArrow(run, f"{types}, n_tokens long, n_known long, base_score double, score double")


def op8_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (id_crc_mod5(F.col("doc_id")) == 1).alias("held_out"), F.col("text"))
    lowered = docs.withColumn("text", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    model = train(lowered.where("NOT held_out").select("text"))
    out = score(lowered, model)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.spec["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")

"""Near-duplicate lines: an exact set-similarity join over line words, which removes later matches.

A line is the set of its words. Lines of equal sets are found first, by a 128-bit digest; all but the earliest go. The
others post the words of their prefix, from rare to frequent, to the buckets of these words; there the length, the
place in the prefix and a parity digest of the set leave few candidates, which are verified by the words themselves.
Each line first asks for its likeliest earlier partner only, so a dense group costs one candidate for each line and word;
lines that this partner does not match are then compared with all others.
"""

from __future__ import annotations

from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, mix64, settle, settle_by, shuffle_width, text_bytes, text_chunks, width_for

#: Cells that count words; words in one cell share a count, which affects their order and so the cost, not the result.
CELL_BITS = 23
SEGMENTS = 16
#: Text for each bucket of words, from which the number of buckets follows.
BUCKET_TEXT = 6 << 20
#: Postings that one task takes; the bucket of a word that more lines have is cut into blocks.
BLOCK = 1 << 18
#: Characters of text whose lines are posted together.
CHUNK = 16 << 20
#: Characters of text whose words are hashed at once, so that arrays stay in the processor's cache.
PIECE = 1 << 19
#: The bits of a word's hash by which words of one level are ordered.
ORDER = np.uint64((1 << 46) - 1)
#: Pairs that are compared at once, and postings of a word from which they are compared earliest first.
PAIRS, LARGE = 1 << 18, 256
FAR = 1 << 20


# --- lines as sets of words ----------------------------------------------------------------------------------------


def words_of(line: str) -> set[str]:
    return set(line.lower().split())


#: White space beyond ASCII, for str.split(): the UTF-8 bytes in one number.
_SPACES = np.array(sorted(int.from_bytes(c.encode(), "big") for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"))


def _gaps(data: np.ndarray) -> np.ndarray:
    """Whether each byte of lower-cased UTF-8 is white space, as str.split() has it, with one gap before and after."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = (data - np.uint8(9) < 5) | (data - np.uint8(28) < 5)
    at = np.flatnonzero((data == 0xC2) | (data - np.uint8(0xE1) < 3))
    if len(at):
        n = np.where(data[at] == 0xC2, 2, 3)
        code = data[at].astype(np.int64) << 8 | data[at + 1]
        code = np.where(n == 3, code << 8 | data[np.minimum(at + 2, len(data) - 1)], code)
        found = np.isin(code, _SPACES)
        for k in range(3):
            gap[1 + k + at[found & (n > k)]] = True
    return gap


def _hash_words(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time for all words together."""
    whole = np.frombuffer(data.tobytes() + bytes(16 - len(data) % 8), "<u8")
    factor, eight = np.uint64(0x9FB21C651E98DF25), np.uint64(8)

    def block(start, size):
        at, shift = start >> 3, (start & 7).astype(np.uint64) * eight
        # the part of the next number, in two steps as a shift by 64 is none
        own = (whole[at] >> shift) | (whole[at + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        return own & (~np.uint64(0) >> (np.uint64(64) - np.minimum(size, 8).astype(np.uint64) * eight))

    out = mix64((size.astype(np.uint64) ^ block(start, size)) * factor)
    at = np.flatnonzero(size > 8)
    start, size = start[at] + 8, size[at] - 8
    while len(at):
        out[at] = mix64((out[at] ^ block(start, size)) * factor)
        more = size > 8
        at, start, size = at[more], start[more] + 8, size[more] - 8
    return out


def _by_line(line: np.ndarray, key: np.ndarray):
    """(first, order) by line and key of 52 bits, in one number, for ranges of lines that leave room for the key."""
    at = 0
    while at < len(line):
        to = int(np.searchsorted(line, line[at] + (1 << 12)))
        yield at, np.argsort(((line[at:to] - line[at]).astype(np.uint64) << np.uint64(52)) | key[at:to])
        at = to


def _level_of(levels: np.ndarray, word: np.ndarray) -> np.ndarray:
    return levels[(word >> np.uint64(64 - CELL_BITS)).astype(np.int64)]


def _line_words(texts: list[str], without=None, levels=None):
    """(text, line, number of words) of each line that has words, and all their words' hashes, line after line; with
    levels each line's in order of level and ORDER bits."""
    data = np.frombuffer(b"\n".join([t.lower().encode() for t in texts]), np.uint8)
    n_lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    first = np.cumsum(n_lines) - n_lines
    gap = _gaps(data)
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    before = np.searchsorted(start, np.flatnonzero(data == 10))
    line = np.repeat(np.arange(len(before) + 1), np.diff(np.r_[0, before, len(start)]))
    if without is not None and any(w is not None for w in without):
        gone = np.concatenate([f + np.asarray(w, np.int64) for f, w in zip(first, without, strict=True) if w is not None])
        out = np.zeros(int(n_lines.sum()), bool)
        out[gone] = True
        stays = ~out[line]
        start, end, line = start[stays], end[stays], line[stays]
    word = _hash_words(data, start, end - start)
    key = word >> np.uint64(12)
    if levels is not None:
        key = (_level_of(levels, word).astype(np.uint64) << np.uint64(46)) | (word & ORDER)
    order = [at + own for at, own in _by_line(line, key)]
    order = np.concatenate(order) if order else np.empty(0, np.int64)
    # a range's lines stay in their places
    word = word[order]
    new = np.r_[True, (word[1:] != word[:-1]) | (line[1:] != line[:-1])] if len(word) else np.empty(0, bool)
    word, line = word[new], line[new]
    begin = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.empty(0, np.int64)
    n, line = np.diff(np.r_[begin, len(line)]), line[begin]
    doc = np.searchsorted(first, line, "right") - 1
    return doc, (line - first[doc]).astype(np.int32), n, word


def _chunks(batches, columns: list[str], chunk: int):
    """Rows of batches in runs of about ``chunk`` characters: the texts and the given columns."""
    for pdf in batches:
        texts = pdf["text"].tolist()
        for lo, hi in text_chunks(texts, chunk):
            yield texts[lo:hi], *(pdf[c].iloc[lo:hi] for c in columns)


def _pieces(texts: list[str], without=None, levels=None):
    """What ``_line_words`` gives for one piece of the texts after the other."""
    for lo, hi in text_chunks(texts, PIECE):
        doc, line, n, word = _line_words(texts[lo:hi], without and without[lo:hi], levels)
        if len(n):
            yield doc + lo, line, n, word


def _joined(parts: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def prefix_size(n: np.ndarray, t: float) -> np.ndarray:
    """Words of a set of n that must be looked at: any set this similar shares one of them."""
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


# --- columns in one value ------------------------------------------------------------------------------------------


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as bytes. Short ones have next to no overhead; of long ones, hashes (u8) stay as they are
    and the others are compressed, first bytes first."""
    import zstandard

    n = len(columns[0])
    if sum(c.itemsize for c in columns) * n <= 512:
        return b"\0" + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    hashes = [c.tobytes() for c in columns if c.dtype == np.uint64]
    planes = [c.view(np.uint8).reshape(n, -1).T.tobytes() for c in map(np.ascontiguousarray, columns) if c.dtype != np.uint64]
    return b"".join([b"\1", n.to_bytes(4, "little"), *hashes, zstandard.ZstdCompressor(level=1).compress(b"".join(planes))])


def _unpack(payloads, kinds: str) -> list[np.ndarray]:
    """The columns of several values, one after the other. kinds: numpy types, separated by spaces."""
    import zstandard

    types = [np.dtype(k) for k in kinds.split()]
    width, parts = sum(k.itemsize for k in types), [[np.empty(0, k)] for k in types]
    for p in payloads:
        if not p[0]:
            n, at = (len(p) - 1) // width, 1
            for own, k in zip(parts, types, strict=True):
                own.append(np.frombuffer(p, k, n, at))
                at += n * k.itemsize
            continue
        n, at, plane = int.from_bytes(p[1:5], "little"), 5, 0
        raw = zstandard.ZstdDecompressor().decompress(p[5 + n * 8 * types.count(np.uint64) :])
        for own, k in zip(parts, types, strict=True):
            if k == np.uint64:
                own.append(np.frombuffer(p, k, n, at))
                at += n * 8
            else:
                planes = np.frombuffer(raw, np.uint8, n * k.itemsize, plane).reshape(k.itemsize, n)
                own.append(np.ascontiguousarray(planes.T).view(k).ravel())
                plane += n * k.itemsize
    return [np.concatenate(own) for own in parts]


def _by_bucket(bucket: np.ndarray, columns) -> list[tuple[int, int, bytes]]:
    """(bucket, rows, payload) of each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.r_[True, np.diff(bucket) != 0]) if len(order) else []
    return [(int(bucket[a]), int(b - a), _pack(*(c[a:b] for c in columns))) for a, b in zip(edges, [*edges[1:], len(order)], strict=False)]


# --- equal lines ---------------------------------------------------------------------------------------------------

#: A line's digest (two halves), its document's id, text hash and row, and its number.
_EQUAL = "u8 u8 i8 i8 i8 i4"


def _later(low, high, doc, key, line):
    """Which lines come after another one of the same digest: those with a greater (doc, key, line) than its least."""
    order = np.lexsort((line, key, doc, high, low))
    new = np.r_[True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    out = np.zeros(len(order), bool)
    out[order] = (doc[order] != doc[first]) | (key[order] != key[first]) | (line[order] != line[first])
    return out


def _equal_lines(docs: DataFrame, buckets: int, chunk: int) -> tuple[DataFrame, np.ndarray]:
    """(uid, line) of lines whose words an earlier line has exactly; for each cell the bit length of the number of lines
    with one of its words."""
    span = 1 << (CELL_BITS - SEGMENTS.bit_length() + 1)

    def digest(batches):
        counted = [(np.empty(0, np.uint32), np.empty(0, np.int64))]
        for texts, uid, doc_id, tkey in _chunks(batches, ["uid", "doc_id", "tkey"], chunk):
            parts, cells = [], []
            for doc, line, n, word in _pieces(texts):
                cells.append((word >> np.uint64(64 - CELL_BITS)).astype(np.uint32))
                begin, size = np.cumsum(n) - n, n.astype(np.uint64)
                low = mix64(np.add.reduceat(mix64(word), begin) + size)
                high = mix64(np.add.reduceat(mix64(word ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin) + size)
                parts.append((doc, line, low, high))
            if not parts:
                continue
            counted.append(_runs(np.sort(np.concatenate(cells))))
            doc, line, low, high = _joined(parts)
            uid, doc_id, tkey = (x.to_numpy(np.int64)[doc] for x in (uid, doc_id, tkey))
            gone = _later(low, high, doc_id, tkey, line)
            if gone.any():
                yield _rows([(-1, int(gone.sum()), _pack(uid[gone], line[gone]))])
            columns = [x[~gone] for x in (low, high, doc_id, tkey, uid, line)]
            yield _rows(_by_bucket((columns[0] % np.uint64(buckets)).astype(np.int64), columns))
        cells, counts = _joined(counted)
        order = np.argsort(cells, kind="stable")
        cells, n = _runs(cells[order])
        counts = np.add.reduceat(counts[order], np.cumsum(n) - n) if len(n) else n
        yield _rows([(-2 - s, n, p) for s, n, p in _by_bucket(cells // span, [(cells % span).astype(np.int32), counts])])

    # the texts are read once for the counts and the digests
    found = settle(docs.mapInPandas(digest, "bucket int, n long, payload binary"), "digests", gather=True)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(span, np.int64)
        cells, counts = _unpack(pdf["payload"], "i4 i8")
        np.add.at(out, cells, counts)
        return pd.DataFrame({"segment": [-2 - pdf["bucket"].iloc[0]], "levels": [np.ceil(np.log2(out + 1)).astype(np.uint8).tobytes()]})

    rows = found.filter("bucket < -1").groupBy("bucket").applyInPandas(total, "segment int, levels binary").collect()
    levels = np.zeros(1 << CELL_BITS, np.uint8)  # 2^CELL_BITS bytes at any corpus size
    for r in rows:
        levels[r["segment"] * span : (r["segment"] + 1) * span] = np.frombuffer(r["levels"], np.uint8)

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high, doc_id, tkey, uid, line = _unpack(pdf["payload"], _EQUAL)
        gone = _later(low, high, doc_id, tkey, line)
        return pd.DataFrame({"uid": uid[gone], "line": line[gone]})

    def spread(batches):
        for pdf in batches:
            uid, line = _unpack(pdf["payload"], "i8 i4")
            yield pd.DataFrame({"uid": uid, "line": line})

    gone = found.filter("bucket >= 0").groupBy("bucket").applyInPandas(resolve, "uid long, line int")
    gone = gone.unionByName(found.filter("bucket = -1").select("payload").mapInPandas(spread, "uid long, line int"))
    gone = settle(gone.groupBy("uid").agg(F.collect_list("line").alias("gone")), "equal")  # at most a text's own lines
    discard(found)
    return gone, levels


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of sorted values, and how often each occurs."""
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    return values[edges], np.diff(np.r_[edges, len(values)])


def _rows(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "n", "payload"])


# --- candidates ----------------------------------------------------------------------------------------------------

#: A posting: the word within its bucket, the line's document, row and number, its words, the word's place among them
#: and the parity of the set (each word turns one of 128 bits).
_POSTING = "u4 i8 i8 i4 u4 u4 u8 u8"
_PAIRS = "bucket int, uid long, line int, other_uid long, other_line int, far int, more boolean"
_PAIR_COLUMNS = [x.split()[0] for x in _PAIRS.split(", ")]


class _Postings:
    """Postings; searches are in those that ``ordered`` put in order of word and size."""

    def __init__(self, payloads):
        self.columns = _unpack(payloads, _POSTING)
        self.take(slice(None))

    def ordered(self) -> _Postings:
        return self.take(np.argsort(self.rank))

    def of_words(self, word: np.ndarray) -> _Postings:
        return copy(self).take(_among(self.word, word))

    def take(self, at) -> _Postings:
        self.columns = [c[at] for c in self.columns]
        self.word, self.doc, self.uid, self.line, n, pos, self.even, self.odd = self.columns
        self.n = n.astype(np.int64)
        self.left = self.n - pos
        # the word and the size in one number, for ranges of sizes
        self.rank = (self.word.astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)
        return self

    def windows(self, other: _Postings, t: float) -> tuple[np.ndarray, np.ndarray]:
        """For each of these the range of the other's postings of the same word whose size allows the similarity."""
        least = np.ceil(t * self.n - 1e-9).astype(np.uint64)
        lo = np.searchsorted(other.rank, self.word.astype(np.uint64) << np.uint64(32) | least)
        return lo, self.ends(other, t)

    def ends(self, other: _Postings, t: float) -> np.ndarray:
        most = np.floor(self.n / t + 1e-9).astype(np.uint64)
        return np.searchsorted(other.rank, self.word.astype(np.uint64) << np.uint64(32) | most, "right")


def _earlier(p: _Postings, a: np.ndarray, q: _Postings, b: np.ndarray) -> np.ndarray:
    """Whether p's line a may come before q's line b; of equal ids both may, as only the text's hash decides."""
    same_doc = p.doc[a] == q.doc[b]
    same_uid = p.uid[a] == q.uid[b]
    return (p.doc[a] < q.doc[b]) | (same_doc & (~same_uid | (p.line[a] < q.line[b])))


def _passing(p: _Postings, a: np.ndarray, q: _Postings, b: np.ndarray, t: float):
    """The pairs that may be similar, and how many words at least differ.

    At their first common word two sets still need the overlap from there on. Words in one set only are at least as
    many as differing parities.
    """
    both = p.n[a] + q.n[b]
    need = np.ceil(t / (1 + t) * both - 1e-9).astype(np.int64)
    ok = np.flatnonzero(np.minimum(p.left[a], q.left[b]) >= need)
    a, b, most = a[ok], b[ok], (both - 2 * need)[ok]
    far = np.bitwise_count(p.even[a] ^ q.even[b]).astype(np.int64) + np.bitwise_count(p.odd[a] ^ q.odd[b])
    ok = far <= most
    return a[ok], b[ok], far[ok]


def _slices(size: np.ndarray):
    """Ranges of elements whose sizes add up to about PAIRS."""
    end, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + PAIRS, "right")))
        yield at, to
        at = to


def _within(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _all_pairs(p: _Postings, q: _Postings, t: float):
    """(a, b, far): all candidates a in p that may come before b in q."""
    lo, hi = q.windows(p, t)
    for x, y in _slices(hi - lo):
        b, a = np.repeat(np.arange(x, y), (hi - lo)[x:y]), _within(lo[x:y], (hi - lo)[x:y])
        ok = _earlier(p, a, q, b)
        yield _passing(p, a[ok], q, b[ok], t)


def _some_pairs(p: _Postings, t: float):
    """(a, b, far) with an earlier candidate a for each b that has one. Small groups of a word give all their pairs; in
    large ones lines are compared with the earliest ones first and leave as soon as they have a candidate."""
    edges = np.flatnonzero(np.r_[True, p.word[1:] != p.word[:-1], True]) if len(p.word) else np.zeros(1, np.int64)
    count = np.diff(edges)
    hi = p.ends(p, t)
    self_ = np.arange(len(hi))
    size = np.where(np.repeat(count > LARGE, count), 0, hi - self_ - 1)
    for x, y in _slices(size):
        a = np.repeat(self_[x:y], size[x:y])
        b = _within(self_[x:y] + 1, size[x:y])
        a, b, far = _passing(p, a, p, b, t)
        for s, o in ((a, b), (b, a)):
            ok = _earlier(p, s, p, o)
            yield s[ok], o[ok], far[ok]
    for g in np.flatnonzero(count > LARGE):
        own = np.arange(edges[g], edges[g + 1])
        own = own[np.lexsort((p.line[own], p.uid[own], p.doc[own]))]
        open_, at, step = own, 0, 64
        while at < len(own) and len(open_):
            first = own[at : at + step]
            at, step = at + step, min(2 * step, 4096)
            found = []
            for x in range(0, len(open_), max(1, PAIRS // len(first))):
                some = open_[x : x + max(1, PAIRS // len(first))]
                a, b = np.tile(first, len(some)), np.repeat(some, len(first))
                ok = (p.n[a] >= t * p.n[b] - 1e-9) & (p.n[b] >= t * p.n[a] - 1e-9) & (a != b) & _earlier(p, a, p, b)
                a, b, far = _passing(p, a[ok], p, b[ok], t)
                yield a, b, far
                found.append(b)
            open_ = open_[~np.isin(open_, np.concatenate(found))]


def _likeliest(payloads, bucket: int, t: float, split: bool) -> pd.DataFrame:
    """For each line of one block its likeliest earlier candidate, and whether there may be more. In a split bucket
    there may be for each line, with (-1) or without a candidate."""
    p = _Postings(payloads).ordered()
    # a number for each line
    uid, _ = _numbered(p.uid)
    line, first = _numbered(uid << 32 | p.line.astype(np.int64))
    large = np.repeat(c := np.diff(np.flatnonzero(np.r_[True, p.word[1:] != p.word[:-1], True])), c) > LARGE if len(line) else np.empty(0, bool)
    more = np.zeros(len(first), bool)
    best_far, best = np.full(len(first), FAR, np.int64), np.full(len(first), -1, np.int64)
    for a, b, far in _some_pairs(p, t):
        if not len(a):
            continue
        to = line[b]
        # of equally near ones a mixed number decides, so that no line is everyone's partner
        order = np.lexsort((mix64((line[a].astype(np.uint64) << np.uint64(32)) | to.astype(np.uint64)), far, to))
        a, b, far, to = a[order], b[order], far[order], to[order]
        lead = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        other = line[a]
        # by index, as of |= on repeated indices only the last would count
        more[to[large[b]]] = True
        more[to[1:][(to[1:] == to[:-1]) & (other[1:] != other[:-1])]] = True
        t_, f_, o_ = to[lead], far[lead], other[lead]
        more[t_] |= (best[t_] >= 0) & (best[t_] != o_)
        better = f_ < best_far[t_]
        best_far[t_[better]], best[t_[better]] = f_[better], o_[better]
    at = np.arange(len(first)) if split else np.flatnonzero(best >= 0)
    partner = first[best[at]] if len(at) else at
    none = best[at] < 0
    return pd.DataFrame(
        {
            "bucket": np.full(len(at), bucket),
            "uid": p.uid[first[at]],
            "line": p.line[first[at]],
            "other_uid": np.where(none, -1, p.uid[partner]),
            "other_line": np.where(none, -1, p.line[partner]),
            "far": best_far[at],
            "more": more[at] | split,
        }
    )


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's place among the different ones, and where one with it stands for each of these."""
    order = np.argsort(values)
    new = np.r_[True, values[order][1:] != values[order][:-1]] if len(order) else np.empty(0, bool)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, order[new]


def _among(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Where the values stand that are among the few."""
    few = np.unique(few)
    return np.flatnonzero(few[np.minimum(np.searchsorted(few, values), len(few) - 1)] == values) if len(few) else np.empty(0, np.int64)


def _open_ones(p: _Postings, o: pd.DataFrame) -> _Postings:
    """The postings of the open lines (uid, line)."""
    uid, line = o["uid"].to_numpy(np.int64), o["line"].to_numpy(np.int64)
    at, uids = _among(p.uid, uid), np.unique(uid)
    own, asked = (np.searchsorted(uids, u) << 32 | n.astype(np.int64) for u, n in ((p.uid[at], p.line[at]), (uid, line)))
    return copy(p).take(at[_among(own, asked)])


def _candidates(p: _Postings, q: _Postings, bucket: int, t: float):
    """All earlier candidates among p for the lines of q."""
    for a, b, far in _all_pairs(p, q, t):
        own = pd.DataFrame({"uid": q.uid[b], "line": q.line[b], "other_uid": p.uid[a], "other_line": p.line[a], "far": far})
        own = own.drop_duplicates(["uid", "line", "other_uid", "other_line"])
        own["bucket"], own["more"] = bucket, False
        yield own[_PAIR_COLUMNS]


def _frame(parts) -> pd.DataFrame:
    parts = list(parts)
    return pd.concat(parts) if parts else pd.DataFrame(columns=_PAIR_COLUMNS)


def similar_lines(docs: DataFrame, texts: DataFrame, levels: np.ndarray, t: float, buckets: int, chunk: int) -> DataFrame:
    """(uid, line) of lines similar to an earlier one. docs: uid, doc_id, text and gone (lines left out); texts: the
    bucketed table of uid, doc_id, tkey and text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(levels)  # 2^CELL_BITS bytes

    def post(batches):
        for own, uid, doc_id, gone in _chunks(batches, ["uid", "doc_id", "gone"], chunk):
            parts = []
            for doc, line, n, word in _pieces(own, gone.tolist(), shared.value):
                begin = np.cumsum(n) - n
                bit = np.uint64(1) << (word & np.uint64(63))
                half = (word & np.uint64(64)) != 0
                even = np.bitwise_xor.reduceat(bit * ~half, begin)
                odd = np.bitwise_xor.reduceat(bit * half, begin)
                # each line's words stand from rare to frequent
                size = np.minimum(prefix_size(n, t), n)
                which, at = np.repeat(np.arange(len(n)), size), _within(begin, size)
                # a cell with a single line holds a word that no other line has
                chosen = _level_of(shared.value, word[at]) > 1
                which, at = which[chosen], at[chosen]
                pos = (at - begin[which]).astype(np.uint32)
                # bits that remain of the words may only make more candidates
                parts.append((word[at] & ORDER, doc[which], line[which], n[which].astype(np.uint32), pos, even[which], odd[which]))
            if not parts:
                continue
            word, doc, *rest = _joined(parts)
            bucket, word = mix64(word) % np.uint64(buckets), word.astype(np.uint32)
            order = np.argsort(bucket << np.uint64(32) | word)
            ids = (x.to_numpy(np.int64)[doc] for x in (doc_id, uid))
            yield _rows(_by_bucket(bucket[order].astype(np.int64), [c[order] for c in (word, *ids, *rest)]))

    postings = docs.mapInPandas(post, "bucket int, n long, payload binary")
    postings = settle(postings.withColumn("chunk", F.monotonically_increasing_id()), "postings")
    # buckets of more than BLOCK postings, of very frequent words, are cut into blocks of whole payloads
    sizes = postings.groupBy("bucket").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("blocks")).filter("blocks > 1")
    sizes = settle(sizes, "blocks")  # at most a row for BLOCK postings
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = postings.join(sizes, "bucket", "left").select(
        "bucket", F.pmod(F.xxhash64("chunk"), blocks).cast("int").alias("block"), "payload", (blocks > 1).alias("split")
    )

    def likeliest(pdf: pd.DataFrame) -> pd.DataFrame:
        return _likeliest(pdf["payload"], int(pdf["bucket"].iloc[0]), t, bool(pdf["split"].iloc[0]))

    pairs = settle(dealt.groupBy("bucket", "block").applyInPandas(likeliest, _PAIRS), "partners", gather=True)
    mixed = F.xxhash64("uid", "other_uid", "other_line").alias("mixed")
    first = pairs.groupBy("uid", "line").agg(
        F.min(F.struct("far", mixed, "other_uid", "other_line")).alias("p"),
        (F.bool_or("more") | (F.min(mixed) != F.max(mixed))).alias("more"),
    )
    first = settle(first.select("uid", "line", "p.other_uid", "p.other_line", "more"), "first")
    similar = settle(_verified(first.filter("other_uid >= 0"), texts, t), "similar")
    # lines that it does not match, though there may be more partners, are compared with all of them
    open_ = first.filter("more").select("uid", "line").join(similar, ["uid", "line"], "left_anti")
    open_ = settle(pairs.select("bucket", "uid", "line").distinct().join(open_, ["uid", "line"]), "open")
    discard(pairs, first)
    if not open_.isEmpty():
        rest = settle(_rest(postings, dealt, sizes, open_, t), "rest", gather=True)
        more = settle(_verified(rest, texts, t), "similar")
        similar = similar.unionByName(more)
        discard(rest)
    discard(postings, sizes, open_)
    return similar


def _rest(postings: DataFrame, dealt: DataFrame, sizes: DataFrame, open_: DataFrame, t: float) -> DataFrame:
    """All candidates of the open lines (bucket, uid, line)."""

    def whole(p: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(o):
            return pd.DataFrame(columns=_PAIR_COLUMNS)
        own = _Postings(p["payload"])
        asks = _open_ones(own, o)
        return _frame(_candidates(own.of_words(asks.word).ordered(), asks, int(p["bucket"].iloc[0]), t))

    alone = open_.join(sizes, "bucket", "left_anti")
    found = dealt.filter("not split").groupBy("bucket").cogroup(alone.groupBy("bucket")).applyInPandas(whole, _PAIRS)
    if sizes.isEmpty():
        return found

    # in a split bucket the open lines' postings go to all its blocks
    asked = open_.join(sizes, "bucket")

    def pick(p: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(o):
            return pd.DataFrame(columns=["bucket", "payload"])
        asks = _open_ones(_Postings(p["payload"]), o)
        return pd.DataFrame({"bucket": p["bucket"].iloc[:1], "payload": [_pack(*asks.columns)]})

    def meet(p: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(o):
            return pd.DataFrame(columns=_PAIR_COLUMNS)
        asks = _Postings(o["payload"])
        own = _Postings(p["payload"]).of_words(asks.word).ordered()
        return _frame(_candidates(own, asks, int(p["bucket"].iloc[0]), t))

    everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    split = dealt.filter("split")
    lines = asked.select("bucket", everywhere, "uid", "line")
    asks = split.groupBy("bucket", "block").cogroup(lines.groupBy("bucket", "block")).applyInPandas(pick, "bucket int, payload binary")
    asks = asks.join(sizes, "bucket").select("bucket", everywhere, "payload")
    met = split.groupBy("bucket", "block").cogroup(asks.groupBy("bucket", "block")).applyInPandas(meet, _PAIRS)
    return found.unionByName(met)


def _verified(pairs: DataFrame, texts: DataFrame, t: float) -> DataFrame:
    """(uid, line) of pairs whose words have a Jaccard similarity of t or more, the other line being the earlier one."""
    pairs = pairs.select("uid", "line", "other_uid", "other_line").distinct()
    ends = pairs.select("uid", "line").union(pairs.select("other_uid", "other_line"))
    wanted = ends.groupBy("uid").agg(F.collect_set("line").alias("lines"))  # at most a text's own lines

    def read(batches):
        for pdf in batches:
            out = []
            for uid, doc_id, tkey, text, lines in zip(*(pdf[c] for c in ("uid", "doc_id", "tkey", "text", "lines")), strict=True):
                own = text.split("\n")
                out += [(uid, k, doc_id, tkey, " ".join(sorted(words_of(own[k])))) for k in lines]
            yield pd.DataFrame(out, columns=["uid", "line", "doc_id", "tkey", "words"])

    lines = texts.join(wanted, "uid").select("uid", "doc_id", "tkey", "text", "lines")
    lines = settle(lines.mapInPandas(read, "uid long, line int, doc_id long, tkey long, words string"), "lines", gather=True)
    left = lines.select("uid", "line", F.struct("doc_id", "tkey", "line").alias("at"), "words")
    right = left.toDF("other_uid", "other_line", "other_at", "other_words")
    both = pairs.join(right, ["other_uid", "other_line"]).join(left, ["uid", "line"]).filter("other_at < at")

    def verify(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["words"], pdf["other_words"], strict=True):
                a, b = set(x.split(" ")), set(y.split(" "))
                common = len(a & b)
                keep.append(common >= t * (len(a) + len(b) - common) - 1e-9)
            yield pdf.loc[keep, ["uid", "line"]]

    both = both.select("uid", "line", "words", "other_words")
    return both.mapInPandas(verify, "uid long, line int").distinct()


# --- whole documents -----------------------------------------------------------------------------------------------


def lines_removed(df: DataFrame, t: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """row (all columns of ``df``, which has doc_id and text), text (what stays), n_lines and n_removed, for all rows."""
    spark = df.sparkSession
    plain = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns if c != "text")).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    size = text_bytes(plain)
    buckets = max(shuffle_width(spark), size // BUCKET_TEXT)
    # a null text has no key, so what leaves it out need not read the texts
    numbered = plain.withColumn("tkey", F.when(F.col("text").isNotNull(), F.xxhash64("text"))).withColumn("uid", F.monotonically_increasing_id())
    # texts are moved once, by their row's number: what reads them again finds them in buckets of equal size
    docs = settle_by(numbered, ["uid"], width_for(spark, size), "texts")
    sources = docs.filter("doc_id is not null and tkey is not null").select("uid", "doc_id", "tkey", "text")
    # rows equal in id and text are one document, for which its first row stands
    keys = sources.select("uid", "doc_id", "tkey")
    repeats = keys.groupBy("doc_id", "tkey").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeats = settle(keys.join(repeats, ["doc_id", "tkey"]).filter("uid <> first").select("uid", "first"), "repeats")
    repeated = not repeats.isEmpty()
    if repeated:
        sources = sources.join(repeats, "uid", "left_anti")
    equal, levels = _equal_lines(sources, buckets, chunk)
    rest = sources.join(equal, "uid", "left").select("uid", "doc_id", "text", "gone")
    similar = similar_lines(rest, sources, levels, t, buckets, chunk)
    gone = equal.select("uid", F.explode("gone").alias("line")).unionByName(similar)
    gone = settle(gone.groupBy("uid").agg(F.collect_list("line").alias("gone")), "gone")
    if repeated:
        copies = repeats.join(gone.withColumnRenamed("uid", "first"), "first").select("uid", "gone")
        gone = gone.unionByName(copies)

    def cut(batches):
        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for text, lines in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                own = [] if text is None else text.split("\n")
                n_lines.append(len(own))
                n_removed.append(len(lines or ()))
                if lines:
                    out = set(lines)
                    text = "\n".join(x for k, x in enumerate(own) if k not in out)
                texts.append(text)
            columns = [batch.column("row"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "text", "n_lines", "n_removed"])

    row = docs.schema["row"].dataType.simpleString()
    cut_up = docs.join(gone, "uid", "left").select("row", "text", "gone")
    return cut_up.mapInArrow(cut, f"row {row}, text string, n_lines long, n_removed long")


def dedup_lines(
    df: DataFrame, t: float = 0.8, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """Remove each line whose word set is at least ``t`` similar (Jaccard) to a line before it in the corpus.

    Lines are what newlines separate; their words are lower-cased and cut at white space, and each counts once. The
    order is (doc_id, text's hash, line), and lines are judged on the input: a line that itself goes still removes
    later ones. A line without words stays. Returns doc_id, text (the lines that stay; null stays null), n_lines,
    n_removed. Rows equal in id and text are one document and lose the same lines. A row with a null id is returned as
    it is and is no source for others. A null text has no lines, an empty one has a single line without words.
    An empty table gives an empty result; other columns are ignored. Ids are whole numbers, or strings of them.

    Lines of equal 128-bit digests are taken for equal; all others are compared by their words.
    """
    named = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return lines_removed(named, t, chunk).select("row.doc_id", "text", "n_lines", "n_removed")

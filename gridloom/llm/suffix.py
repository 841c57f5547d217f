"""Removal of repeated passages with a logarithmic family of suffix arrays.

A passage of ``width`` bytes goes if it also starts in a document with a smaller id. Each document is cut into
stretches: the passages (of ``width`` bytes) around one anchor, which is the least hashed ``GRAM``-byte string in them.
Equal passages have equal anchors, so stretches dealt by anchor bring equal passages to one bucket, wherever they
stand. In a bucket stretches come in batches of ascending document id. A batch gets a suffix array of its passages,
which is scanned together with the arrays of the levels that exist; then it becomes a level itself, and levels of equal
size merge, so there are only logarithmically many.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import byte_values, mix64, settle, shuffle_width, text_chunks

GRAM = 16
#: Bytes of text for each bucket, from which the number of buckets follows.
BUCKET_TEXT = 3 << 20
#: Bytes of text in one chunk of documents.
CHUNK = 6 << 20
#: Bytes of text whose hashes are made at once, so that arrays stay in the processor's cache.
PIECE = 1 << 17
#: Passages of one batch in the index family.
BATCH = 1 << 15
#: Anchors that hold more than this share of a sample are dealt by whole passage instead, so there are at most 1/share.
HOT_SHARE = 1 / 2048


# --- stretches ---------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, by doubling."""
    h = byte_values()[data]
    factor, n = np.uint64(0xC2B2AE3D27D4EB4F), 1
    while n < GRAM:
        h = h[:-n] * factor + h[n:]
        factor, n = np.multiply(factor, factor, dtype=np.uint64), 2 * n
    return mix64(h)


def leftmost_least(h: np.ndarray, window: int) -> np.ndarray:
    """Position of the first least value (of 40 bits) in each window; of fewer than 2^24 values."""
    low = np.uint64((1 << 24) - 1)
    value, span = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while span < window:
        step = min(span, window - span)
        value = np.minimum(value[:-step], value[step:])
        span += step
    return (value & low).astype(np.int64)


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each stretch of the data, in ascending order of their starts."""
    base = np.uint64(0x9FB21C651E98DF25)
    longest = int((end - start).max()) if len(start) else 0
    n = min(PIECE + longest, len(data))
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, base)])
    back = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(pow(int(base), -1, 1 << 64)))])
    values, out = byte_values(), np.empty(len(start), np.uint64)
    edges = np.searchsorted(start, np.arange(0, len(data) + PIECE, PIECE))
    for lo, i, j in zip(range(0, len(data), PIECE), edges, edges[1:], strict=False):
        own = data[lo : lo + PIECE + longest]
        sums = np.r_[np.uint64(0), np.cumsum(values[own] * power[: len(own)])]
        a, b = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix64((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
    return out


def stretches(data: np.ndarray, offsets: np.ndarray, width: int):
    """(start, end, document, anchor hash) of the stretches of documents laid end to end."""
    n = len(data) - width + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    # a document's last bytes start no passage
    whole = np.ones(len(data), bool)
    for k in range(1, width):
        whole[np.maximum(offsets[1:] - k, 0)[offsets[1:] >= k]] = False
    new = np.zeros(len(data) + 1, bool)
    new[offsets[:-1]] = True
    starts, keys, before = [], [], -1
    for lo in range(0, n, PIECE):
        hi = min(lo + PIECE, n)
        h = gram_hashes(data[lo : hi + width - 1])
        anchor = leftmost_least(h, width - GRAM + 1)
        own = new[lo:hi]
        own[1:] |= anchor[1:] != anchor[:-1]
        own[0] |= lo + anchor[0] != before
        before = lo + anchor[-1]
        at = np.flatnonzero(own & whole[lo:hi])
        starts.append(lo + at)
        keys.append(h[anchor[at]])
    start = np.concatenate(starts)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    last = np.minimum(np.r_[start[1:] - 1, n - 1], offsets[doc + 1] - width) if len(start) else start
    return start, last + width, doc, np.concatenate(keys)


# --- the index family ---------------------------------------------------------------------------------------------


def _words(data: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Each passage as big-endian 64-bit words, whose order is the order of the bytes."""
    padded = np.r_[data, np.zeros(64, np.uint8)]
    n = -(-width // 8)
    rows = np.lib.stride_tricks.sliding_window_view(padded, 8 * n)[start].copy()
    rows[:, width:] = 0
    return rows.view(">u8").astype(np.uint64)


def suffix_array(words: np.ndarray) -> np.ndarray:
    """The order of the passages' bytes, equal ones by position."""
    return np.lexsort(words.T[::-1])


def _as_records(words: np.ndarray) -> np.ndarray:
    """Rows as byte strings that compare like their bytes."""
    return np.ascontiguousarray(words.astype(">u8")).view(f"S{8 * words.shape[1]}").ravel()


class IndexFamily:
    """Levels of sorted distinct passages; sizes at least double from one to the next."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def known(self, sorted_records: np.ndarray) -> np.ndarray:
        found = np.zeros(len(sorted_records), bool)
        for level in self.levels:
            at = np.searchsorted(level, sorted_records)
            at[at == len(level)] = 0
            found |= level[at] == sorted_records
        return found

    def add(self, sorted_records: np.ndarray) -> None:
        while self.levels and len(self.levels[-1]) <= len(sorted_records):
            both = np.concatenate([self.levels.pop(), sorted_records])
            both.sort(kind="stable")
            sorted_records = both
        if len(sorted_records):
            self.levels.append(sorted_records)


def seen_before(data: np.ndarray, start: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """For passages in ascending order of doc: whether an equal one starts in a smaller doc."""
    family, out, at = IndexFamily(), np.zeros(len(start), bool), 0
    while at < len(start):
        to = min(at + BATCH, len(start))
        if to < len(start):  # a document's passages stay in one batch
            to = int(np.searchsorted(doc, doc[to - 1], "right"))
        words, own = _words(data, start[at:to], width), doc[at:to]
        order = suffix_array(words)
        records, docs = _as_records(words[order]), own[order]
        first = np.r_[True, records[1:] != records[:-1]]
        group = np.cumsum(first) - 1
        distinct = records[first]
        known = family.known(distinct)
        hit = known[group] | (docs > docs[np.flatnonzero(first)][group])
        out[at:to][order] = hit
        family.add(distinct[~known])
        at = to
    return out


# --- on Spark ----------------------------------------------------------------------------------------------------


def _pack(*arrays, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(arrays, protocol=5))


def _unpack(data: bytes):
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return data[at]


def _spread(start: np.ndarray, end: np.ndarray, width: int):
    """Each stretch as its single passages: (index of the stretch, start)."""
    n = end - start - width + 1
    which = np.repeat(np.arange(len(n)), n)
    return which, start[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _first_by(key: np.ndarray) -> np.ndarray:
    """For each element the index of the first element with its key."""
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return first[inverse]


def _hot_anchors(docs: DataFrame, width: int) -> np.ndarray:
    """Anchors that hold more than HOT_SHARE of the stretches in a sample; only the load's balance follows from them."""

    def sample(batches):
        for pdf in batches:
            raw = [t.encode() for t in pdf["text"]]
            for lo, hi in text_chunks(raw, CHUNK):
                data = np.frombuffer(b"".join(raw[lo:hi]), np.uint8)
                _, _, doc, key = stretches(data, np.cumsum([0] + [len(r) for r in raw[lo:hi]]), width)
                pair = np.unique(np.stack([doc.astype(np.uint64), key]), axis=1)
                found, n = np.unique(pair[1], return_counts=True)
                yield pd.DataFrame({"key": found.view(np.int64), "n": n})

    sampled = docs.filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(64)) == 0)
    counted = sampled.mapInPandas(sample, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.filter(F.col("n") > max(8, total * HOT_SHARE)).collect()  # fewer than 1 / HOT_SHARE
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


def _chunks(docs: DataFrame) -> DataFrame:
    """(chunk, payload): runs of documents as they were read, of about CHUNK bytes, written once."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for pdf in batches:
            pdf = pdf.sort_values("doc_id", kind="stable")
            raw = [t.encode() for t in pdf["text"]]
            known, ids = pdf["known"].to_numpy(bool), pdf["doc_id"].to_numpy(np.int64)
            for lo, hi in text_chunks(raw, CHUNK):
                sizes = np.array([len(r) for r in raw[lo:hi]], np.int64)
                # chunks are written once and moved twice, so smaller ones are worth the time
                payload = _pack(ids[lo:hi], known[lo:hi], sizes, np.frombuffer(b"".join(raw[lo:hi]), np.uint8), level=6)
                yield pd.DataFrame({"chunk": [(part << 32) + number], "payload": [payload]})
                number += 1

    marked = docs.select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text"
    )
    return settle(marked.mapInPandas(run, "chunk long, payload binary"), "chunks")


class _Scan:
    """The stretches of a chunk. It gives the same for the same chunk, so an answer can name them by their order."""

    def __init__(self, payload: bytes, width: int, hot: np.ndarray, buckets: int):
        self.ids, self.known, sizes, self.data = _unpack(payload)
        self.offsets = np.cumsum(np.r_[0, sizes])
        start, end, doc, key = stretches(self.data, self.offsets, width)
        own = self.known[doc]
        start, end, doc, key = start[own], end[own], doc[own], key[own]
        # a stretch that a smaller document of this chunk has, byte by byte, goes without asking; the rest must meet other
        # chunks
        later = self._had_before(start, end, doc)
        if len(hot) and len(key):
            # only those of them that stay are dealt by passage, as copies would make as many passages again
            is_hot = (hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key) & ~later
            which, single = _spread(start[is_hot], end[is_hot], width)
            own = doc[is_hot][which]
            start, end = np.r_[start[~is_hot], single], np.r_[end[~is_hot], single + width]
            key = np.r_[key[~is_hot], hashes_of(self.data, single, single + width)]
            later = np.r_[later[~is_hot], self._had_before(single, single + width, own)]
            doc = np.r_[doc[~is_hot], own]
            order = np.lexsort((start, doc))
            start, end, doc, key, later = start[order], end[order], doc[order], key[order], later[order]
        self.start, self.end, self.doc, self.key, self.later = start, end, doc, key, later
        self.bucket = (mix64(key) % np.uint64(buckets)).astype(np.int64)

    def _had_before(self, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which stretches, in the order of documents, are those of a smaller document here."""
        first = _first_by(hashes_of(self.data, start, end))
        later = np.flatnonzero(self.ids[doc] > self.ids[doc[first]])
        out = np.zeros(len(start), bool)
        out[later[_equal(self.data, start[later], start[first[later]], end[later] - start[later])]] = True
        return out

    def anchors(self):
        """(bucket and anchor in one number, whether two documents have it, for each stretch its place among these)."""
        at = np.flatnonzero(~self.later)
        both = (self.bucket[at].astype(np.uint64) << np.uint64(32)) | (self.key[at] & np.uint64(0xFFFFFFFF))
        order = np.argsort(both)
        new = np.r_[True, both[order[1:]] != both[order[:-1]]] if len(at) else np.empty(0, bool)
        edges = np.flatnonzero(new)
        of = np.full(len(self.start), -1)
        of[at[order]] = np.cumsum(new) - 1
        if not len(at):
            return both, new, of
        # stretches are in the order of documents
        first, last = np.minimum.reduceat(order, edges), np.maximum.reduceat(order, edges)
        return both[order[edges]], self.ids[self.doc[at[first]]] != self.ids[self.doc[at[last]]], of

    def by_bucket(self, chosen: np.ndarray):
        """(bucket, indices) of the chosen stretches, each bucket's in their order."""
        at = np.flatnonzero(chosen)
        at = at[np.argsort(self.bucket[at], kind="stable")]
        edges = np.flatnonzero(np.r_[True, np.diff(self.bucket[at]) > 0]) if len(at) else []
        for a, b in zip(edges, [*edges[1:], len(at)], strict=False):
            yield int(self.bucket[at[a]]), at[a:b]


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the stretches of ``size`` bytes at a and at b are equal; about PIECE bytes are compared at once."""
    out, ends = np.zeros(len(a), bool), np.cumsum(size)
    edges = np.unique(np.r_[np.searchsorted(ends, np.arange(0, int(size.sum()), PIECE)), len(a)])
    for lo, hi in zip(edges, edges[1:], strict=False):
        n = size[lo:hi]
        begin = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(begin, n)
        same = data[np.repeat(a[lo:hi], n) + inside] == data[np.minimum(np.repeat(b[lo:hi], n) + inside, len(data) - 1)]
        out[lo:hi] = np.logical_and.reduceat(same, begin)
    return out


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket of anchors: which of each chunk's several documents, here or elsewhere, have."""
    parts = [_unpack(p) for p in pdf["payload"]]
    keys, place, n = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts]), return_inverse=True, return_counts=True)
    several = n > 1
    several[place[np.concatenate([p[1] for p in parts])]] = True
    ends = np.cumsum([len(p[0]) for p in parts])
    bits = [np.packbits(several[place[e - len(p[0]) : e]]).tobytes() for e, p in zip(ends, parts, strict=True)]
    return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "several": bits})


def _passages(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """One bucket of stretches as bytes. Of equal stretches those of later documents go whole; the passages of the others
    go through the index family in ascending order of documents. A negative bucket is what one chunk knows by itself."""
    if pdf["bucket"].iat[0] < 0:
        return pdf[["chunk", "payload"]].rename(columns={"payload": "found"})
    parts = [_unpack(p) for p in pdf["payload"]]
    ids, at, n, data = (np.concatenate([p[i] for p in parts]) for i in range(4))
    chunk = np.repeat(pdf["chunk"].to_numpy(np.int64), [len(p[0]) for p in parts])
    size = n.astype(np.int64) + width
    begin = np.cumsum(size) - size
    longest = int(size.max())
    rows = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(longest + 1, np.uint8)], longest + 1)[begin].copy()
    rows[np.arange(longest + 1) >= size[:, None]] = 0
    rows[:, longest] = n + 1  # stretches of different length differ
    _, group = np.unique(rows.view(f"S{longest + 1}").ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    first = order[np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])]
    gone = ids > ids[first][group]
    order = first[np.argsort(ids[first], kind="stable")]
    which, single = _spread(begin[order], (begin + size)[order], width)
    which = order[which]
    hit = seen_before(data, single, ids[which], width)
    which, place = which[hit], (single - begin[which])[hit]
    # what holds for a stretch holds for its copies in the same document
    kept = np.flatnonzero(~gone)
    kept = kept[np.argsort(group[kept], kind="stable")]
    many = np.bincount(group[kept], minlength=len(first))
    start, copies = (np.cumsum(many) - many)[group[which]], many[group[which]]
    each = np.repeat(start, copies) + np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
    which, place = kept[each], np.repeat(place, copies)
    chunks = np.r_[chunk[gone], chunk[which]]
    starts = np.r_[at[gone], (at[which] + place).astype(at.dtype)].astype(np.uint32)
    lengths = np.r_[n[gone], np.zeros(len(which), np.uint8)]
    order = np.argsort(chunks, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(chunks[order]) != 0]) if len(order) else []
    out = []
    for a, b in zip(edges, [*edges[1:], len(order)], strict=False):
        own = order[a:b]
        out.append((chunks[own[0]], _pack(starts[own], lengths[own])))
    return pd.DataFrame(out, columns=["chunk", "found"])


def repeated_passages(
    df: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False
) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts in a document with a smaller id.

    Strings are judged on the input and never cross documents; overlaps count. Returns doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256 and, if asked, kept (the remaining bytes). A null text is empty. Rows
    with a null id are returned whole and are no source for others. Rows with equal ids are one document here: they
    don't match each other. An empty table gives an empty result; other columns are ignored.

    Documents are written in chunks. Chunks ask the buckets which anchors of their stretches other documents have too,
    and send the bytes of these stretches, one for each chunk and different stretch; bytes alone decide what goes.
    Anchors that very many documents have are dealt by passage. Ids are whole numbers, or strings of them.
    """
    docs = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(df.sparkSession), size // BUCKET_TEXT)
    hot = _hot_anchors(docs, width)
    chunks = _chunks(docs)

    def ask(batches):
        for pdf in batches:
            for chunk, payload in zip(pdf["chunk"], pdf["payload"], strict=True):
                keys, several, _ = _Scan(payload, width, hot, buckets).anchors()
                bucket = (keys >> np.uint64(32)).astype(np.int64)
                edges = np.flatnonzero(np.r_[True, np.diff(bucket) > 0]) if len(bucket) else []
                out = []
                for a, b in zip(edges, [*edges[1:], len(bucket)], strict=False):
                    own = keys[a:b].astype(np.uint32)
                    out.append((int(bucket[a]), chunk, _pack(np.diff(own, prepend=np.uint32(0)), several[a:b])))
                yield pd.DataFrame(out, columns=["bucket", "chunk", "payload"])

    answers = (
        chunks.mapInPandas(ask, "bucket int, chunk long, payload binary")
        .groupBy("bucket")
        .applyInPandas(_shared, "chunk long, bucket int, several binary")
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("bucket", "several")).alias("answers"))
    )

    def send(batches):
        for pdf in batches:
            for chunk, payload, answers in zip(pdf["chunk"], pdf["payload"], pdf["answers"], strict=True):
                scan = _Scan(payload, width, hot, buckets)
                keys, _, of = scan.anchors()
                by, several = {v["bucket"]: v["several"] for v in answers}, np.zeros(len(keys) + 1, bool)
                bucket = (keys >> np.uint64(32)).astype(np.int64)
                edges = np.flatnonzero(np.r_[True, np.diff(bucket) > 0]) if len(bucket) else []
                for a, b in zip(edges, [*edges[1:], len(bucket)], strict=False):
                    several[a:b] = np.unpackbits(np.frombuffer(by[int(bucket[a])], np.uint8), count=b - a)
                n = (scan.end - scan.start - width).astype(np.uint8)
                out = [(-1 - chunk, chunk, _pack(scan.start[scan.later].astype(np.uint32), n[scan.later]))]
                for bucket, at in scan.by_bucket(several[of]):
                    bytes_ = _gather(scan.data, scan.start[at], scan.end[at])
                    out.append((bucket, chunk, _pack(scan.ids[scan.doc[at]], scan.start[at].astype(np.uint32), n[at], bytes_)))
                yield pd.DataFrame(out, columns=["bucket", "chunk", "payload"])

    # a chunk without stretches asks nothing and so has no answer; what a chunk knows by itself has a negative bucket, so
    # that all goes one way and nothing is written on it
    asked = chunks.join(answers, "chunk").mapInPandas(send, "bucket long, chunk long, payload binary")
    searched = asked.groupBy("bucket").applyInPandas(lambda pdf: _passages(pdf, width), "chunk long, found binary")
    found = searched.groupBy("chunk").agg(F.collect_list("found").alias("found"))

    def remove(batches):
        for pdf in batches:
            for payload, found in zip(pdf["payload"], pdf["found"], strict=True):
                ids, known, sizes, data = _unpack(payload)
                delta = np.zeros(len(data) + 1, np.int32)
                for f in found if found is not None else ():
                    start, n = _unpack(f)
                    np.add.at(delta, start.astype(np.int64), 1)
                    np.add.at(delta, start.astype(np.int64) + n + width, -1)
                gone = np.cumsum(delta[:-1]) > 0
                rows, at = [], 0
                for k in sizes.tolist():
                    own, text = gone[at : at + k], data[at : at + k]
                    at += k
                    kept = text[~own].tobytes()
                    spans = int((own & ~np.r_[False, own[:-1]]).sum())
                    rows.append((k, int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
                out.insert(0, "doc_id", pd.array(np.where(known, ids, 0), "Int64"))
                out.loc[~known, "doc_id"] = pd.NA
                yield out if with_kept else out.drop(columns="kept")

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return chunks.join(found, "chunk", "left").select("payload", "found").mapInPandas(remove, schema)

"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_by_id, mix64, select_text, settle, shingle_hashes_of, text_chunks, word_hashes

#: Words are runs of letters and digits, lower-cased.
_WORDS = re.compile(r"[^\W_]+")
#: Distinct item shingles that one pass holds in memory; a larger benchmark is taken in blocks of items.
BLOCK_SHINGLES = 1 << 21
#: MinHash values of a signature.
SIGNATURE = 128


def normal(text: str) -> str:
    """The words of a text, separated by single spaces."""
    return " ".join(_WORDS.findall(text.lower()))


def shingles(lines: list[str], words: int, short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the ``words``-word shingles of normal texts, and of their runs of each of the ``short`` lengths."""
    hashed = word_hashes(lines)
    found = [shingle_hashes_of(*hashed, words)]
    for length in short:
        run, line = shingle_hashes_of(*hashed, length)
        found.append((mix64(run + np.uint64(length)), line))
    own, line = (np.concatenate(x) for x in zip(*found, strict=True))
    if short:
        order = np.argsort(line, kind="stable")
        own, line = own[order], line[order]
    return own, line


def shingle_set(line: str, words: int) -> np.ndarray:
    """The distinct shingles of an item. One of fewer words is a single shingle of its own length."""
    n = len(line.split())
    if 0 < n < words:
        return shingles([line], words, (n,))[0]
    return np.unique(shingles([line], words)[0])


def words_shared(item: str, doc: str, words: int) -> float:
    """The share of an item's shingles that a document has, word by word."""
    own, other = item.split(), doc.split()
    size = min(words, len(own))
    runs = lambda w: {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    own = runs(own)
    return len(own & runs(other)) / len(own)


class ContainmentIndex:
    """Items by size, each size class with its own MinHash bands.

    Only shingles that some item has matter to containment, so a document's set is first cut down to those; what is
    left is about as large as the items it holds. The size classes of items are powers of two. For a class and a
    document's set the containment asked for gives a least Jaccard similarity, and from it the number of rows in a
    band that still finds such a pair with a chance of at least 1 - 1e-9; where no number does, the class is compared
    in full with the few items that share a shingle at all.
    """

    def __init__(self, item_ids: list, lines: list[str], sets: list[np.ndarray], words: int, containment: float):
        self.ids, self.lines, self.sets, self.containment = item_ids, lines, sets, containment
        # lengths of the items that have fewer words than a shingle
        self.short = tuple(sorted({n for n in (len(x.split()) for x in lines) if 0 < n < words}))
        self.universe = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]))
        self.salts = mix64(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        # a bitmap turns most shingles away before the exact look-up
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(self.universe))))) + 5)
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[self.universe >> np.uint64(64 - self.bits)] = True
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                self.classes.setdefault(len(s).bit_length(), []).append(i)
        self.signatures = [self.signature(s) if len(s) else None for s in sets]
        self.bands: dict[tuple[int, int], dict[bytes, list[int]]] = {}

    def signature(self, shingle_set: np.ndarray) -> np.ndarray:
        return mix64(shingle_set[None, :] ^ self.salts[:, None]).min(1)

    def within(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the shingles that some item has."""
        near = np.flatnonzero(self.bitmap[hashes >> np.uint64(64 - self.bits)])
        if not len(near) or not len(self.universe):
            return near[:0]
        at = np.minimum(np.searchsorted(self.universe, hashes[near]), len(self.universe) - 1)
        return near[self.universe[at] == hashes[near]]

    def rows(self, size_class: int, n: int) -> int:
        """Rows of a band for items of a class against a set of n shingles; 0: none is sure enough."""
        least = 1 << (size_class - 1)
        overlap = self.containment * least
        jaccard = min(1.0, overlap / max(least + n - overlap, 1e-9))
        for rows in (4, 2, 1):
            if (1 - jaccard**rows) ** (SIGNATURE // rows) < 1e-9:
                return rows
        return 0

    def _band(self, size_class: int, rows: int) -> dict[bytes, list[int]]:
        if (size_class, rows) not in self.bands:
            table: dict[bytes, list[int]] = {}
            for i in self.classes[size_class]:
                for band, key in enumerate(self.signatures[i].reshape(-1, rows)):
                    table.setdefault(band.to_bytes(2, "big") + key.tobytes(), []).append(i)
            self.bands[size_class, rows] = table
        return self.bands[size_class, rows]

    def search(self, own: np.ndarray) -> list[int]:
        """Every item that is contained to at least the asked share in a set of items' shingles, by their hashes."""
        signature, found = None, []
        for size_class, members in self.classes.items():
            if len(own) < self.containment * (1 << (size_class - 1)):
                continue
            rows = self.rows(size_class, len(own))
            if rows:
                signature = self.signature(own) if signature is None else signature
                table = self._band(size_class, rows)
                candidates = {
                    i
                    for band, key in enumerate(signature.reshape(-1, rows))
                    for i in table.get(band.to_bytes(2, "big") + key.tobytes(), ())
                }
            else:
                candidates = set(members)
            for i in sorted(candidates):
                share = np.isin(self.sets[i], own, assume_unique=True).sum() / len(self.sets[i])
                if share >= self.containment:
                    found.append(i)
        return found


def _item_blocks(items: DataFrame, words: int):
    """Blocks of (ids, normal texts, shingle sets) of at most about BLOCK_SHINGLES shingles, fetched one after the other."""

    def cut(batches):
        for pdf in batches:
            lines = [normal(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "line": lines, "set": [shingle_set(x, words).tobytes() for x in lines]})

    ids, lines, sets, held = [], [], [], 0
    for row in map_by_id(items.filter("doc_id is not null"), cut, "line string, set binary").toLocalIterator():
        ids.append(row["doc_id"])
        lines.append(row["line"])
        sets.append(np.frombuffer(row["set"], np.uint64))
        held += len(sets[-1])
        if held >= BLOCK_SHINGLES:
            yield ids, lines, sets
            ids, lines, sets, held = [], [], [], 0
    if ids:
        yield ids, lines, sets


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    words: int = 5,
    containment: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, containment): items of which a document holds at least ``containment`` of the shingles.

    The benchmark is the query set. It is held in blocks of bounded size, each sent to the tasks and searched for in
    all documents. Candidates by the shingles' hashes are verified by the words. An item with fewer than ``words`` words
    is one shingle of its own length, so it is found where its words stand in a row. A text without words (null, empty)
    is found nowhere and holds nothing. Rows with a null id on either side give no pair. Repeated documents give a pair
    each; repeated items with one id are searched for one by one and give one pair with the highest containment. Empty
    tables give an empty result; other columns are ignored.
    """
    docs = select_text(df, id_col, text_col).filter("doc_id is not null")
    items = select_text(benchmark, item_id_col, item_text_col)
    item_type = items.schema["doc_id"].dataType.simpleString()
    spark, found, last = df.sparkSession, None, None
    fields = f"item_id {item_type}, containment double"
    for ids, lines, sets in _item_blocks(items, words):
        if last is not None:
            # one block's items are held at a time
            part = settle(last[0], "contained")
            found = part if found is None else found.unionByName(part)
            last[1].unpersist()
        shared = spark.sparkContext.broadcast((ids, lines, sets))  # at most BLOCK_SHINGLES hashes and one item more

        def search(batches, shared=shared):
            ids, lines, sets = shared.value
            index = ContainmentIndex(ids, lines, sets, words, containment)
            for pdf in batches:
                rows, texts, doc_ids = [], pdf["text"].tolist(), pdf["doc_id"].tolist()
                for lo, hi in text_chunks(texts):
                    own = [normal(t) for t in texts[lo:hi]]
                    hashes, doc = shingles(own, words, index.short)
                    near = index.within(hashes)
                    hashes, doc = hashes[near], doc[near]
                    edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else []
                    for a, b in zip(edges, [*edges[1:], len(doc)], strict=False):
                        best: dict = {}
                        for i in index.search(np.unique(hashes[a:b])):
                            share = words_shared(lines[i], own[doc[a]], words)
                            if share >= containment:
                                best[ids[i]] = max(share, best.get(ids[i], 0.0))
                        rows += [(doc_ids[lo + doc[a]], item, share) for item, share in best.items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "containment"])

        last = map_by_id(docs, search, fields), shared
    if last is None:
        none = (F.lit(None).cast(item_type).alias("item_id"), F.lit(None).cast("double").alias("containment"))
        return docs.limit(0).select("doc_id", *none)
    return last[0] if found is None else found.unionByName(last[0])

"""Plain versions of the operators, for small inputs only."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import xxhash
from tokenizers import Tokenizer


def table(path):
    return pq.read_table(path).to_pylist()


class _Visible(HTMLParser):
    """Words outside hidden elements, by the library's event parser; elements are taken to be closed properly."""

    def __init__(self):
        super().__init__()
        self.stack, self.text = [], []

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        style = (own.get("style") or "").replace(" ", "").lower()
        hidden = tag in ("head", "title", "script", "style", "template", "noembed", "noframes", "iframe", "svg", "object")
        hidden = hidden or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        if tag not in ("br", "img", "hr", "meta", "link", "input", "base", "wbr", "col", "source", "track", "area", "embed", "param"):
            self.stack.append((tag, hidden))
        self.text.append(" " if tag not in INLINE else "")

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass
        self.text.append(" " if tag not in INLINE else "")

    def handle_data(self, data):
        if not any(h for _, h in self.stack):
            self.text.append(data)


INLINE = ("a", "b", "i", "em", "strong", "span", "code", "u", "small", "sub", "sup", "mark", "abbr", "label", "q", "s", "time", "font", "tt", "cite", "kbd")


def visible_words(page):
    parser = _Visible()
    parser.feed(page or "")
    parser.close()
    return Counter("".join(parser.text).split())


def token_ids(texts, name, end):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(library.encode(t or "", add_special_tokens=False).ids + [end], "<u4") for t in texts]


def pieces(doc_ids, ids, capacity=2048):
    """(doc_id, start, length, crc) of each piece: only longer documents are cut."""
    out = []
    for doc_id, own in zip(doc_ids, ids, strict=True):
        first = len(own) % capacity or capacity
        cuts = [0, len(own)] if len(own) <= capacity else [0, *range(first, len(own) + 1, capacity)]
        out += [(doc_id, a, b - a, zlib.crc32(own[a:b].tobytes())) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def best_fit_decreasing(lengths, capacity=2048):
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return len(room)


def places_taken(child, items, kept, lengths, capacity=2048):
    """Each item in the place of the smaller one where least room is left then, if that is under 8; what is displaced."""
    placed = np.flatnonzero(kept)
    bins, size = child[placed].astype(np.int64), lengths[placed]
    most = capacity - np.bincount(bins, size).astype(np.int64)[bins] + size
    out = []
    for item in items.tolist():
        length = int(lengths[item])
        left = np.where((size < length) & (most >= length), most - length, capacity)
        at = int(left.argmin())
        if left[at] >= min(8, length - int(size[at])):
            out.append(item)
            continue
        out.append(int(placed[at]))
        kept[placed[at]], kept[item], child[item] = False, True, bins[at]
        most[bins == bins[at]] -= length - int(size[at])
        placed[at], size[at] = item, length
        most[at] = int(left[at]) + length
    return out


def passages_removed(rows, width=50):
    """doc_id -> (bytes, removed, runs, sha256 of the rest), for distinct ids."""
    raw = {i: (t or "").encode() for i, t in rows}
    least: dict[bytes, int] = {}
    for i, data in raw.items():
        for at in range(len(data) - width + 1):
            s = data[at : at + width]
            least[s] = min(i, least.get(s, i))
    out = {}
    for i, data in raw.items():
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - width + 1):
            if least[data[at : at + width]] < i:
                gone[at : at + width] = True
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(data) else 0
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def simhash(text, words=4):
    own = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    runs = [own[i : i + words] for i in range(len(own) - words + 1)] or ([own] if own else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    """The smallest id that links lead to, for each position."""
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in linked:
        parent[root(i)] = root(j)
    least: dict = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[root(i)] = min(own, least.get(root(i), own))
    return [least.get(root(i)) for i in range(len(ids))]


def top_k(vectors, k=5, every=50, scale=256):
    """vectors: (id, list or None). Rows (query, rank, id, score) with whole-number arithmetic."""
    sound = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in sound:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def alnum_shingles(text, words=5):
    own = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(own[i : i + words]) for i in range(len(own) - words + 1)}


def contained(docs, items, share=0.8, words=5):
    """An item of fewer words is one shingle of its own length."""
    size = {i: min(words, len(re.findall(r"[^\W_]+", (t or "").lower()))) for i, t in items}
    parts = [(i, alnum_shingles(t, size[i])) for i, t in items if size[i]]
    out = set()
    for d, text in docs:
        own = {n: alnum_shingles(text, n) for n in {*size.values()} if n}
        out |= {(d, i, round(len(s & own[size[i]]) / len(s), 9)) for i, s in parts if s and len(s & own[size[i]]) >= share * len(s)}
    return out


def lines_gone(rows, t=0.8):
    """Positions (index of the row, line) that are similar to a line before them; rows in order."""
    holders, sets, gone = defaultdict(list), [], set()
    for d, text in enumerate(rows):
        for n, line in enumerate((text or "").split("\n") if text is not None else []):
            own = frozenset(line.lower().split())
            if not own:
                continue
            seen = {k for w in own for k in holders[w]}
            if any(len(own & sets[k]) >= t * len(own | sets[k]) - 1e-9 for k in seen):
                gone.add((d, n))
            for w in own:
                holders[w].append(len(sets))
            sets.append(own)
    return gone


def jaccard_pairs(texts, words=5, t=0.8):
    """Pairs of positions whose sets of word shingles are t similar."""
    sets = []
    for text in texts:
        own = (text or "").lower().split()
        sets.append({tuple(own[i : i + words]) for i in range(len(own) - words + 1)} or {tuple(own)})
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    common: dict = defaultdict(int)
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                common[a, b] += 1
    return {(a, b) for (a, b), n in common.items() if n >= t * (len(sets[a]) + len(sets[b]) - n) - 1e-9}

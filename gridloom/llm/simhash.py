"""SimHash near-duplicates: fingerprints of word shingles, joined by walking pairs of binary-trie nodes."""

from __future__ import annotations

import re
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_by_id, mix64, select_text, settle, shingle_hashes_of, text_chunks, width_for, word_hashes
from gridloom.llm.components import connected_components

#: Bytes, not characters, are matched: only these separate words.
_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Fingerprints that are joined with each other in one task; larger groups are cut into blocks of about this size.
GROUP = 4096
#: Node pairs that are walked at once.
FRONT = 1 << 19
#: Pairs of a pair of nodes up to which all are returned at once where each pair is to be verified.
FEW = 256


# --- fingerprints ------------------------------------------------------------------------------------------------


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 (seed 42) of the ``words``-word shingles of a text, repeats included; fewer words: the whole sequence."""
    from xxhash import xxh64_intdigest as h

    raw = b" ".join(_WORDS.findall(text.encode().translate(_LOWER)))
    if not raw:
        return []
    # after the join each space is an edge between words
    edges = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32).tolist()
    starts, ends = [0, *(e + 1 for e in edges)], [*edges, len(raw)]
    if len(ends) < words:
        return [h(raw, 42)]
    return [h(raw[a:b], 42) for a, b in zip(starts, ends[words - 1 :], strict=False)]


def fingerprint(hashes) -> int:
    """A bit is 1 if it is set in over half the hashes; no hash: zero."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    # int32 sums over contiguous columns
    over = 2 * bits.sum(0, dtype=np.int32) > len(hashes)
    return int.from_bytes(np.packbits(over).tobytes(), "big")


def fingerprints(
    df: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text", prints: int = 0
) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each whole text. With ``prints`` also the text's hash as node and
    so many fingerprints as prints: fp, then others from mixed hashes, which are as good as hashes of another seed."""
    docs = select_text(df, id_col, text_col)
    if prints:
        docs = docs.withColumn("node", F.xxhash64("text"))
    salts = mix64(np.arange(prints, dtype=np.uint64))

    def run(batches):
        for pdf in batches:
            hashes = [np.array(shingle_hashes(t, words), np.uint64) for t in pdf["text"]]
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([fingerprint(h) for h in hashes], np.uint64).view(np.int64)})
            if prints:
                out["node"] = pdf["node"]
                rest = [[fingerprint(mix64(h ^ salt)) for salt in salts[1:]] for h in hashes]
                out["prints"] = [np.r_[fp, np.array(r, np.uint64).view(np.int64)] for fp, r in zip(out["fp"], rest, strict=True)]
            yield out

    return map_by_id(docs, run, "fp long, node long, prints array<long>" if prints else "fp long")


# --- the join ----------------------------------------------------------------------------------------------------


def _blocks(budget: int) -> list[tuple[list[int], list[int]]]:
    """Ways to choose the bits of a key: with budget + 2 blocks of bits, two fingerprints within the budget agree on
    at least two blocks. For each pair of blocks: the bits of the key, then all others."""
    edges = np.linspace(0, 64, budget + 3).astype(int)
    parts = [list(range(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    out = []
    for i, j in combinations(range(len(parts)), 2):
        key = parts[i] + parts[j]
        out.append((key, [b for b in range(64) if b not in key]))
    return out


def _reorder(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """Bits of fp taken in the given order, the first one highest."""
    out = np.zeros(len(fp), np.uint64)
    for b in order:
        out = (out << np.uint64(1)) | ((fp >> np.uint64(63 - b)) & np.uint64(1))
    return out


def trie_pairs(values: np.ndarray, a0, a1, b0, b1, depth, budget: int, leaves=None):
    """Yield arrays (i, j) of links between values of the ranges a0:a1 and b0:b1, for many pairs of ranges at once.

    Each range is sorted; all values of a pair of ranges agree in their first ``depth`` bits. A range is a trie node.
    Pairs of nodes are walked together: a pair carries the number of bits in which its paths differ and is dropped
    beyond the budget. A pair whose leaves all must be within the budget (path difference plus all bits that vary
    below) yields links that connect its leaves, not their product, or what ``leaves`` yields for such pairs of ranges. A range
    paired with itself gives each pair once.
    """
    leaves = leaves or _star
    a0, a1, b0, b1, depth = (np.asarray(x, np.int64) for x in (a0, a1, b0, b1, depth))
    todo = [(a0, a1, b0, b1, np.zeros(len(a0), np.int64), depth)]
    one = np.uint64(1)
    while todo:
        a0, a1, b0, b1, err, at = todo.pop()
        if len(a0) > FRONT:
            half = len(a0) // 2
            todo += [tuple(x[:half] for x in (a0, a1, b0, b1, err, at)), tuple(x[half:] for x in (a0, a1, b0, b1, err, at))]
            continue
        own = (a0 == b0) & (a1 == b1)
        first_a, first_b = values[a0], values[b0]
        rest = np.where(at >= 64, np.uint64(0), ~np.uint64(0) >> np.minimum(at, 63).astype(np.uint64))
        # in a sorted range of one prefix the first and last differ first at the highest bit that varies
        spread = (first_a ^ values[a1 - 1]) | (first_b ^ values[b1 - 1])
        between = (first_a ^ first_b) & rest
        low = _fill(spread & rest)
        sure = err + np.bitwise_count(between | low).astype(np.int64) <= budget
        if sure.any():
            yield from leaves(a0[sure], a1[sure], b0[sure], b1[sure])
        least = err + np.bitwise_count(between & ~low)
        live = ~sure & (least <= budget) & ~(own & (a1 - a0 < 2))
        a0, a1, b0, b1, err, own, spread, between, low = (
            x[live] for x in (a0, a1, b0, b1, err, own, spread & rest, between, low)
        )
        if not len(a0):
            continue
        # go down to the highest bit that varies in either node, adding what the paths differ by on the way
        bit = np.uint64(63) - _top(low)
        err = err + np.bitwise_count(between & ~low).astype(np.int64)
        mask = one << (np.uint64(63) - bit)
        split_a, split_b = _split(values, a0, a1, mask), _split(values, b0, b1, mask)
        at = bit.astype(np.int64) + 1
        parts = []
        for sa, (p0, p1) in enumerate(((a0, split_a), (split_a, a1))):
            for sb, (q0, q1) in enumerate(((b0, split_b), (split_b, b1))):
                ok = (p0 < p1) & (q0 < q1) & (err + (sa != sb) <= budget)
                if sa > sb:
                    ok &= ~own
                parts.append(tuple(x[ok] for x in (p0, p1, q0, q1, err + (sa != sb), at)))
        todo.append(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))


def _fill(x: np.ndarray) -> np.ndarray:
    """All bits from the highest set one down."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(s))
    return x


def _top(filled: np.ndarray) -> np.ndarray:
    """Index from below of the highest set bit of a filled mask."""
    return np.bitwise_count(filled).astype(np.uint64) - np.uint64(1)


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """In each sorted range the first position with the masked bit set (all higher bits agree); bisection side by side."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        set_ = (values[np.minimum(mid, len(values) - 1)] & mask) != 0
        hi = np.where(open_ & set_, mid, hi)
        lo = np.where(open_ & ~set_, mid + 1, lo)
    return lo


def _star(a0, a1, b0, b1):
    """Links that connect every leaf of both ranges: all to the first leaf of the other one."""
    for s, t, other in ((a0, a1, b0), (b0, b1, a0)):
        n = t - s
        i = np.repeat(s, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        j = np.repeat(other, n)
        yield (i, j) if other is b0 else (j, i)


def _product(a0, a1, b0, b1):
    """All pairs of leaves, the earlier first, about FRONT at once."""
    n = a1 - a0
    i = np.repeat(a0, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    start, size = np.repeat(b0, n), np.repeat(b1 - b0, n)
    end, at = np.cumsum(size), 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + FRONT, "right")))
        k = size[at:to]
        x = np.repeat(i[at:to], k)
        y = np.repeat(start[at:to], k) + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
        at = to
        yield x[x < y], y[x < y]


def _few_or_star(a0, a1, b0, b1):
    """(i, j, more): all pairs of leaves where they are few; otherwise links that connect them, marked with more."""
    many = (a1 - a0) * (b1 - b0) > FEW
    for part, pairs in ((~many, _product), (many, _star)):
        for i, j in pairs(a0[part], a1[part], b0[part], b1[part]):
            yield i, j, np.full(len(i), pairs is _star)


def _product_of_many(a0, a1, b0, b1):
    """All pairs of leaves where ``_few_or_star`` has links only."""
    many = (a1 - a0) * (b1 - b0) > FEW
    yield from _product(a0[many], a1[many], b0[many], b1[many])


def fingerprint_links(fps: DataFrame, budget: int = 4) -> DataFrame:
    """(a, b): links that connect all fingerprints (fp, distinct) of at most ``budget`` differing bits.

    Each fingerprint goes to one group for each pair of bit blocks, keyed by those blocks' bits. A group larger than
    GROUP is dealt to blocks by hash, and each pair of blocks is a task of its own. Inside the trie nodes of which all
    leaves are within the budget only links that connect them are returned, so dense groups don't become all pairs.

    With a column print only fingerprints of one print are compared. With a column node (fp may repeat) the links are those of nodes, all pairs of them but for large
    trie nodes, whose links have true in the column more. With a column component as well, all pairs in those large
    trie nodes are returned that lie in two components.
    """
    ways = _blocks(budget)
    carried = [c for c in ("node", "component") if c in fps.columns]
    name = carried[0] if carried else "fp"
    leaves = (_star, _few_or_star, _product_of_many)[len(carried)]
    fields = "a long, b long, more boolean" if len(carried) == 1 else "a long, b long"

    def keyed(batches):
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64)
            of = pdf["print"].to_numpy(np.int32) if "print" in pdf else np.int32(0)
            out = []
            for way, (key, _) in enumerate(ways):
                out.append(
                    pd.DataFrame(
                        {
                            "fp": fp,
                            **{c: pdf[c].to_numpy(np.int64) for c in carried},
                            "way": np.broadcast_to(np.int32(way) + of * np.int32(len(ways)), len(fp)),
                            "key": _reorder(fp.view(np.uint64), key).astype(np.int64),
                        }
                    )
                )
            yield pd.concat(out)

    with_key = "".join(f"{c} long, " for c in ["fp", *carried]) + "way int, key long"
    known = fps.select("fp", *carried, *(["print"] if "print" in fps.columns else []))
    spread = settle(known.mapInPandas(keyed, with_key), "keys")
    width = width_for(fps.sparkSession, 64 * spread.count())
    large = spread.groupBy("way", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    # a lone fingerprint has no partner in its group
    sized = spread.join(large, ["way", "key"]).withColumn(
        "blocks", F.ceil(F.col("n") / F.lit(GROUP)).cast("int")
    )
    own = F.pmod(F.xxhash64(name), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sized.withColumn("own", own).select("fp", *carried, "way", "key", "own", other.alias("other")).select(
        "fp",
        *carried,
        "way",
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("is_right"),
    )
    tasks = dealt.repartition(width, "way", "key", "i", "j").sortWithinPartitions("way", "key", "i", "j")

    def join(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            mark = pdf[["way", "key", "i", "j"]].to_numpy()
            new = np.flatnonzero(np.r_[True, (mark[1:] != mark[:-1]).any(1)])
            held = pdf.iloc[new[-1] :]
            yield from groups(pdf.iloc[: new[-1]], new)
        if held is not None:
            yield from groups(held, np.array([0, len(held)]))

    def groups(pdf, edges):
        if not len(pdf):
            return
        way, fp = pdf["way"].to_numpy() % len(ways), pdf["fp"].to_numpy(np.int64).view(np.uint64)
        same, right = (pdf["i"] == pdf["j"]).to_numpy(), pdf["is_right"].to_numpy(bool)
        values = np.empty(len(fp), np.uint64)
        for w in np.unique(way):
            values[way == w] = _reorder(fp[way == w], ways[w][0] + ways[w][1])
        group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        order = np.lexsort((values, right, group))
        n_right = np.bincount(group, right, len(edges) - 1).astype(np.int64)
        start, end = np.asarray(edges[:-1]), np.asarray(edges[1:])
        middle = end - n_right
        alone = same[start]
        a0, a1 = start, np.where(alone, end, middle)
        b0, b1 = np.where(alone, start, middle), end
        full = (a0 < a1) & (b0 < b1)
        depth = np.array([len(key) for key, _ in ways])[way[start]]
        node = pdf[name].to_numpy(np.int64)[order]
        apart = pdf["component"].to_numpy(np.int64)[order] if len(carried) == 2 else None
        links, held = [], 0
        for i, j, *more in trie_pairs(values[order], a0[full], a1[full], b0[full], b1[full], depth[full], budget, leaves):
            ok = node[i] != node[j] if apart is None else apart[i] != apart[j]
            links.append(tuple(x[ok] for x in (node[i], node[j], *more)))
            held += len(links[-1][0])
            if held > FRONT:
                yield linked(links)
                links, held = [], 0
        if links:
            yield linked(links)

    def linked(links):
        a, b, *more = (np.concatenate(x) for x in zip(*links, strict=True))
        found = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), **({"more": more[0]} if more else {})})
        return found.drop_duplicates()

    return tasks.mapInPandas(join, fields)


def _verified(links: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links whose nodes' sets of ``words``-word shingles have that Jaccard similarity or more. texts: node, text."""
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()

    def run(batches):
        for pdf in batches:
            texts, sets = pdf["text"].tolist(), []
            for lo, hi in text_chunks(texts):
                lines = [" ".join(t.lower().split()) for t in texts[lo:hi]]
                short = [x if x.count(" ") < words - 1 else "" for x in lines]
                shingle, line = shingle_hashes_of(*word_hashes(lines), words)
                edges = np.searchsorted(line, np.arange(len(lines) + 1))
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    # a text of fewer words is one shingle
                    own = np.unique(shingle[a:b]) if b > a else np.array([zlib.crc32(short[i].encode())], np.uint64)
                    sets.append(own.tobytes())
            yield pd.DataFrame({"node": pdf["node"], "set": sets})

    wanted = texts.join(ends, "node", "left_semi").dropDuplicates(["node"])
    sets = wanted.select("node", "text").mapInPandas(run, "node long, set binary")
    both = links.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")

    def compare(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["sa"], pdf["sb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pdf.loc[keep, ["a", "b"]]

    return both.mapInPandas(compare, "a long, b long")


def _similar_links(nodes: DataFrame, texts: DataFrame, budget: int, words: int, similarity: float) -> DataFrame:
    """(a, b): links of similar nodes (fp, print, node) with fingerprints within the budget that connect all such nodes.

    All pairs are verified but for those of large trie nodes, of which first only some are. Any other pair of theirs
    matters only if these leave its ends in two components, so only such pairs are verified after that.
    """
    found = settle(fingerprint_links(nodes, budget).groupBy("a", "b").agg(F.bool_or("more").alias("more")), "found")
    similar = settle(_verified(found, texts, words, similarity), "similar")
    if found.filter("more").isEmpty():
        return similar
    components = connected_components(similar)
    apart = nodes.join(components, "node", "left").select("fp", "print", "node", F.coalesce("component", "node").alias("component"))
    rest = settle(fingerprint_links(settle(apart, "apart"), budget).distinct(), "rest")
    return similar.unionByName(_verified(rest, texts, words, similarity))


def near_duplicates(
    df: DataFrame,
    words: int = 4,
    budget: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float | None = None,
    similar_words: int = 5,
    prints: int = 1,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id that links of at most ``budget``
    differing bits lead to, itself included.

    A text without words (null, empty, spaces only) has fingerprint zero and is linked like any other. A row with a
    null doc_id gets its component like any other and is not a candidate for its id. Repeated rows share one
    fingerprint and so one component. With ``similarity`` a link of different texts, whether or not their fingerprints
    are equal, also needs that Jaccard similarity of the ``similar_words``-word shingle sets, so that chance links of a
    very large corpus don't count; then texts are compared that are near in any of ``prints`` fingerprints. An empty table gives an empty result; other columns are ignored.
    """
    node = "fp" if similarity is None else "node"
    docs = settle(fingerprints(df, words, id_col, text_col, 0 if similarity is None else prints), "fingerprints")
    least = F.min("doc_id").alias("least")
    both = [] if similarity is None else [F.min("prints").alias("prints")]  # of one text they are all the same
    classes = settle(docs.groupBy(node).agg(least, *both), "classes")
    if similarity is None:
        links = fingerprint_links(classes.select("fp"), budget)
    else:
        texts = select_text(df, id_col, text_col).select(F.xxhash64("text").alias("node"), "text")
        nodes = classes.select(F.posexplode("prints").alias("print", "fp"), "node")
        links = _similar_links(nodes, texts, budget, similar_words, similarity)
    components = settle(connected_components(links), "components").withColumnRenamed("node", "_node")
    labelled = classes.join(components, classes[node] == components["_node"], "left").select(
        F.col(node).alias("_node"), "least", F.coalesce("component", node).alias("component")
    )
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = labelled.join(least, "component").select(F.col("_node").alias(node), "component_id")
    return docs.join(by_class, node).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

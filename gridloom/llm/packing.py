"""Best-fit packing of documents into token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import map_by_id, select_text, settle
from gridloom.llm.tokens import text_ids

#: Pieces of one packing problem; a problem is dealt by hash, so all have about this size at any corpus size.
PROBLEM_PIECES = 2048
ISLANDS, EPOCHS, POPULATION, OFFSPRING = 3, 3, 8, 16
#: Least filled bins of each problem whose pieces are packed anew, together with those of other problems.
LOOSE = 8
#: An item takes another's place only where less room than this is left then.
CLOSE = 8
#: How far each island's first packings stray from descending order.
STRAY = (0.0, 0.15, 0.5)


def token_pieces(
    df: DataFrame, capacity: int, tokenizer: str, kind: str, id_col: str, text_col: str, end_id: int | None = 0
) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32."""
    docs = select_text(df, id_col, text_col)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def cut(batches):
        encode = text_ids(tokenizer, kind)
        for pdf in batches:
            rows: list[tuple] = []
            for i, text in enumerate(pdf["text"]):
                ids = encode(text) + end
                n = len(ids) // 4
                first = n % capacity or min(n, capacity)
                at, piece = 0, 0
                while at < n:
                    to = first if piece == 0 else at + capacity
                    rows.append((i, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at, piece = to, piece + 1
            out = pd.DataFrame(rows, columns=["row", "piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", pdf["doc_id"].take(out.pop("row").to_numpy(int)).to_numpy())
            yield out.astype({"piece": "int32"})

    return map_by_id(docs, cut, "piece int, start long, length long, ids_crc32 long")


# --- one problem -------------------------------------------------------------------------------------------------


class _Bins:
    """Open bins by the room left, so that the best fit is the lowest set bit at or above a size."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.mask = capacity, [[] for _ in range(capacity + 1)], 0

    def add(self, bin_: int, room: int) -> None:
        self.by_room[room].append(bin_)
        self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int]:
        """The bin with least room for ``size`` and its room, taken out; (-1, capacity) if there is none."""
        above = self.mask >> size
        if not above:
            return -1, self.capacity
        room = size + (above & -above).bit_length() - 1
        stack = self.by_room[room]
        bin_ = stack.pop()
        if not stack:
            self.mask ^= 1 << room
        return bin_, room


def _best_fit(lengths: list[int], order, bins: _Bins, next_bin: int, assigned: np.ndarray) -> None:
    for item in order:
        size = lengths[item]
        bin_, room = bins.take(size)
        if bin_ < 0:
            bin_, next_bin = next_bin, next_bin + 1
        assigned[item] = bin_
        bins.add(bin_, room - size)


def best_fit(lengths: np.ndarray, capacity: int, keys: np.ndarray) -> np.ndarray:
    """Best fit of all items in descending order of ``keys``: the bin of each item."""
    assigned = np.empty(len(lengths), np.int32)
    _best_fit(lengths.tolist(), np.argsort(-keys, kind="stable").tolist(), _Bins(capacity), 0, assigned)
    return assigned


def fitness(assigned: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Few bins first, then uneven fill, which leaves room that later items can use. Larger is better."""
    fill = np.bincount(assigned, lengths)
    fill = fill[fill > 0]
    return -len(fill), float(np.square(fill / capacity).sum())


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Inject whole well-filled bins of ``b`` into ``a``: bins of ``a`` with an item of theirs go, and the items so
    displaced are best-fitted into what is left."""
    fill_b = np.bincount(b, lengths)
    rank = np.where(fill_b > 0, fill_b / capacity + rng.random(len(fill_b)) * 0.05, -1)
    chosen = np.zeros(len(fill_b), bool)
    chosen[np.argsort(-rank)[: max(1, int((fill_b > 0).sum() * rng.uniform(0.1, 0.5)))]] = True
    injected = chosen[b]
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[injected]] = True
    displaced = ~injected & broken[a]
    child = np.where(injected, b + len(broken), a)
    kept = ~displaced
    items = np.flatnonzero(displaced)
    items = _replace(child, items[np.argsort(-lengths[items])], kept, lengths, capacity)
    fill = np.bincount(child[kept], lengths[kept]).astype(np.int64)
    bins = _Bins(capacity)
    for bin_ in np.flatnonzero(fill).tolist():
        bins.add(bin_, capacity - int(fill[bin_]))
    order = items[np.argsort(-lengths[items] * rng.uniform(0.9, 1.1, len(items)))]
    _best_fit(lengths.tolist(), order.tolist(), bins, len(fill), child)
    return np.unique(child, return_inverse=True)[1].astype(np.int32)


def _replace(child: np.ndarray, items: np.ndarray, kept: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A displaced item takes the place of a smaller one where it fills that bin best; the smaller one is displaced
    instead. Changes ``child`` and ``kept`` and returns the items that are displaced then."""
    placed = np.flatnonzero(kept)
    bins, size = child[placed].astype(np.int64), lengths[placed]
    by, edges = np.argsort(bins, kind="stable").tolist(), np.cumsum(np.r_[0, np.bincount(bins)]).tolist()
    # the largest item that could stand in each one's place, and the places by it
    most = (capacity - np.bincount(bins, size).astype(np.int64)[bins] + size).tolist()
    places, mask = [set() for _ in range(capacity + 1)], 0
    for at, room in enumerate(most):
        places[room].add(at)
    for room in set(most):
        mask |= 1 << room
    placed, bins, size = placed.tolist(), bins.tolist(), size.tolist()
    out = []
    for item, length in zip(items.tolist(), lengths[items].tolist(), strict=True):
        near, at, room = (mask >> length) & ((1 << CLOSE) - 1), -1, -1
        while near and at < 0:
            room = (near & -near).bit_length() - 1
            near &= near - 1
            at = min((p for p in places[length + room] if size[p] < length), default=-1)
        if at < 0 or room >= length - size[at]:
            out.append(item)
            continue
        own, more = bins[at], length - size[at]
        out.append(placed[at])
        kept[placed[at]], kept[item], child[item] = False, True, own
        placed[at], size[at] = item, length
        for p in by[edges[own] : edges[own + 1]]:
            old, new = most[p], length + room if p == at else most[p] - more
            most[p] = new
            places[old].remove(p)
            places[new].add(p)
            mask |= 1 << new
            if not places[old]:
                mask &= ~(1 << old)
    return np.array(out, np.int64)


def evolve(
    lengths: np.ndarray, capacity: int, population: list[np.ndarray], seed: list[int], offspring: int, stray: float = 0.15
):
    """Steady-state evolution: each child replaces the worst if it is better. Returns the population, best first.

    It ends early only where no packing can be better: as many bins as the total length needs.
    """
    rng = np.random.default_rng(seed)
    least = -int(-(-int(lengths.sum()) // capacity))
    population = list(population)
    done = any(fitness(p, lengths, capacity)[0] == least for p in population)
    while len(population) < POPULATION and not done:
        order = lengths * rng.uniform(1 - stray, 1 + stray, len(lengths))
        population.append(best_fit(lengths, capacity, order))
        done = fitness(population[-1], lengths, capacity)[0] == least
        stray = max(stray, 0.15)
    scored = sorted(((fitness(p, lengths, capacity), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])[::-1]
    for turn in range(offspring):
        if scored[0][0][0] >= least or len(scored) < 2:
            break
        i, j = sorted(rng.integers(0, len(scored), 2))
        i, j = (i, j) if i != j else (0, len(scored) - 1)
        a, b = (scored[i][2], scored[j][2]) if rng.random() < 0.5 else (scored[j][2], scored[i][2])
        child = crossover(a, b, lengths, capacity, rng)
        mark = fitness(child, lengths, capacity)
        if mark > scored[-1][0] and all(mark != s[0] for s in scored):
            scored[-1] = (mark, 1000 + turn, child)
            scored.sort(key=lambda x: x[:2], reverse=True)
    return [s[2] for s in scored]


# --- on Spark ----------------------------------------------------------------------------------------------------


_STATE = "problem long, island int, uids array<long>, lengths array<long>, population array<binary>, bins long, even double"


def _evolved(problems: DataFrame, capacity: int) -> DataFrame:
    """The best packing of each problem (problem, uids, lengths, population): problem, uids, lengths, bins_of.

    Each problem is evolved on ISLANDS populations that start differently; after each epoch an island gets the elite of
    its neighbour.
    """
    island = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    state = problems.select("problem", island, "uids", "lengths", "population").repartition("problem", "island")

    def epoch(number: int):
        def run(batches):
            for pdf in batches:
                out = []
                columns = ("problem", "island", "lengths", "population")
                for problem, island, lengths, population in zip(*(pdf[c] for c in columns), strict=True):
                    lengths = np.asarray(lengths, np.int64)
                    own = [np.frombuffer(p, np.int32) for p in population]
                    seed = [int(problem), int(island), number]
                    best = evolve(lengths, capacity, own, seed, OFFSPRING, STRAY[int(island) % len(STRAY)])
                    out.append((fitness(best[0], lengths, capacity), [p.tobytes() for p in best]))
                pdf["bins"], pdf["even"] = [-o[0][0] for o in out], [o[0][1] for o in out]
                pdf["population"] = [o[1] for o in out]
                yield pdf

        return run

    for number in range(EPOCHS):
        state = state.select("problem", "island", "uids", "lengths", "population").mapInPandas(epoch(number), _STATE)
        if number < EPOCHS - 1:
            ring = Window.partitionBy("problem").orderBy("island")
            whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            elite = F.col("population")[0]
            migrant = F.coalesce(F.lag(elite).over(ring), F.last(elite).over(whole))
            state = state.withColumn("population", F.concat(F.col("population"), F.array(migrant)))
    best = state.groupBy("problem").agg(
        F.max_by(
            F.struct("uids", "lengths", F.col("population")[0].alias("bins_of")), F.struct(-F.col("bins"), "even", "island")
        ).alias("best")
    )
    return best.select("problem", "best.*")


def _places(best: DataFrame, capacity: int, loose: int) -> DataFrame:
    """uid, length, sequence_id and offset of each piece; ``loose`` of each problem's least filled bins are marked."""

    def place(batches):
        for pdf in batches:
            for problem, uids, lengths, bins in zip(*(pdf[c] for c in ("problem", "uids", "lengths", "bins_of")), strict=True):
                lengths, bins = np.asarray(lengths, np.int64), np.frombuffer(bins, np.int32)
                order = np.argsort(bins, kind="stable")
                start = np.cumsum(lengths[order]) - lengths[order]
                first = np.r_[True, bins[order][1:] != bins[order][:-1]]
                fill = np.bincount(bins, lengths)
                is_loose = np.zeros(len(fill), bool)
                is_loose[np.argsort(np.where(fill > 0, fill, capacity + 1), kind="stable")[:loose]] = True
                yield pd.DataFrame(
                    {
                        "problem": problem,
                        "uid": np.asarray(uids, np.int64)[order],
                        "length": lengths[order],
                        "sequence_id": (int(problem) << 20) + bins[order].astype(np.int64),
                        "offset": start - np.repeat(start[first], np.diff(np.r_[np.flatnonzero(first), len(order)])),
                        "loose": is_loose[bins[order]],
                    }
                )

    return best.mapInPandas(place, "problem long, uid long, length long, sequence_id long, offset long, loose boolean")


def _numbered(items) -> bytes:
    """The bins of items, as they are in the first member of a population."""
    return np.unique([i["bin"] for i in items], return_inverse=True)[1].astype(np.int32).tobytes()


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give pieces (with columns length and others) a sequence_id and an offset.

    Pieces are written once with a row number and dealt by its hash to problems of about PROBLEM_PIECES pieces, each
    evolved on islands. What is lost then is mostly the room in the last bins of each problem, so the LOOSE least filled
    bins of many problems are put together and evolved once more, starting from the packing that they have.
    """
    pieces = settle(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    problems = max(1, -(-pieces.count() // PROBLEM_PIECES))
    grouped = (
        pieces.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(problems)).alias("problem"))
        .groupBy("problem")
        .agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items"))
    )
    nothing = F.array().cast("array<binary>").alias("population")
    grouped = grouped.select("problem", F.col("items.uid").alias("uids"), F.col("items.length").alias("lengths"), nothing)
    placed = _places(_evolved(grouped, capacity), capacity, LOOSE if problems > 1 else 0)
    if problems > 1:
        placed = settle(placed, "placed")
        # about as many pieces as in a problem of the first round
        groups = max(1, -(-placed.filter("loose").count() // PROBLEM_PIECES))
        again = (
            placed.filter("loose")
            .groupBy((F.lit(problems) + F.pmod(F.xxhash64("problem"), F.lit(groups))).alias("problem"))
            .agg(F.sort_array(F.collect_list(F.struct("uid", "length", F.col("sequence_id").alias("bin")))).alias("items"))
        )

        def start(batches):
            for pdf in batches:
                yield pd.DataFrame(
                    {
                        "problem": pdf["problem"],
                        "uids": [[i["uid"] for i in items] for items in pdf["items"]],
                        "lengths": [[i["length"] for i in items] for items in pdf["items"]],
                        "population": [[_numbered(items)] for items in pdf["items"]],
                    }
                )

        again = again.mapInPandas(start, "problem long, uids array<long>, lengths array<long>, population array<binary>")
        placed = placed.filter("not loose").unionByName(_places(_evolved(again, capacity), capacity, 0))
    return pieces.join(placed.select("uid", "sequence_id", "offset"), "uid").drop("uid")


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    kind: str = "byte",
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 0,
) -> DataFrame:
    """Pack whole documents into as few sequences of at most ``capacity`` tokens as the search finds.

    Returns for each piece doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the
    end id alone. Only a document longer than a sequence is cut; its first piece may be shorter than ``capacity``.
    Repeated rows are packed once each, ties are broken by the order of the written pieces, an empty table gives an
    empty result, and other columns are ignored.
    """
    return pack_pieces(token_pieces(df, capacity, tokenizer, kind, id_col, text_col, end_id), capacity)

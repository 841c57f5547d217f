"""Request generation. Every draw is a pure function of (seed, request id, draw number), so a workload can be repeated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.hashing import fnv_mod, hashes, let, normal, uniform, zipf, zipf_rank
from gridloom.sources.files import read_properties

# Fixed values of the zipfian generator that is scrambled over a fixed item space.
SCRAMBLED_ITEMS, SCRAMBLED_ZETA, ZIPF_THETA = 10_000_000_000, 26.46902820178302, 0.99


def uniform_int(key: Column, low: int, high: int, draw: int = 0) -> Column:
    """Low and high included."""
    return (F.lit(low) + F.floor(uniform(key, draw) * (high - low + 1))).cast("long")


def uniform_real(key: Column, low: float, high: float, draw: int = 0) -> Column:
    return F.lit(low) + uniform(key, draw) * (high - low)


def own_value(key: Column) -> Column:
    """A loaded value that refers to its own key."""
    return key


def drawn_value(key: Column) -> Column:
    """A loaded value without a meaning, which follows from the key so that a load can be repeated."""
    return F.pmod(key * 7919 + 17, F.lit(1_000_003))


def scrambled_zipf(key: Column, n: int, draw: int = 0, theta: float = ZIPF_THETA) -> Column:
    """A zipfian rank of a fixed item space, hashed to 0..n-1."""
    known = SCRAMBLED_ZETA if theta == ZIPF_THETA else None
    return fnv_mod(zipf(uniform(key, draw), SCRAMBLED_ITEMS + 1, theta, known), n)


def latest(key: Column, last: int, theta: float = ZIPF_THETA, draw: int = 0) -> Column:
    """Zipfian distance from the newest item."""
    return F.lit(last) - zipf(uniform(key, draw), last + 1, theta)


def discrete(u: Column, weights: dict[str, float]) -> Column:
    """A label by cumulative weights."""
    total, labels = sum(weights.values()), list(weights)

    def label(v: Column) -> Column:
        at, out = 0.0, None
        for name in labels[:-1]:
            at += weights[name] / total
            out = F.when(v < at, name) if out is None else out.when(v < at, name)
        return F.lit(labels[-1]) if out is None else out.otherwise(labels[-1])

    return let(u, label)


def mixture_normal(key: Column, components: list[tuple[float, float, float]], draw: int = 0) -> Column:
    """A normal draw (mean, deviation) from a component chosen by weight; components are (weight, mean, deviation)."""
    names = {str(i): w for i, (w, _, _) in enumerate(components)}
    values = F.array(*(F.array(F.lit(float(mean)), F.lit(float(sd))) for _, mean, sd in components))
    which = discrete(uniform(key, draw), names).cast("int")
    chosen = let(which, lambda i: F.get(values, i))
    return let(normal(key, draw + 1), lambda z: let(chosen, lambda c: c[0] + z * c[1]))


def lognormal(key: Column, mean: float, sd: float, draw: int = 0) -> Column:
    return F.exp(F.lit(mean) + normal(key, draw) * sd)


def contiguous_ack(acks: DataFrame, id_: str = "id") -> DataFrame:
    """One row, last: the highest id up to which all ids from the first on are acknowledged.

    The first gap is where an id's successor is missing, found by an anti join and a minimum, without a global order.
    """
    ids = acks.select(id_).distinct()
    after = ids.select((F.col(id_) - 1).alias(id_))
    return ids.join(after, id_, "left_anti").agg(F.min(id_).alias("last"))


@dataclass(frozen=True)
class Mix:
    """Operation shares, the way keys are drawn and how long scans are."""

    operations: dict[str, float]
    keys: str = "zipfian"
    theta: float = ZIPF_THETA
    scan_low: int = 1
    scan_high: int = 100


#: Property of each operation's share, in the order in which operations are chosen, and what a mix's file may leave out.
SHARES = {"READ": "readproportion", "UPDATE": "updateproportion", "INSERT": "insertproportion", "SCAN": "scanproportion", "READMODIFYWRITE": "readmodifywriteproportion"}
DEFAULTS = {
    "readproportion": "0.95", "updateproportion": "0.05", "insertproportion": "0", "scanproportion": "0", "readmodifywriteproportion": "0",
    "requestdistribution": "uniform", "zipfian_const": "0.99", "minscanlength": "1", "maxscanlength": "1000",
}


def mix_of(properties: dict[str, str]) -> Mix:
    """A mix from the properties of its file; an empty value counts as 0."""
    p = DEFAULTS | properties
    shares = {op: float(p[name] or 0) for op, name in SHARES.items()}
    return Mix(
        {op: share for op, share in shares.items() if share > 0},
        p["requestdistribution"], float(p["zipfian_const"]), int(p["minscanlength"]), int(p["maxscanlength"]),
    )


def read_mix_properties(spark: SparkSession, path: str) -> DataFrame:
    """mix, key, value of files in folders named mix=<name>."""
    name = F.regexp_extract("file", "mix=([^/]+)", 1)
    return read_properties(spark, path).select(name.alias("mix"), "key", "value")


def read_mixes(spark: SparkSession, path: str) -> dict[str, Mix]:
    """The mixes by name. They are parameters: a few properties each."""
    rows = read_mix_properties(spark, path).collect()
    names = sorted({r["mix"] for r in rows})
    return {n: mix_of({r["key"]: r["value"] for r in rows if r["mix"] == n}) for n in names}


def _operations(mix: Mix) -> Column:
    return discrete(uniform(F.col("req_id"), 0), mix.operations)


def _scan_length(mix: Mix) -> Column:
    length = uniform_int(F.col("req_id"), mix.scan_low, mix.scan_high, 2)
    return F.when(F.col("op") == "SCAN", length).otherwise(F.lit(0)).cast("long")


#: Ids whose requests one task draws; there are as many for each as there are mixes.
IDS_PER_TASK = 1 << 17


def _thresholds(weights: dict[str, float]) -> list[tuple[float, str]]:
    """The upper ends of the labels' shares, but for the last one's, as ``discrete`` takes them."""
    total, labels, at, out = sum(weights.values()), list(weights), 0.0, []
    for name in labels[:-1]:
        at += weights[name] / total
        out.append((at, name))
    return out


def mixed_requests(ids: DataFrame, mixes: dict[str, Mix], n_keys: int) -> DataFrame:
    """mix, req_id, op, key_index, scan_len of each mix for ids (req_id). Only loaded keys are drawn; "latest" means the
    highest of them. Draws are made once for all mixes; what differs between these, their parameters, comes as a constant."""
    kinds = sorted({(m.keys, m.theta if m.keys != "uniform" else 0.0) for m in mixes.values()})
    u, spread = F.col("u._key"), max(ids.sparkSession.sparkContext.defaultParallelism, -(-ids.count() // IDS_PER_TASK))
    draws = {name: F.col("req_id").cast("long") * 1024 + i for i, name in enumerate(("_op", "_key", "_length"))}
    drawn = ids.select("req_id").repartition(spread).withColumn("u", hashes(draws, "uniform"))
    ranks, scrambled = {}, {}
    for i, (keys, theta) in enumerate(kinds):
        if keys == "uniform":
            ranks[f"_k{i}"] = F.floor(u * n_keys).cast("long")
        elif keys == "latest":
            ranks[f"_k{i}"] = F.lit(n_keys - 1) - zipf_rank(u, n_keys, theta)
        else:
            ranks[f"_r{i}"] = zipf_rank(u, SCRAMBLED_ITEMS + 1, theta, SCRAMBLED_ZETA if theta == ZIPF_THETA else None)
            scrambled[f"_k{i}"] = F.col(f"_r{i}")
    drawn = drawn.select("req_id", F.col("u._op").alias("_op"), F.col("u._length").alias("_length"), *(v.alias(c) for c, v in ranks.items()))
    if scrambled:
        drawn = drawn.withColumn("s", hashes(scrambled, "mod", n_keys)).select("*", "s.*")
    steps = max((len(m.operations) for m in mixes.values()), default=1) - 1

    def parameters(name: str, m: Mix) -> Column:
        ends = _thresholds(m.operations)
        ends += [(None, None)] * (steps - len(ends))
        kind = kinds.index((m.keys, m.theta if m.keys != "uniform" else 0.0))
        return F.struct(
            F.lit(name).alias("mix"), F.lit(kind).alias("kind"), F.lit(list(m.operations)[-1]).alias("last"),
            F.lit(m.scan_low).cast("long").alias("low"), F.lit(m.scan_high - m.scan_low + 1).cast("long").alias("span"),
            *(F.lit(end).cast("double").alias(f"end{i}") for i, (end, _) in enumerate(ends)),
            *(F.lit(op).cast("string").alias(f"op{i}") for i, (_, op) in enumerate(ends)),
        )

    out = drawn.select("*", F.explode(F.array(*(parameters(name, m) for name, m in mixes.items()))).alias("m")).select("*", "m.*")
    op, key = F.when(F.lit(False), F.col("last")), F.when(F.lit(False), F.lit(0).cast("long"))
    for i in range(steps):
        op = op.when(F.col("_op") < F.col(f"end{i}"), F.col(f"op{i}"))
    for i in range(len(kinds)):
        key = key.when(F.col("kind") == i, F.col(f"_k{i}"))
    out = out.select("mix", "req_id", op.otherwise(F.col("last")).alias("op"), key.alias("key_index"), "low", "span", "_length")
    length = F.col("low") + F.floor(F.col("_length") * F.col("span"))
    return out.select("mix", "req_id", "op", "key_index", F.when(F.col("op") == "SCAN", length).otherwise(0).alias("scan_len"))


#: Draws of a key that is loaded already, before the last one is folded into the loaded keys.
TRIES = 8


def growing_requests(ids: DataFrame, mix: Mix, n_keys: int) -> DataFrame:
    """As ``mixed_requests`` of one mix, while inserts add keys: each takes the next index, and the other operations draw from the
    keys there are by then, in the order of req_id.

    Zipfian keys come from a space that has room for twice the inserts to be expected, so that popular keys stay popular;
    a draw of a key that does not exist yet is repeated.
    """
    from gridloom.operators.keyindex import lower_bound
    from gridloom.operators.ranking import global_rank

    share = mix.operations.get("INSERT", 0) / sum(mix.operations.values())
    space = n_keys + int(ids.count() * share * 2)
    chosen = ids.select("req_id", _operations(mix).alias("op"))
    inserts = global_rank(chosen.filter("op = 'INSERT'"), "req_id", [], "rank")
    added = inserts.select("req_id", "op", (F.col("rank") - 1 + n_keys).alias("key_index"))
    k, there = F.col("req_id"), F.col("before") + n_keys
    others = lower_bound(chosen.filter("op <> 'INSERT'"), inserts.select(F.col("req_id").alias("key")), "req_id", "before")
    if mix.keys == "uniform":
        key = F.floor(uniform(k, 1) * n_keys)
    elif mix.keys == "latest":
        # the distance is drawn for the keys that were loaded
        key = there - 1 - zipf(uniform(k, 1), n_keys, mix.theta)
    else:
        tries = F.array(*(scrambled_zipf(k, space, 3 + i, mix.theta) for i in range(TRIES)))
        key = F.coalesce(F.get(F.filter(tries, lambda x: x < there), F.lit(0)), F.get(tries, F.lit(TRIES - 1)) % there)
    drawn = others.select("req_id", "op", key.cast("long").alias("key_index")).unionByName(added)
    return drawn.select("req_id", "op", "key_index", _scan_length(mix).alias("scan_len"))


def box_requests(ids: DataFrame, x: Column, y: Column, w: Column, h: Column) -> DataFrame:
    """req_id, l, r, b, t, rounded so that engines agree on the last digits."""
    drawn = ids.select("req_id", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    at = lambda c: F.round(c, 6)
    return drawn.select(
        "req_id", at(F.col("x")).alias("l"), at(F.col("x") + F.col("w")).alias("r"), at(F.col("y")).alias("b"), at(F.col("y") + F.col("h")).alias("t")
    )


def run_mixed(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """(req_id, op, result): reads give the value, scans the number found, inserts and updates the value written,
    read-modify-writes the value read. Reads see the loaded keys."""
    from gridloom.operators.keyindex import lookup, scan_many

    point = requests.filter(F.col("op").isin("READ", "READMODIFYWRITE"))
    read = lookup(point.select("req_id", "op", "key"), keys).select("req_id", "op", F.col("value").alias("result"))
    scans = requests.filter("op = 'SCAN'")
    scanned = scan_many(scans, keys).select("req_id", F.lit("SCAN").alias("op"), F.col("n").alias("result"))
    written = requests.filter(F.col("op").isin("INSERT", "UPDATE")).select("req_id", "op", F.col("value").alias("result"))
    return read.unionByName(scanned).unionByName(written)


def apply_writes(keys: DataFrame, requests: DataFrame) -> DataFrame:
    """The key table after inserts, updates and read-modify-writes: the last write of a key wins, loaded values are first."""
    from gridloom.operators.keyindex import upsert_latest

    writes = requests.filter(F.col("op").isin("INSERT", "UPDATE", "READMODIFYWRITE"))
    log = keys.select("key", "value", F.lit(-1).cast("long").alias("seq")).unionByName(
        writes.select("key", "value", F.col("req_id").alias("seq"))
    )
    return upsert_latest(log)


def systematic_sample(df: DataFrame, order: str) -> DataFrame:
    """Drop every fourth row, then keep every fourth of the rest; positions follow ``order``."""
    from gridloom.operators.ranking import global_rank

    ranked = global_rank(df, order, [], "_p")
    zero = F.col("_p") - 1
    # without the dropped ones (positions 0, 4, 8, ...) position p becomes p - p/4 - 1
    after = zero - F.floor(zero / 4) - 1
    return ranked.filter((zero % 4 != 0) & (after % 4 == 0)).drop("_p")



"""Reproducible hashing and draws. A 64-bit unsigned hash is two longs of 32 bits, so nothing overflows in ANSI mode."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the FNV-1a hash of 64 bits.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME_LOW = 0x1B3  # the prime is 2^40 + this

_LOW = 0xFFFFFFFF


def let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it; keeps expression trees from growing with each use."""
    return F.transform(F.array(value), f)[0]


def _fnv(value: Column) -> Column:
    """struct(high, low): 32 bits each of FNV-1a over the eight octets of a long, lowest octet first."""
    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("long").alias("high"), F.lit(FNV_OFFSET & _LOW).cast("long").alias("low"))
    mask = F.lit(_LOW)

    def step(h: Column, octet: Column) -> Column:
        mixed = lambda low: F.struct(
            # times 2^40 + prime low: the low half also moves to the high half, eight bits up
            (h["high"] * FNV_PRIME_LOW + F.shiftrightunsigned(low * FNV_PRIME_LOW, 32) + F.shiftleft(low, 8)).bitwiseAND(mask).alias("high"),
            (low * FNV_PRIME_LOW).bitwiseAND(mask).alias("low"),
        )
        return let(h["low"].bitwiseXOR(octet), mixed)

    octets = lambda v: F.array(*(F.shiftrightunsigned(v, 8 * i).bitwiseAND(F.lit(255).cast("long")) for i in range(8)))
    return let(value.cast("long"), lambda v: F.aggregate(octets(v), start, step))


def fnv64_parts(value: Column) -> tuple[Column, Column]:
    """(high, low) 32 bits of the hash."""
    return _fnv(value)["high"], _fnv(value)["low"]


def fnv64(value: Column) -> Column:
    """The hash as DECIMAL(20,0)."""
    wide = lambda c: c.cast("decimal(20,0)")
    return let(_fnv(value), lambda h: (wide(h["high"]) * wide(F.lit(1 << 32)) + wide(h["low"])).cast("decimal(20,0)"))


def fnv_mod(value: Column, n: int) -> Column:
    """The hash modulo n (below 2^31), as a long."""
    return let(_fnv(value), lambda h: ((h["high"] % n) * ((1 << 32) % n) + h["low"] % n) % n)


def uniform(key: Column, draw: int, seed: int = 0) -> Column:
    """A draw in [0, 1): a pure function of (seed, key, draw index), with 31 bits from the hash."""
    return F.shiftrightunsigned(_fnv(key * 1024 + (seed * 64 + draw))["high"], 1).cast("double") / float(1 << 31)


def hashes(columns: dict[str, Column], finish: str, modulus: int = 1) -> Column:
    """struct of the same draws as ``uniform`` ("uniform": columns are key * 1024 + draw) or ``fnv_mod`` ("mod") makes of
    each column, in batches of many rows; for tables where hashing is most of the work."""
    names, offset, prime = list(columns), FNV_OFFSET, (1 << 40) + FNV_PRIME_LOW

    @F.pandas_udf(", ".join(f"{c} {'double' if finish == 'uniform' else 'long'}" for c in names))
    def batch(*values: pd.Series) -> pd.DataFrame:
        out = {}
        for name, value in zip(names, values, strict=True):
            v = value.to_numpy(np.int64).view(np.uint64)
            h = np.full(len(v), offset, np.uint64)
            for i in range(8):
                h = (h ^ ((v >> np.uint64(8 * i)) & np.uint64(255))) * np.uint64(prime)
            out[name] = (h >> np.uint64(33)) / 2.0**31 if finish == "uniform" else (h % np.uint64(modulus)).astype(np.int64)
        return pd.DataFrame(out)

    return batch(*columns.values())


def normal(key: Column, draw: int, seed: int = 0) -> Column:
    """Standard normal draw by Box-Muller from draws ``draw`` and ``draw`` + 1."""
    u, v = uniform(key, draw, seed), uniform(key, draw + 1, seed)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)


@lru_cache(maxsize=64)
def zeta(n: int, theta: float) -> float:
    """Sum of 1 / i^theta for i = 1..n; beyond a million terms by Euler-Maclaurin."""
    exact = min(n, 1_000_000)
    total = math.fsum(1.0 / i**theta for i in range(1, exact + 1))
    if n > exact:
        a, b = exact, n
        total += math.log(b / a) if theta == 1 else (b ** (1 - theta) - a ** (1 - theta)) / (1 - theta)
        total += (b**-theta - a**-theta) / 2
    return total


def zipf_constants(n: int, theta: float, zeta_n: float | None = None) -> tuple[float, float, float]:
    """(zeta_n, eta, alpha) of the inverse transform for ranks 0..n-1."""
    zn = zeta(n, theta) if zeta_n is None else zeta_n
    eta = (1 - (2.0 / n) ** (1 - theta)) / (1 - zeta(2, theta) / zn)
    return zn, eta, 1.0 / (1.0 - theta)


def zipf(u: Column, n: int, theta: float = 0.99, zeta_n: float | None = None) -> Column:
    """Rank 0..n-1 of a uniform draw (any positive theta but 1)."""
    return let(u, lambda v: zipf_rank(v, n, theta, zeta_n))


def zipf_rank(u: Column, n: int, theta: float = 0.99, zeta_n: float | None = None) -> Column:
    """The same of a draw that is a column already, so that it may be used more than once."""
    zn, eta, alpha = zipf_constants(n, theta, zeta_n)
    tail = F.floor(F.lit(float(n)) * F.pow(F.lit(eta) * u - eta + 1, F.lit(alpha)))
    return (
        F.when(u * zn < 1.0, F.lit(0))
        .when(u * zn < 1.0 + 0.5**theta, F.lit(1))
        .otherwise(F.least(tail, F.lit(n - 1)))
        .cast("long")
    )

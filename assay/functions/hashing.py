"""Pseudo-random numbers that are pure functions of keys.

rand(seed) depends on how rows are partitioned and on task retries; these do not.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus and multipliers of the integer mixer. All intermediate
# products stay below 2**62, so any engine with 64-bit integers agrees.
MIX_MODULUS = 2147483647
MIX_FIRST = 48271
MIX_SECOND = 69621
MIX_OFFSET = 1013904223


def md5_key(seed, *cols) -> Column:
    """Text that orders rows like a seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def md5_uniform(seed, *cols) -> Column:
    """Uniform in [0, 1) from the first 32 bits of md5(seed:key...)."""
    return F.conv(F.substring(md5_key(seed, *cols), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def md5_bits(key: Column) -> Column:
    """The first 32 bits of an md5 text as a number."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def md5_key_sql(seed, *cols) -> str:
    return "md5(concat_ws(':', '%s', %s))" % (seed, ", ".join(f"cast({c} as varchar)" for c in cols))


def md5_uniform_sql(seed, *cols) -> str:
    return f"(cast('0x' || substr({md5_key_sql(seed, *cols)}, 1, 8) as bigint) / 4294967296.0::double)"


def unit_key(unit: Column) -> tuple[Column, Column]:
    """Two 28-bit integers from the md5 of a unit's text: any type is a unit. NULL is one, the same as the empty text."""
    digest = F.md5(F.coalesce(unit.cast("string"), F.lit("")))
    return tuple(F.conv(F.substring(digest, at, 7), 16, 10).cast("bigint") for at in (1, 8))


def unit_key_sql(unit: str, high: str, low: str) -> str:
    digest = f"md5(coalesce(cast({unit} as varchar), ''))"
    return f"cast('0x' || substr({digest}, 1, 7) as bigint) as {high}, cast('0x' || substr({digest}, 8, 7) as bigint) as {low}"


#: Steps of the mixer: name and expression over high, low, rep and the steps before, each modulo MIX_MODULUS.
MIX_STEPS = [
    ("ma", lambda v, mod: mod(v["high"] * MIX_FIRST + MIX_OFFSET)),
    ("mb", lambda v, mod: mod((v["rep"] + 1) * MIX_SECOND + MIX_OFFSET)),
    ("mc", lambda v, mod: mod(v["low"] * MIX_SECOND + MIX_OFFSET)),
    ("md", lambda v, mod: mod(v["ma"] * mod(v["ma"] + v["mb"]))),
    ("me", lambda v, mod: mod(v["md"] * mod(v["md"] + v["mc"]) + v["ma"])),
    ("mf", lambda v, mod: mod(v["me"] * mod(v["me"] + v["mb"]) + v["mc"])),
    ("mg", lambda v, mod: mod(v["mf"] * mod(v["mf"] + v["md"]) + v["mb"])),
]
#: Mixed values are below this: two steps side by side.
MIX_TOP = MIX_MODULUS * MIX_MODULUS


def with_mixed(df, high: Column, low: Column, rep: Column, name: str):
    """df with a number in [0, MIX_TOP) that is a function of the unit and the replicate."""
    def mod(x):
        return F.pmod(x, F.lit(MIX_MODULUS).cast("bigint"))

    df = df.withColumns({"_high": high, "_low": low, "_rep": rep.cast("bigint")})
    for step, make in MIX_STEPS:
        at = {"high": F.col("_high"), "low": F.col("_low"), "rep": F.col("_rep")} | {s: F.col(f"_{s}") for s, _ in MIX_STEPS}
        df = df.withColumn(f"_{step}", make(at, mod))
    return df.withColumn(name, F.col("_mf") * MIX_MODULUS + F.col("_mg")).drop("_high", "_low", "_rep", *[f"_{s}" for s, _ in MIX_STEPS])


def _each_rep(make, kind: pa.DataType, ddl: str, high: Column, low: Column, reps: int) -> Column:
    """Array over the replicates of make(high, low, replicates): one row in, one out, whatever their number."""
    @F.arrow_udf(ddl)
    def rows(highs: pa.Array, lows: pa.Array) -> pa.Array:
        values = make(highs.to_numpy(zero_copy_only=False)[:, None], lows.to_numpy(zero_copy_only=False)[:, None], np.arange(reps)[None, :])
        starts = np.arange(0, values.size + 1, reps, dtype=np.int32)
        return pa.ListArray.from_arrays(starts, pa.array(values.ravel(), kind))

    return rows(high, low)


def mixed_each(high: Column, low: Column, reps: int) -> Column:
    """A number in [0, MIX_TOP) per replicate 0, 1, ..., each a function of the unit and the replicate.

    The steps name one another, so as columns they would be written out into one expression of hundreds of terms for every
    use; numpy takes each once.
    """
    return _each_rep(mix_array, pa.int64(), "array<bigint>", high, low, reps)


def poisson_each(high: Column, low: Column, reps: int) -> Column:
    """Poisson(1) weights of a unit per replicate 0, 1, ..."""
    return _each_rep(poisson_weight_array, pa.int8(), "array<tinyint>", high, low, reps)


def mix_array(high: np.ndarray, low: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The same for numpy integers; the arguments broadcast."""
    at = {"high": high.astype(np.int64), "low": low.astype(np.int64), "rep": rep.astype(np.int64)}
    for step, make in MIX_STEPS:
        at[step] = make(at, lambda x: x % MIX_MODULUS)
    return at["mf"] * MIX_MODULUS + at["mg"]


class _Sql(str):
    def __mul__(self, other):
        return _Sql(f"({self} * {other})")

    def __add__(self, other):
        return _Sql(f"({self} + {other})")


def mix_sql(high: str, low: str, rep: str, name: str) -> str:
    """Select items of the same number; each step is a column that the next ones name."""
    at = {"high": _Sql(f"cast({high} as bigint)"), "low": _Sql(f"cast({low} as bigint)"), "rep": _Sql(f"cast({rep} as bigint)")} | {s: _Sql(s) for s, _ in MIX_STEPS}
    items = [f"{make(at, lambda x: _Sql(f'({x} % {MIX_MODULUS})'))} as {step}" for step, make in MIX_STEPS]
    return ", ".join([*items, f"mf * {MIX_MODULUS} + mg as {name}"])


@lru_cache(None)
def poisson_cuts() -> list[int]:
    """Mixer values at which a Poisson(1) weight steps from k to k + 1, as far as its 62 bits tell them apart."""
    with localcontext() as context:
        context.prec = 60
        total, term, cuts, k = Decimal(0), Decimal(-1).exp(), [], 0
        while True:
            total += term
            cut = int(total * MIX_TOP)
            if cut >= MIX_TOP or (cuts and cut == cuts[-1]):
                return cuts
            cuts.append(cut)
            k += 1
            term /= k


def poisson_weight(mixed: Column) -> Column:
    """Poisson(1) weight of a mixer value: the large-N form of drawing N of N rows with replacement."""
    return sum(((mixed >= F.lit(cut)).cast("int") for cut in poisson_cuts()), F.lit(0))


@lru_cache(None)
def _cells() -> tuple[np.ndarray, np.ndarray]:
    """Weight at the start of each of 2**16 equal cells of the mixer's range, and whether a cut lies inside the cell."""
    cuts, edges = np.array(poisson_cuts()), np.arange((1 << 16) + 1) << 46
    weights = np.searchsorted(cuts, edges, side="right")
    return weights[:-1].astype(np.int8), np.searchsorted(cuts, edges[1:] - 1, side="right") != weights[:-1]


#: Rows that are mixed together, so that the steps stay in the processor's cache.
_ROWS = 1024


def poisson_weight_array(high: np.ndarray, low: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Weights; the arguments broadcast, as columns of rows and a row of replicates do."""
    weights, open_ = _cells()
    cuts = np.array(poisson_cuts())
    shape = np.broadcast_shapes(high.shape, low.shape, rep.shape)
    out = np.empty(shape, np.int8)
    for at in range(0, shape[0], _ROWS):
        mixed = mix_array(*(x[at : at + _ROWS] if x.ndim == len(shape) and len(x) == shape[0] else x for x in (high, low, rep)))
        cell = mixed >> 46
        own = weights[cell]
        # only in a cell that holds a cut the whole number decides
        near = open_[cell]
        own[near] = np.searchsorted(cuts, mixed[near], side="right")
        out[at : at + _ROWS] = own
    return out


def poisson_weight_sql(mixed: str) -> str:
    return "(" + " + ".join(f"({mixed} >= {cut})::int" for cut in poisson_cuts()) + ")"

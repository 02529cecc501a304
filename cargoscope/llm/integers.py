"""Vectors of whole numbers, exact at any size.

``whole`` gives floor(scale * x) of every component as doubles, which hold such a number exactly
whatever its size.  Tasks then work on 64-bit floating numbers where no product or sum of a
comparison can leave their exact range, and on Python's whole numbers elsewhere.  Sums travel as
limbs of 40 bits in arrays of longs, which Spark adds up.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 40  # bits of a limb; 2**23 partial sums can be added
COUNTS = 48  # bits of the number of vectors that may be summed
EXACT = 2**52  # doubles below are exact, with a bit to spare
LONGEST = 2**63 - 1


def whole(vector: str | Column, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles; null where a component is null or not finite."""
    e = F.col(vector) if isinstance(vector, str) else vector
    # Where scale * x leaves the doubles, x counts as not finite.
    fits = F.forall(e, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < float("inf"), F.lit(False)))
    up = lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)  # noqa: E731  larger doubles are whole
    return F.when(fits, F.transform(e, lambda x: up(x.cast("double") * scale)))


def largest(vectors: DataFrame, column: str) -> int:
    """The largest absolute component of a table of vectors; 0 without any."""
    top = vectors.agg(F.max(F.array_max(F.transform(column, F.abs)))).first()[0]
    return int(top or 0)


def is_exact(top: int, dim: int) -> bool:
    """Whether squared distances between vectors of components up to ``top`` are exact in doubles."""
    return 4 * max(dim, 1) * top * top < EXACT


_INT = np.frompyfunc(int, 1, 1)


def matrix(values: np.ndarray, exact: bool) -> np.ndarray:
    """Doubles that hold whole numbers, as numbers to compute with."""
    return values if exact else _INT(values).astype(object)


def rows(column: pa.Array, dim: int) -> np.ndarray:
    """A column of equally long lists of doubles as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(column), dim)


def to_ints(values: np.ndarray) -> np.ndarray:
    """Exact doubles or Python's numbers as numbers whose sums stay exact."""
    return values if values.dtype == object else values.astype(np.int64)


def long(values: np.ndarray) -> pa.Array:
    """A column of longs; null where a number does not fit."""
    if values.dtype != object:
        return pa.array(np.rint(values).astype(np.int64), pa.int64())
    return pa.array([int(v) if -LONGEST <= v <= LONGEST else None for v in values.tolist()], pa.int64())


def n_limbs(top: int) -> int:
    return -(-(top.bit_length() + COUNTS + 1) // LIMB)


def limbs(values, n: int) -> list[int]:
    """Whole numbers as ``n`` limbs each, the lowest first; the highest carries the sign."""
    out = []
    for v in values:
        v = int(v)
        for _ in range(n - 1):
            out.append(v & ((1 << LIMB) - 1))
            v >>= LIMB
        out.append(v)
    return out


def from_limbs(parts: list[int]) -> int:
    return sum(p << (LIMB * i) for i, p in enumerate(parts))


def means(partial: DataFrame, keys: list[str], n: int) -> dict[tuple, list[int]]:
    """floor(sum / count) per key and position, from rows (keys, n, sums) of counts and limbs of sums.

    Keys and positions are bounded by the model (entries times components), whatever the rows.
    """
    counts = {tuple(r[k] for k in keys): r.n for r in partial.groupBy(*keys).agg(F.sum("n").alias("n")).collect()}
    spread = partial.select(*keys, F.posexplode("sums").alias("at", "value")).groupBy(*keys, "at").agg(F.sum("value").alias("value"))
    sums: dict[tuple, dict[int, int]] = {}
    for r in spread.collect():
        sums.setdefault(tuple(r[k] for k in keys), {})[r["at"]] = r["value"]
    out = {}
    for key, count in counts.items():
        flat = [sums[key][i] for i in range(len(sums[key]))]
        out[key] = [from_limbs(flat[i:i + n]) // count for i in range(0, len(flat), n)]
    return out


def digest(numbers) -> str:
    """Lowercase hex sha256 of decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in numbers).encode()).hexdigest()


def total(column: str) -> Column:
    """Sum of a column of longs; null where it, or one of its parts, does not fit a long."""
    held = F.sum(F.col(column).cast("decimal(38,0)"))
    return F.when((F.count(column) == F.count("*")) & (F.abs(held) <= F.lit(LONGEST)), held.cast("long"))

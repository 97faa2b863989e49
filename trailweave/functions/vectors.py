"""Vector functions as column expressions on array<double>."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similarity(a: Column, b: Column, bandwidth: float = 1.0) -> Column:
    """exp(-bandwidth |a - b|) of unit vectors; null: 0, both zero: 1, one zero: 0."""
    na, nb = norm(a), norm(b)
    return (
        F.when(a.isNull() | b.isNull(), 0.0)
        .when((na == 0) & (nb == 0), 1.0)
        .when((na == 0) | (nb == 0), 0.0)
        .otherwise(F.exp(-bandwidth * distance(unit(a), unit(b))))
    )


def planes(n_planes: int, dim: int, seed: int = 0) -> list[list[float]]:
    """Seeded hyperplanes, the same for every session."""
    if not 1 <= n_planes <= 62:
        raise ValueError("1 to 62 planes fit a bigint")
    return np.random.default_rng(seed).standard_normal((n_planes, dim)).tolist()


def sign_planes(n_planes: int, dim: int, seed: int = 0) -> list[list[int]]:
    """Planes with normals of 1 and -1, by the first hex digit of an MD5 of seed, plane and place: the same in any language."""
    sign = lambda p, k: 1 if hashlib.md5(f"{seed}:{p}:{k}".encode()).hexdigest()[0] < "8" else -1
    return [[sign(p, k) for k in range(dim)] for p in range(n_planes)]


def sign_code(v: Column, hyperplanes: list[list[float]]) -> Column:
    """Signs of the products as bits, the first plane's highest."""
    each = F.array(*[F.array(*map(F.lit, p)) for p in hyperplanes])
    bit = lambda p: F.aggregate(F.zip_with(v, p, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) >= 0
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda c, p: F.shiftleft(c, 1).bitwiseOR(bit(p).cast("bigint")))


def probe_codes(code: Column, n_planes: int, radius: int) -> Column:
    """All codes within ``radius`` flipped bits."""
    masks = [sum(1 << p for p in flips) for r in range(radius + 1) for flips in combinations(range(n_planes), r)]
    return F.transform(F.array(*map(F.lit, masks)).cast("array<bigint>"), lambda m: code.bitwiseXOR(m))

"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

Vectors become whole numbers, floor(SCALE * c) (a number added to all would change nothing
below), so their scatter n * sum(x x') - S S' is exact, whatever the
order of summation. Its characteristic polynomial is worked out modulo many primes, each in
a task (Hessenberg form), and put together by Chinese remainders. All its roots are real, so
signs in the coefficients of p(x + a) count the roots above a exactly, repeated ones too;
halving by that count gives an eigenvalue to BITS bits. Components are null vectors of
scatter - eigenvalue, by inverse iteration in whole numbers of fixed point, one eigenvalue a task.

What reaches the driver is of the size of the scatter, dimensions squared, and never of the rows.

Rows whose vector is null, holds null or non-finite entries, or an entry too large for a
long after scaling are left out, and so are rows of another length than the most frequent one
(of the longest, where lengths are as frequent). Rows repeated in full count as often as they stand there.
Components belong to eigenvalues above zero, so there are as many as the vectors span
directions, and none for fewer than two different vectors; then, as for an empty table, no rows
come back. In eigenspaces of several dimensions some orthonormal basis is taken. A deviation beyond
a long is null.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle

SCALE = 1024
LIMB, LIMBS = 40, 6
BITS, FIXED = 200, 420


def whole(batch: pa.RecordBatch, column: str, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that count in a batch, and floor(SCALE * c) of their entries: int64. dims None: a row's length instead of its entries."""
    a = batch.column(column)
    sizes = np.asarray(a.value_lengths().fill_null(-1)) if len(a) else np.zeros(0, np.int64)
    flat = a.flatten()
    null = np.asarray(flat.is_null())
    with np.errstate(over="ignore"):
        scaled = np.floor(np.asarray(flat.fill_null(0).cast(pa.float64())) * SCALE)
    bad = np.concatenate([[0], np.cumsum(null | ~(np.abs(scaled) < 2.0 ** 62))])
    stops = np.cumsum(np.maximum(sizes, 0))
    fine = (sizes > 0) & (bad[stops] == bad[stops - np.maximum(sizes, 0)])
    if dims is None:
        return np.flatnonzero(fine), sizes[fine]
    keep = np.flatnonzero(fine & (sizes == dims))
    at = (stops[keep] - dims)[:, None] + np.arange(dims)
    return keep, scaled[at].astype(np.int64)


def gram(y: np.ndarray) -> np.ndarray:
    """y' y, exact; in floating point or 64 bits where these hold it."""
    top = int(np.abs(y).max(initial=0)) ** 2 * len(y)
    if top < 1 << 53:
        z = y.astype(float)
        return (z.T @ z).astype(np.int64).astype(object)
    if top >= 1 << 63:
        y = y.astype(object)
    return (y.T @ y).astype(object)


def dimensions(rows: DataFrame, column: str) -> int | None:
    """The most frequent length of a vector that counts."""
    def run(batches):
        counts: dict[int, int] = {}
        for b in batches:
            for k, n in zip(*np.unique(whole(b, column)[1], return_counts=True)):
                counts[int(k)] = counts.get(int(k), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["dims", "n"])
    found = rows.select(column).mapInArrow(run, "dims int, n bigint").groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    return found and found.dims


def scatter(rows: DataFrame, column: str, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums S and n * sum(x x') - S S' in whole numbers. Tasks send each cell once, in limbs that the JVM sums."""
    i, j = np.triu_indices(dims)

    def run(batches):
        n, sums, cells = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for b in batches:
            _, y = whole(b, column, dims)
            if len(y):
                n, sums, cells = n + len(y), sums + np.array([int(v) for v in _column_sums(y)], object), cells + gram(y)
        values = [n, *sums, *cells[i, j]]
        limbs = [[(int(v) >> (LIMB * k)) & ((1 << LIMB) - 1) if k < LIMBS - 1 else int(v) >> (LIMB * k) for v in values] for k in range(LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), *[pa.array(x, pa.int64()) for x in limbs]], names=["cell", *[f"l{k}" for k in range(LIMBS)]])
    got = rows.select(column).mapInArrow(run, "cell int, " + ", ".join(f"l{k} bigint" for k in range(LIMBS)))
    got = got.groupBy("cell").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()
    total = {r.cell: sum(r[f"l{k}"] << (LIMB * k) for k in range(LIMBS)) for r in got}
    n, s = total.get(0, 0), [total.get(1 + k, 0) for k in range(dims)]
    m = [[0] * dims for _ in range(dims)]
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        m[a][b] = m[b][a] = n * total.get(1 + dims + k, 0) - s[a] * s[b]
    return n, s, m


def _column_sums(y: np.ndarray) -> np.ndarray:
    return y.sum(0) if int(np.abs(y).max(initial=0)) * len(y) < 1 << 62 else y.astype(object).sum(0)


def is_prime(n: int) -> bool:
    """Exact below 3.4e14."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7, 11, 13, 17)):
        return n in (2, 3, 5, 7, 11, 13, 17)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    return all(any(pow(a, odd << k, n) == (n - 1 if k or pow(a, odd, n) != 1 else 1) for k in range(twos)) for a in (2, 3, 5, 7, 11, 13, 17))


def primes(bits: int) -> list[int]:
    """Primes below 2**31 whose product has more bits."""
    out, size, p = [], 0.0, 1 << 31
    while size <= bits:
        p -= 1
        if is_prime(p):
            out.append(p)
            size += math.log2(p)
    return out


def polynomial_mod(m: list[list[int]], p: int) -> np.ndarray:
    """Coefficients of det(x - m) modulo p, the constant first: similar to Hessenberg form, then leading minors one after another."""
    q, d = np.uint64(p), len(m)
    h = np.array([[v % p for v in row] for row in m], np.uint64)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        r = k + int(below[0])
        if r != k:
            h[[k, r]] = h[[r, k]]
            h[:, [k, r]] = h[:, [r, k]]
        u = h[k + 1:, k - 1] * np.uint64(pow(int(h[k, k - 1]), -1, p)) % q
        h[k + 1:] = (h[k + 1:] + q - u[:, None] * h[k] % q) % q
        h[:, k] = (h[:, k] + (h[:, k + 1:] * u % q).sum(1)) % q
    minors = np.zeros((d + 1, d + 1), np.uint64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        row = np.zeros(d + 1, np.uint64)
        row[1:] = minors[k - 1, :-1]
        row = (row + q - minors[k - 1] * h[k - 1, k - 1] % q) % q
        chain = 1
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            row = (row + q - minors[k - 1 - i] * np.uint64(chain * int(h[k - 1 - i, k - 1]) % p) % q) % q
        minors[k] = row
    return minors[d]


def remainder(residues: np.ndarray, moduli: list[int]) -> int:
    """The number of least size with these residues."""
    value, product = 0, 1
    for r, p in zip(residues.tolist(), moduli):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def polynomial(spark, m: list[list[int]]) -> list[int]:
    """The characteristic polynomial of a symmetric positive semidefinite whole matrix: a prime a task, then a coefficient a group."""
    d, trace = len(m), sum(m[k][k] for k in range(len(m)))
    # Coefficients are sums of products of eigenvalues, largest where all are equal.
    bits = max((math.comb(d, k) * (trace // d + 1) ** k).bit_length() for k in range(d + 1)) + 2
    moduli = primes(bits)
    tasks = min(len(moduli), spark.sparkContext.defaultParallelism)

    def residues(batches):
        for b in batches:
            for at in b.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([at] * (d + 1), pa.int64()), pa.array(range(d + 1), pa.int32()), pa.array(polynomial_mod(m, moduli[at]).astype(np.int64))], names=["at", "power", "residue"])

    def join(key, group):
        group = group.sort_by("at")
        value = remainder(np.asarray(group.column("residue")), moduli)
        return pa.table({"power": pa.array([key[0].as_py()], pa.int32()), "value": pa.array([str(value)])})
    got = spark.range(0, len(moduli), 1, tasks).mapInArrow(residues, "at bigint, power int, residue bigint").groupBy("power").applyInArrow(join, "power int, value string").collect()
    return [int(v) for _, v in sorted((r.power, r.value) for r in got)]


def above(poly: list[int], a: int) -> int:
    """How many roots of a polynomial with real roots alone lie above a, each as often as it counts: sign changes of p(x + a)."""
    c = poly[::-1]
    for stop in range(len(c), 1, -1):
        for k in range(1, stop):
            c[k] += a * c[k - 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def root(poly: list[int], scale: int, rank: int) -> tuple[int, int, int] | None:
    """The root at a rank from the largest, times 2**scale: rounded down, with the roots beyond it and up to it. None if it is not above zero."""
    d = len(poly) - 1
    poly = [c << (scale * (d - k)) for k, c in enumerate(poly)]
    if above(poly, 0) < rank:
        return None
    low, high = 0, 1
    while above(poly, high) >= rank:
        low, high = high, high << 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if above(poly, mid) >= rank else (low, mid)
    return low, above(poly, high), above(poly, low)


def null_vectors(m: list[list[int]], value: int, scale: int, many: int) -> np.ndarray:
    """Orthonormal vectors for the roots next to value / 2**scale, in doubles: inverse iteration on LU factors in fixed point."""
    d, size = len(m), max(max(abs(v) for row in m for v in row).bit_length(), 1)
    one = 1 << FIXED
    a = np.array([[((v << scale) - (value if i == j else 0)) * one >> (scale + size) for j, v in enumerate(row)] for i, row in enumerate(m)], object)
    order = list(range(d))
    for k in range(d):
        r = k + int(np.argmax(np.abs(a[k:, k])))
        if r != k:
            a[[k, r]] = a[[r, k]]
            order[k], order[r] = order[r], order[k]
        if not a[k, k]:
            a[k, k] = 1
        f = a[k + 1:, k] * one // a[k, k]
        a[k + 1:, k + 1:] -= f[:, None] * a[k, k + 1:] // one
        a[k + 1:, k] = f

    def solve(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for k in range(1, d):
            x[k] -= (a[k, :k] * x[:k]).sum() // one
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] - (a[k, k + 1:] * x[k + 1:]).sum() // one) * one // a[k, k]
        return x

    def unit(x: np.ndarray) -> np.ndarray:
        return x * one // max(math.isqrt(int((x * x).sum())), 1)
    # Starts that no eigenvector is likely to be at right angles to.
    basis = [unit(np.array([one * (1 + (i + 1) ** (t + 1) % 101) // 101 for i in range(d)], object)) for t in range(many)]
    for _ in range(3):
        done: list[np.ndarray] = []
        for b in basis:
            x = unit(solve(b))
            for _ in range(2):
                for y in done:
                    x = x - y * ((x * y).sum() // one) // one
                x = unit(x)
            done.append(x)
        basis = done
    out = np.array([[float(Fraction(int(v), one)) for v in x] for x in basis])
    lead = np.argmax(np.abs(out) > np.abs(out).max(1, keepdims=True) * (1 - 1e-9), axis=1)
    return out * np.sign(out[np.arange(many), lead])[:, None]


def components(spark, m: list[list[int]], most: int) -> list[tuple[Fraction, np.ndarray]]:
    """The largest eigenvalues above zero, exact to BITS bits or more, with unit eigenvectors; at most so many. An eigenvalue a task."""
    poly = polynomial(spark, m)
    trace = sum(m[k][k] for k in range(len(m)))
    scale = max(BITS - trace.bit_length(), 0)

    def run(batches):
        for b in batches:
            for rank in b.column("id").to_pylist():
                found = root(poly, scale, rank)
                if found:
                    value, beyond, upto = found
                    v = null_vectors(m, value, scale, upto - beyond)[rank - beyond - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([rank], pa.int64()), pa.array([str(2 * value + 1)]), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["rank", "value", "vector"])
    k = min(most, len(m))
    rows = spark.range(1, k + 1, 1, k).mapInArrow(run, "rank bigint, value string, vector array<double>").collect()
    return [(Fraction(int(r.value), 1 << (scale + 1)), np.array(r.vector)) for r in sorted(rows, key=lambda r: r["rank"])]


def project(rows: DataFrame, key: str, column: str, n: int, sums: list[int], basis: np.ndarray) -> DataFrame:
    """key, deviation and whitened (an array) of the rows that count. basis: a column for each component, already over its deviation and n."""
    dims, kind = len(sums), rows.schema[key].dataType.simpleString()
    top = max(abs(s) for s in sums)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, y = whole(b, column, dims)
            most = n * int(np.abs(y).max(initial=0)) + top
            off = y * n - np.array(sums) if most < 1 << 62 else y.astype(object) * n - np.array(sums, object)
            if most * most * dims >= 1 << 63:
                squares = [v if v < 1 << 63 else None for v in (off.astype(object) ** 2).sum(1).tolist()]
            else:
                squares = (off * off).sum(1)
            white = off.astype(float) @ basis
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * basis.shape[1], pa.int32()), pa.array(white.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(keep)), pa.array(squares, pa.int64()), flat], names=[key, "deviation", "whitened"])
    return rows.select(key, column).mapInArrow(run, f"{key} {kind}, deviation bigint, whitened array<double>")


def identity_error(white: DataFrame, k: int, n: int) -> float:
    """The largest absolute entry of the whitened columns' covariance less the identity; means first, then products of differences from them."""
    means = white.agg(*[F.avg(F.col("whitened")[i]) for i in range(k)]).first()
    off = [F.col("whitened")[i] - F.lit(means[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = white.agg(*[F.sum(off[i] * off[j]) for i, j in pairs]).first()
    return max(abs(s / n - (i == j)) for s, (i, j) in zip(sums, pairs))


def whiten(rows: DataFrame, key: str, column: str, most: int = 8) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector that counts and each component."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    out = f"{key} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    dims = dimensions(rows, column)
    if not dims:
        return spark.createDataFrame([], out)
    n, sums, m = scatter(rows, column, dims)
    found = components(spark, m, most)
    if not found:
        return spark.createDataFrame([], out)
    trace = sum(m[k][k] for k in range(dims))
    # An eigenvalue of the scatter is n * n times one of the covariance, and n * x - S is n times a deviation: one n is left.
    basis = np.stack([v / float_root(e) for e, v in found], axis=1)
    white = settle(project(rows, key, column, n, sums, basis))
    error = identity_error(white, len(found), n)
    explained = F.array(*[F.lit(float(e / trace)) for e, _ in found])
    flat = white.select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return flat.select(key, (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))


def float_root(x: Fraction) -> float:
    """Square root, rounded once; numbers of any size."""
    shift = max(0, 128 - (x.numerator.bit_length() - x.denominator.bit_length())) // 2 * 2
    return float(Fraction(math.isqrt((x.numerator << shift) // x.denominator), 1 << (shift // 2)))

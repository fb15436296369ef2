"""Embedding whitening with the exact characteristic polynomial of the integer scatter.

Vectors become integers (256ths, rounded down). The scatter of the distinct ones, n * sum(x x') - S S', is added up
exactly; it is n * n times their covariance. Its characteristic polynomial is found modulo many primes, each by a
reduction to Hessenberg form in a task of its own, and put together by Chinese remaindering. The polynomial has real
roots only, so sign changes of its shifted coefficients count the roots beyond a point exactly: roots are isolated and
narrowed in whole numbers, equal ones with their multiplicity. Inverse iteration at a root, in decimals of as many digits,
gives the components in its null space.

What grows with the table stays in Spark: the distinct vectors (one shuffle, copies are merged before it) and the sums.
What passes the driver is bounded by the dimension d: d * d sums, d coefficients for each prime. The reduction takes
about d**3 steps for each of d * log2(trace) / 31 primes.

Defined cases: vectors that are null or hold null or non-finite entries are left out; so are vectors without entries and
those of another length than most have (of equally frequent lengths the greater counts). Entries beyond the range of a
long count as its ends. A component without variance is left out, so fewer distinct vectors than components give fewer
components, one distinct vector none. A deviation beyond a long is null in ``deviation`` and exact in ``deviation_text``.
Repeated rows and null ids are rows like others; an empty table gives an empty result; further columns are not looked at.
"""

from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.llm.common import written

SCALE = 256
LIMB = 40
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"


@dataclass(frozen=True)
class Components:
    """``weights`` (one row each) take a vector minus the mean to its whitened components."""

    n: int
    sums: list[int]
    weights: np.ndarray
    explained: list[float]


def whole(embedding: Column) -> Column:
    """The vector in 256ths, rounded down; null where it is null or holds null or non-finite entries."""
    c = embedding.cast("array<double>")
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~odd, F.transform(c, lambda v: F.floor(v * SCALE)))


# --- sums ----------------------------------------------------------------------------------------


def _matrix(batch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, d)


def exact_products(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers: float products where no sum can pass 2**53, whole numbers for rows with larger entries."""
    d = x.shape[1]
    total = np.zeros((d, d), object)
    top = np.maximum(x.max(1, initial=0).astype(np.float64), -x.min(1, initial=0).astype(np.float64))
    small, large = x[top < 2**22], x[top >= 2**22]
    if len(small):
        step = max(1, int(2**53 // max(1, int(top[top < 2**22].max()) ** 2)))
        for i in range(0, len(small), step):
            part = small[i : i + step].astype(np.float64)
            total += (part.T @ part).astype(np.int64).astype(object)
    for row in large.astype(object):
        total += np.outer(row, row)
    return total


def _limbs(value: int):
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        if part := value & ((1 << LIMB) - 1):
            yield k, sign * part
        value >>= LIMB
        k += 1


def _moments(batches, d: int):
    """Sums of a task as (i, j, limb, value): j = -1 for the sums of one entry, i = -1 for the count."""
    n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
    for batch in batches:
        x = _matrix(batch, d)
        n += len(x)
        sums += x.astype(object).sum(0) if len(x) else 0
        products += exact_products(x)
    cells = [(-1, -1, n), *[(i, -1, sums[i]) for i in range(d)], *[(i, j, products[i, j]) for i in range(d) for j in range(i, d)]]
    rows = [(i, j, k, v) for i, j, value in cells for k, v in _limbs(int(value))]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], ["i", "j", "limb", "value"])


def scatter(vectors: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and n * sum(x x') - S S' of the rows' ``x``, all exact."""
    parts = vectors.select("x").mapInArrow(lambda b: _moments(b, d), "i int, j int, limb int, value long")
    cells: dict = {}
    for i, j, limb, value in parts.groupBy("i", "j", "limb").agg(F.sum("value")).collect():  # at most d * d / 2 sums of a few limbs
        cells[i, j] = cells.get((i, j), 0) + (int(value) << (LIMB * limb))
    n, sums = cells.get((-1, -1), 0), [cells.get((i, -1), 0) for i in range(d)]
    return n, sums, [[n * cells.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(d)] for i in range(d)]


# --- characteristic polynomial -------------------------------------------------------------------


def _is_prime(p: int) -> bool:
    """Miller and Rabin's test with bases that decide every number below 3 * 10**9."""
    if p < 2 or any(p % q == 0 for q in (2, 3, 5, 7) if p != q):
        return p in (2, 3, 5, 7)
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if x in (1, p - 1) or p == base:
            continue
        for _ in range(twos - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def primes_below(bits: int) -> list[int]:
    """Descending primes under 2**31 whose product has more than so many bits."""
    out, p, have = [], (1 << 31) - 1, 0.0
    while have <= bits + 1:
        if _is_prime(p):
            out.append(p)
            have += log2(p)
        p -= 2
    return out


def hessenberg(a: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Similar matrices without entries below the first subdiagonal, one for each prime."""
    a, d = a.copy(), a.shape[1]
    each, p = np.arange(len(primes)), primes[:, None]
    for k in range(d - 2):
        pivot = k + 1 + (a[:, k + 1 :, k] != 0).argmax(1)  # the row itself where all are zero
        for axis in (1, 2):
            moved = np.moveaxis(a, axis, 1)
            held = moved[each, pivot].copy()
            moved[each, pivot] = moved[:, k + 1]
            moved[:, k + 1] = held
        inverse = np.array([pow(int(v), -1, int(q)) if v else 0 for v, q in zip(a[:, k + 1, k], primes, strict=True)], np.int64)
        by = a[:, k + 2 :, k] * inverse[:, None] % p
        a[:, k + 2 :, k:] = (a[:, k + 2 :, k:] - by[:, :, None] * a[:, None, k + 1, k:]) % p[:, :, None]
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2 :] * by[:, None, :] % p[:, :, None]).sum(2)) % p
    return a


def residues(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients of det(x - matrix) from the constant one up, modulo each prime."""
    q = np.array(primes, np.int64)
    h = hessenberg(np.array([[[v % p for v in row] for row in matrix] for p in primes], np.int64), q)
    d, p = h.shape[1], q[:, None]
    polys = [np.ones((len(q), 1), np.int64)]
    for k in range(d):
        new = np.zeros((len(q), k + 2), np.int64)
        new[:, 1:] = polys[k]
        new[:, :-1] = (new[:, :-1] - h[:, k, k, None] * polys[k]) % p
        chain = np.ones(len(q), np.int64)
        for i in range(k - 1, -1, -1):
            chain = chain * h[:, i + 1, i] % q
            new[:, : i + 1] = (new[:, : i + 1] - (h[:, i, k] * chain % q)[:, None] * polys[i]) % p
        polys.append(new)
    return polys[d]


def _residue_batches(batches, matrix: list[list[int]]):
    for batch in batches:
        primes = batch.column("prime").to_pylist()
        if primes:
            found = residues(matrix, primes)
            yield pa.RecordBatch.from_arrays([pa.array(primes, pa.int64()), pa.array(found.tolist(), pa.list_(pa.int64()))], ["prime", "residue"])


def characteristic(spark: SparkSession, matrix: list[list[int]], block: int = 16) -> list[int]:
    """Coefficients of det(x - matrix) from the constant one up, for a symmetric matrix without negative roots.

    The roots' k-th symmetric sums are at most comb(d, k) * (trace / d)**k, which says how many primes are needed.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_below(bound.bit_length())
    rows = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(max(1, -(-len(primes) // block)))
    found = rows.mapInArrow(lambda b: _residue_batches(b, matrix), "prime long, residue array<long>").collect()
    product = 1
    for p in primes:
        product *= p
    parts = []
    for p, residue in found:
        rest = product // p
        parts.append((rest * pow(rest % p, -1, p), residue))
    sums = [sum(unit * residue[k] for unit, residue in parts) % product for k in range(d + 1)]
    # the signs alternate, and a sum that is to be taken off comes out as its remainder
    return [s if (d - k) % 2 == 0 else -((product - s) % product) for k, s in enumerate(sums)]


# --- roots and components ------------------------------------------------------------------------


def _beyond(poly: list[int], at: int) -> int:
    """Roots greater than ``at``, each as often as it is one: sign changes after the shift (exact if all roots are real)."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _above(poly: list[int], at: int) -> int:
    total = 0
    for c in reversed(poly):
        total = total * at + c
    return total


def largest_roots(poly: list[int], most: int, bits: int = 320) -> tuple[list[tuple[int, int]], int]:
    """Greatest roots above zero as (root * 2**shift rounded up, how often), and ``shift``.

    ``shift`` gives the greatest root about ``bits`` bits. Roots that round to the same number count as equal.
    """
    d = len(poly) - 1
    reach = max(1, -poly[d - 1]).bit_length()  # the trace bounds every root
    shift = max(0, bits - reach)
    scaled = [c << (shift * (d - k)) for k, c in enumerate(poly)]
    top, rank = 1 << (reach + shift), _beyond(scaled, 0)
    counts = {0: rank, top: 0}

    def beyond(at: int) -> int:
        if at not in counts:
            counts[at] = _beyond(scaled, at)
        return counts[at]

    out: list[tuple[int, int]] = []
    taken = 0
    while taken < min(most, rank):
        low, high = 0, top  # more than ``taken`` roots beyond low, ``taken`` beyond high
        for at, count in counts.items():
            low, high = (max(low, at), high) if count > taken else (low, min(high, at))
        while high - low > 1 and beyond(low) - taken > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if beyond(middle) > taken else (low, middle)
        if high - low > 1:  # one root, once: its sign change suffices
            right = _above(scaled, high) > 0
            if _above(scaled, high) == 0:
                low = high - 1
            while high - low > 1:
                middle = (low + high) // 2
                value = _above(scaled, middle)
                low, high = (middle, high) if value and (value > 0) != right else (low, middle)
        counts[low] = beyond(low)
        times = counts[low] - taken
        out.append((high, times))
        taken += times
    return out, shift


def null_vectors(matrix: list[list[int]], root: int, shift: int, times: int, digits: int) -> list[list[Decimal]]:
    """``times`` orthonormal vectors that matrix - root / 2**shift takes nearly to zero, by inverse iteration in decimals."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = digits
        a = np.array([[Decimal(v) for v in row] for row in matrix], object).reshape(d, d)
        at = Decimal(root) / (1 << shift)
        for i in range(d):
            a[i, i] -= at
        tiny = max(abs(at), Decimal(1)).scaleb(4 - digits)
        order = np.arange(d)
        for k in range(d):
            best = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            if best != k:
                a[[k, best]], order[[k, best]] = a[[best, k]], order[[best, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            if k + 1 < d:
                a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
                a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - np.outer(a[k + 1 :, k], a[k, k + 1 :])
        found: list[np.ndarray] = []
        for t in range(times):
            y = np.array([Decimal(1 + (i * (7919 + 2 * t) + 104729 * t + i * i) % 1009) for i in range(d)], object)
            for _ in range(3):
                y = y[order]
                for k in range(1, d):
                    y[k] -= (a[k, :k] * y[:k]).sum()
                for k in range(d - 1, -1, -1):
                    y[k] = (y[k] - ((a[k, k + 1 :] * y[k + 1 :]).sum() if k + 1 < d else 0)) / a[k, k]
                for _ in range(2):
                    y = y / (y * y).sum().sqrt()
                    for other in found:
                        y = y - other * (y * other).sum()
                y = y / (y * y).sum().sqrt()
            lead = max(range(d), key=lambda i: abs(y[i]))
            found.append(y if y[lead] > 0 else -y)
        return [list(y) for y in found]


def _component_batches(batches, matrix, n: int, shift: int, digits: int):
    """Weights and eigenvalue share of the components of each root."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    for batch in batches:
        for root, times in zip(batch.column("root").to_pylist(), batch.column("times").to_pylist(), strict=True):
            vectors = null_vectors(matrix, int(root), shift, times, digits)
            with localcontext() as context:
                context.prec = digits
                value = Decimal(int(root)) / (1 << shift)
                by, share = n / value.sqrt(), float(value / trace)  # the scatter is n * n times the covariance
                weights = [[float(v * by) for v in y] for y in vectors]
            columns = [pa.array([root] * times), pa.array(range(times), pa.int32()), pa.array(weights, pa.list_(pa.float64())), pa.array([share] * times)]
            yield pa.RecordBatch.from_arrays(columns, ["root", "at", "weights", "share"])


def components(vectors: DataFrame, d: int, most: int, bits: int = 320) -> Components | None:
    """Up to ``most`` components of the rows' ``x`` by falling variance; None if there is no variance."""
    spark = vectors.sparkSession
    n, sums, matrix = scatter(vectors, d)
    if not any(matrix[i][i] for i in range(d)):
        return None
    roots, shift = largest_roots(characteristic(spark, matrix), most, bits)
    digits = int((3 * bits + 64) * 0.30103)
    rows = spark.createDataFrame([(str(root), times) for root, times in roots], "root string, times int").repartition(len(roots))
    found = rows.mapInArrow(lambda b: _component_batches(b, matrix, n, shift, digits), "root string, at int, weights array<double>, share double").collect()
    ranked = sorted(found, key=lambda r: (-int(r.root), r.at))[:most]
    return Components(n, sums, np.array([r.weights for r in ranked]), [r.share for r in ranked])


# --- whitening -----------------------------------------------------------------------------------


def _centred(x: np.ndarray, fit: Components) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S as whole numbers (Python's where they may pass a long) and as x - S / n."""
    reach = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) * fit.n + max(map(abs, fit.sums), default=0)
    kind = np.int64 if reach < 2**62 else object
    off = x.astype(kind) * fit.n - np.array(fit.sums, kind)
    return off, (off / fit.n).astype(np.float64)


def _whitened(batches, fit: Components, d: int):
    for batch in batches:
        w = _centred(_matrix(batch, d), fit)[1] @ fit.weights.T
        yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(w.shape[1])], [f"w{k}" for k in range(w.shape[1])])


def identity_error(vectors: DataFrame, fit: Components) -> float:
    """Largest entry of the whitened rows' covariance minus the identity."""
    k, d = len(fit.weights), len(fit.sums)
    names = [f"w{i}" for i in range(k)]
    rows = vectors.select("x").mapInArrow(lambda b: _whitened(b, fit, d), ", ".join(f"{c} double" for c in names))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = rows.agg(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found, strict=True))


def _results(batches, fit: Components, d: int, error: float):
    k = len(fit.weights)
    for batch in batches:
        off, centred = _centred(_matrix(batch, d), fit)
        if off.dtype == object or (len(off) and d * float(np.abs(off).max()) ** 2 >= 2**62):
            off = off.astype(object)
        deviations = (off * off).sum(1)
        repeated = np.repeat(np.arange(len(off)), k)
        whitened = (centred @ fit.weights.T).reshape(-1)
        deviation = pa.array([int(v) if v < 2**63 else None for v in deviations], pa.int64()).take(pa.array(repeated))
        text = pa.array([str(int(v)) for v in deviations], pa.string()).take(pa.array(repeated))
        columns = [
            batch.column("vec_id").take(pa.array(repeated)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(off))), pa.array(np.full(len(repeated), fit.n)),
            deviation, pa.array(whitened), pa.array(np.tile(fit.explained, len(off))), pa.array(np.full(len(repeated), error)), text,
        ]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])


def whitened(vectors: DataFrame, most: int = 4) -> DataFrame:
    """For each row of ``vec_id, embedding`` and each of the first ``most`` components: see ``OUT``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("x")).filter(F.size("x") > 0)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], OUT)
    d = lengths.d
    rows = rows.filter(F.size("x") == d)
    distinct = written(rows.select("x").distinct())
    fit = components(distinct, d, most)
    if fit is None:
        return spark.createDataFrame([], OUT)
    error = identity_error(distinct, fit)
    return rows.mapInArrow(lambda b: _results(b, fit, d, error), OUT)

"""Image hashes and similarities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def bits_to_long(bits: Column) -> Column:
    """An array of up to 64 booleans as a number, the first one highest."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(F.when(b, 1).otherwise(0).cast("long")))


def dhash_bits(gray: Column, cols: int, rows: int) -> Column:
    """Row by row whether a pixel is darker than its right neighbour."""
    at = [(r * cols + k) for r in range(rows) for k in range(cols - 1)]
    return bits_to_long(F.transform(F.array(*map(F.lit, at)), lambda i: F.get(gray, i) < F.get(gray, i + 1)))


def median_threshold_bits(coefs: Column) -> Column:
    """64 low coefficients, the mean first: which exceed the upper median of the other 63."""
    rest = F.sort_array(F.slice(coefs, 2, 63))
    return bits_to_long(F.transform(coefs, lambda x: x > F.get(rest, F.lit(31))))


def phash_bits(gray32: Column) -> Column:
    """Which of the 64 lowest cosine coefficients of a 32 by 32 image exceed the median of all but the mean.

    Null if the image hasn't 1024 values.
    """

    @F.arrow_udf("bigint")
    def run(images: pa.Array) -> pa.Array:
        k, x = np.arange(8)[:, None], np.arange(32)[None, :]
        basis = np.cos((2 * x + 1) * k * np.pi / 64)
        out = []
        for image in images.to_pylist():
            if image is None or len(image) != 1024:
                out.append(None)
                continue
            low = (basis @ np.array(image, float).reshape(32, 32) @ basis.T).ravel()
            bits = np.packbits(low > np.sort(low[1:])[31])
            out.append(int.from_bytes(bits.tobytes(), "big", signed=True))
        return pa.array(out, pa.int64())

    return run(gray32)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hex strings of one length up to 16; else four for each digit of the longer one."""
    number = lambda h: F.conv(h, 16, -10).cast("long")
    return F.when(F.length(a) == F.length(b), hamming(number(a), number(b))).otherwise(F.greatest(F.length(a), F.length(b)) * 4)


def ssim(a: Column, b: Column) -> Column:
    """Structural similarity over one window of all pixels (0..255), sample variances, clamped to 0..1."""
    n, names = F.size(a), ("a", "b", "aa", "bb", "ab")
    zero = F.struct(*[F.lit(0.0).alias(k) for k in names])

    def add(s: Column, p: Column) -> Column:
        x, y = p["a"].cast("double"), p["b"].cast("double")
        return F.struct(*[(s[k] + v).alias(k) for k, v in zip(names, (x, y, x * x, y * y, x * y), strict=True)])

    sums = F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), zero, add)

    def finish(s: Column) -> Column:
        ma, mb, c1, c2 = s["a"] / n, s["b"] / n, (0.01 * 255) ** 2, (0.03 * 255) ** 2
        va, vb, cov = ((s[k] - n * m) / (n - 1) for k, m in (("aa", ma * ma), ("bb", mb * mb), ("ab", ma * mb)))
        return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))

    value = F.get(F.transform(F.array(sums), finish), F.lit(0))  # one pass: the sums are bound once
    return F.when((n == F.size(b)) & (n > 1), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def edges_of(image: np.ndarray) -> np.ndarray:
    """Where the gradient of a square image exceeds its mean."""
    side = int(len(image) ** 0.5)
    g = np.asarray(image, float).reshape(side, side)
    dx, dy = np.zeros_like(g), np.zeros_like(g)
    dx[:, :-1], dy[:-1, :] = g[:, 1:] - g[:, :-1], g[1:, :] - g[:-1, :]
    strength = np.hypot(dx, dy)
    return (strength > strength.mean()).ravel()


def ssim_of(a, b) -> float:
    a, b = np.asarray(a, float), np.asarray(b, float)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    cov = ((a - a.mean()) * (b - b.mean())).sum() / (len(a) - 1)
    value = (2 * a.mean() * b.mean() + c1) * (2 * cov + c2) / ((a.mean() ** 2 + b.mean() ** 2 + c1) * (a.var(ddof=1) + b.var(ddof=1) + c2))
    return float(min(1.0, max(0.0, value)))


def edge_similarity(a: Column, b: Column) -> Column:
    """The share of pixels whose edge bits agree; null for different sizes."""

    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array([float((edges_of(x) == edges_of(y)).mean()) if x and y and len(x) == len(y) else None for x, y in pairs], pa.float64())

    return run(a, b)

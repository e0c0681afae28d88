"""The named features of repeats: 36 measures, and the shares of all 2- to 4-mers in the whole repeat and at its ends."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.functions import dna

SIZES = (2, 3, 4)
ENDS = 8  # bases of each end that terminal k-mers are taken from


def names(sizes: tuple[int, ...] = SIZES) -> list[str]:
    """All features in order."""
    own = ["repeat_length", "repeat_gc_percent", "repeat_at_percent", "repeat_gc_skew", "spacer_count", "mean_spacer_length", "min_spacer_length", "max_spacer_length", "median_spacer_length", "std_spacer_length"]
    own += ["repeat_self_rc_identity", "repeat_longest_inverted_stem", "repeat_hairpin_score", "repeat_count", "array_length_estimate", "spacer_repeat_length_ratio"]
    own += [f"repeat_{side}_{w}_{what}" for w in (4, 6) for side in ("start", "end") for what in ("gc_percent", *[f"{b}_fraction" for b in dna.BASES])]
    for k in sizes:
        own += [f"{kind}_{k}_{''.join(p)}" for kind in ("kmer", "terminal_kmer") for p in product(dna.BASES, repeat=k)]
    return own


def _number(rows: DataFrame, column: str, default: Column) -> Column:
    """A column as number; where it is missing, null or not a number, the default."""
    if column not in rows.columns:
        return default
    value = F.nanvl(F.col(f"`{column}`").try_cast("double"), F.lit(None).cast("double"))
    return F.coalesce(value, default)


def measures(rows: DataFrame, text: str = "repeat_sequence") -> dict[str, Column]:
    """The 36 measures by name, for rows that with_structure and the plain bases _s have been added to."""
    u = F.upper(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    length = F.coalesce(F.col("repeat_length").cast("int"), F.length(u)) if "repeat_length" in rows.columns else F.length(u)
    spacers = F.coalesce(F.col("spacer_count").cast("int"), F.lit(0)) if "spacer_count" in rows.columns else F.lit(0)
    mean = _number(rows, "mean_spacer_length", F.lit(0.0))
    out = {
        "repeat_length": length, "repeat_gc_percent": dna.gc_percent(u), "repeat_at_percent": dna.at_percent(u), "repeat_gc_skew": dna.gc_skew(u), "spacer_count": spacers, "mean_spacer_length": mean,
        **{f"{c}_spacer_length": _number(rows, f"{c}_spacer_length", mean) for c in ("min", "max", "median")}, "std_spacer_length": _number(rows, "std_spacer_length", F.lit(0.0)),
        "repeat_self_rc_identity": F.col("self_identity"), "repeat_longest_inverted_stem": F.col("inverted_stem"), "repeat_hairpin_score": F.col("hairpin_score"), "repeat_count": spacers + 1,
        "array_length_estimate": dna.rounded(length * (spacers + 1) + spacers * mean, 6), "spacer_repeat_length_ratio": dna.ratio(mean, length),
    }
    for width in (4, 6):
        for side, part in (("start", F.substring("_s", 1, width)), ("end", F.expr(f"right(_s, {width})"))):
            out[f"repeat_{side}_{width}_gc_percent"] = dna.gc_percent(part)
            for base in dna.BASES:
                out[f"repeat_{side}_{width}_{base}_fraction"] = dna.ratio(dna.count_of(part, base), F.length(part))
    return {k: v.cast("double") for k, v in out.items()}


def _prepared(rows: DataFrame, text: str) -> DataFrame:
    full = dna.with_structure(rows, text).withColumn("_s", dna.plain_bases(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return full.withColumn("_ends", F.concat(F.substring("_s", 1, ENDS), F.expr(f"right(_s, {ENDS})")))


def _shares(of: Column, k: int, kind: str) -> Column:
    """struct(feature, value) of the k-mers that occur, the value being their share."""

    def counted(every: Column) -> Column:
        return F.transform(F.array_distinct(every), lambda x: F.struct(F.concat(F.lit(f"{kind}_{k}_"), x).alias("feature"), (F.size(F.filter(every, lambda y: y == x)) / F.size(every)).alias("value")))

    # the list of k-mers is bound once, not made again for each of its members
    return F.transform(F.array(dna.kmers(of, k)), counted)[0]


def long_features(rows: DataFrame, row: str, text: str = "repeat_sequence", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(row, feature, value): every measure, and the k-mers that occur; the share of any other k-mer is 0.

    Spacer lengths that are missing are read as their mean, missing counts and
    means as 0, a null repeat as an empty one. Columns of the input other than
    those named as features are ignored.
    """
    full = _prepared(rows, text)
    plain = [F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in measures(full, text).items()]
    kmers = [_shares(F.col(of), k, kind) for k in sizes for kind, of in (("kmer", "_s"), ("terminal_kmer", "_ends"))]
    return full.select(row, F.explode(F.concat(F.array(*plain), *kmers)).alias("f")).select(row, "f.*")


def _counted_shares(texts: list[str], k: int) -> np.ndarray:
    """The shares of all k-mers in order, one row per text of A, C, G and T."""
    n = np.array([len(t) for t in texts], np.int64)
    data = np.searchsorted(np.frombuffer(b"ACGT", np.uint8), np.frombuffer("".join(texts).encode(), np.uint8))
    row = np.repeat(np.arange(len(texts)), n)
    begins = np.flatnonzero(np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n) <= n[row] - k)
    code = np.zeros(len(begins), np.int64)
    for j in range(k):
        code = code * 4 + data[begins + j]
    counts = np.bincount(row[begins] * 4**k + code, minlength=len(texts) * 4**k).reshape(len(texts), -1)
    return counts / np.maximum(n - k + 1, 1)[:, None]


def _every_share(sizes: tuple[int, ...]) -> Column:
    """The shares of all k-mers of _s and of _ends per size, in the order of names(): counted for a batch of rows at once."""

    @F.arrow_udf("array<double>")
    def shares(s: pa.Array, ends: pa.Array) -> pa.Array:
        texts = s.to_pylist(), ends.to_pylist()
        every = np.concatenate([_counted_shares(of, k) for k in sizes for of in texts], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(every) + 1, dtype=np.int32) * every.shape[1]), pa.array(every.ravel()))

    return shares("_s", "_ends")


def feature_vectors(rows: DataFrame, text: str = "repeat_sequence", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """rows with features: one vector of all features in the order of names(sizes)."""
    full = _prepared(rows, text)
    # most shares are 0; the assembler keeps whichever of dense and sparse vectors is smaller
    dense = full.withColumn("_all", array_to_vector(F.concat(F.array(*measures(full, text).values()), _every_share(sizes))))
    return VectorAssembler(inputCols=["_all"], outputCol="features").transform(dense).select(*rows.columns, "features")


def _codes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Plain bases of texts as 0 to 3, a line each, filled up with 4; how many there are."""
    texts = [(t or "").encode() for t in texts.to_pylist()]
    given = np.array([len(t) for t in texts], np.int64)
    read = np.full(256, 4, np.uint8)
    for code, base in enumerate(b"ACGT"):
        read[base] = read[base + 32] = code
    data = read[np.frombuffer(b"".join(texts), np.uint8)]
    row = np.repeat(np.arange(len(given)), given)[data < 4]
    n = np.bincount(row, minlength=len(given))
    out = np.full((len(given), max(n.max(initial=0), ENDS)), 4, np.uint8)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = data[data < 4]
    return out, n


def _shares_of(codes: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    width = codes.shape[1] - k + 1
    code = sum(codes[:, j : j + width].astype(np.int64) << 2 * (k - 1 - j) for j in range(k))
    there = np.arange(width)[None, :] <= (n - k)[:, None]
    row, at = np.nonzero(there)
    counts = np.bincount(row * 4**k + code[row, at], minlength=len(n) * 4**k).reshape(len(n), -1)
    return counts / np.maximum(n - k + 1, 1)[:, None]


def matrix(rows: pa.StructArray, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """feature_vectors for a batch of (repeat_sequence, spacer_count, mean_spacer_length): one line per row, the same to the last digit."""
    text, spacers, mean = rows.flatten()
    rounded = lambda x: np.rint(x * 1e6) / 1e6

    def ratio(a, b):
        return np.where(b == 0, 0.0, rounded(a / np.maximum(b, 1)))

    def percent(a, b):
        return np.where(b == 0, 0.0, rounded(a / np.maximum(b, 1) * 100))

    codes, n = _codes(text)
    length = np.array([len(t or "") for t in text.to_pylist()], np.int64)
    spacers = spacers.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    mean = np.nan_to_num(mean.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False), nan=0.0, posinf=np.inf, neginf=-np.inf)
    each = np.stack([(codes == b).sum(1) for b in range(4)], axis=1)
    place = np.arange(codes.shape[1])[None, :]
    turned = 3 - np.take_along_axis(codes, np.maximum(n[:, None] - 1 - place, 0), 1).astype(np.int8)
    alike = (codes == turned) & (place < n[:, None])
    identity = np.where(n == 0, 0.0, rounded(alike.sum(1) / np.maximum(n, 1)))
    stem = np.minimum(np.cumprod(alike[:, : 12], axis=1).sum(1), np.minimum(n // 2, 12))
    stem = np.where(stem < 2, 0, stem)
    hairpin = np.where(n < 8, 0.0, rounded(stem / np.sqrt(np.maximum(n, 1)) + identity))
    own = [length, percent(each[:, 1] + each[:, 2], n), percent(each[:, 0] + each[:, 3], n), ratio(each[:, 2] - each[:, 1], each[:, 1] + each[:, 2]), spacers, mean, mean, mean, mean, np.zeros(len(n))]
    own += [identity, stem, hairpin, spacers + 1, rounded(length * (spacers + 1) + spacers * mean), np.where(length == 0, 0.0, rounded(mean / np.maximum(length, 1)))]

    def ends(width: int) -> tuple[np.ndarray, np.ndarray]:
        last = np.take_along_axis(codes, np.maximum(n - width, 0)[:, None] + np.arange(width)[None, :], 1)
        return codes[:, :width], last

    for width in (4, 6):
        for part in ends(width):
            counts = np.stack([(part == b).sum(1) for b in range(4)], axis=1)
            some = counts.sum(1)
            own += [percent(counts[:, 1] + counts[:, 2], some), *[ratio(counts[:, b], some) for b in range(4)]]
    first, last = ends(ENDS)
    some = np.minimum(n, ENDS)
    both = np.full((len(n), 2 * ENDS), 4, np.uint8)
    both[:, :ENDS] = first
    np.put_along_axis(both, some[:, None] + np.arange(ENDS)[None, :], last, 1)
    out = [np.stack(own, axis=1).astype(float)]
    for k in sizes:
        out += [_shares_of(codes, n, k), _shares_of(both, 2 * some, k)]
    return np.concatenate(out, axis=1)


def as_given(text: str = "repeat_sequence") -> Column:
    """What matrix() reads, as one column."""
    return F.struct(F.upper(F.col(f"`{text}`")).alias("repeat_sequence"), F.col("spacer_count").cast("int").alias("spacer_count"), F.col("mean_spacer_length").try_cast("double").alias("mean_spacer_length"))

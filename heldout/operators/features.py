"""Fold-local normalisers, spectral and temporal features, hashed text features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.hashing import hash_index
from ..functions.text import tokens
from .durable import small
from .ranking import between, exact_quantiles, order_statistics, positions


def long_form(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """One row per (row, dimension)."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "x"))


def fit_robust(train: DataFrame, group: list[str], value: str = "x", median_first: bool = False) -> DataFrame:
    """Clip bounds (0.5% and 99.5%), median and IQR (floor 1e-6) per group from fit rows only.

    Clipping keeps the order, so the quartiles after clipping are the clipped
    order statistics before it: one sorted pass instead of two. With
    ``median_first`` the median is taken before clipping.
    """
    s = order_statistics(train, group, value, {"lower": 0.005, "upper": 0.995, "median": 0.5, "q25": 0.25, "q75": 0.75})
    s = s.withColumn("lower", between("lower")).withColumn("upper", between("upper"))
    clip = lambda c: F.least(F.greatest(c, F.col("lower")), F.col("upper"))
    iqr = between("q75", clip) - between("q25", clip)
    return s.select(*group, "lower", "upper", (between("median") if median_first else between("median", clip)).alias("median"),
                    iqr.alias("raw_iqr"), F.greatest(iqr, F.lit(1e-6)).alias("iqr"))


def apply_robust(df: DataFrame, state: DataFrame, group: list[str], value: str = "x", out: str = "z") -> DataFrame:
    j = df.join(small(state.drop("raw_iqr")), group)
    clipped = F.least(F.greatest(F.col(value), F.col("lower")), F.col("upper"))
    return j.withColumn(out, (clipped - F.col("median")) / F.col("iqr")).drop("lower", "upper", "median", "iqr")


def fit_zscore(train: DataFrame, group: list[str], value: str = "x") -> DataFrame:
    return train.groupBy(*group).agg(F.avg(value).alias("mean"), F.greatest(F.stddev_pop(value), F.lit(1e-6)).alias("sd"))


def apply_zscore(df: DataFrame, state: DataFrame, group: list[str], value: str = "x", out: str = "z") -> DataFrame:
    j = df.join(small(state), group) if group else df.join(F.broadcast(state))  # without a group: one row
    return j.withColumn(out, (F.col(value) - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def fit_log_floor(train: DataFrame, group: list[str], value: str = "x") -> DataFrame:
    """1e-6 times the median of the positive fit values; a group without one is missing."""
    return exact_quantiles(train.filter(F.col(value) > 0), group, value, {"m": 0.5}).select(*group, (F.col("m") * 1e-6).alias("epsilon"))


def apply_log_floor(df: DataFrame, state: DataFrame, group: list[str], value: str = "x", out: str = "z") -> DataFrame:
    return df.join(small(state), group).withColumn(out, F.log(F.col(value) + F.col("epsilon"))).drop("epsilon")


def near_equal_bin(position: Column, n: Column, bins: int = 8) -> Column:
    """Bin of a position when n rows are cut into near-equal runs, longer runs first."""
    q, r = F.floor(n / bins), n % bins
    head = r * (q + 1)
    return F.when(position < head, F.floor(position / (q + 1))).otherwise(r + F.floor((position - head) / q)).cast("int")


def temporal_shape(df: DataFrame, record: str, repeat: str, order: list[str], value: str, bins: int = 8) -> tuple[DataFrame, DataFrame]:
    """(bin means of the demeaned series averaged over repeats, repeats too short to bin)."""
    stats = df.groupBy(record, repeat).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"))
    short = stats.filter(F.col("_n") < bins).select(record, repeat, F.col("_n").alias("length"), F.lit("TEMPORAL_T_LT_8").alias("reason"))
    ranked = positions(df.select(record, repeat, *order, value), [record, repeat], order, "_p")
    j = ranked.join(stats.filter(F.col("_n") >= bins), [record, repeat])
    b = j.withColumn("bin", near_equal_bin(F.col("_p"), F.col("_n"), bins))
    per = b.groupBy(record, repeat, "bin").agg(F.avg(F.col(value) - F.col("_m")).alias("x"))
    return per.groupBy(record, "bin").agg(F.avg("x").alias("x")), short


def complete_windows(df: DataFrame, record: str, at: str, length: Column, width: int, stride: int) -> DataFrame:
    """Each sample once per complete window that holds it, with the window start and the offset in it.

    Windows start at 0, stride, 2 x stride, ... and must end inside the record.
    """
    p = F.col(at)
    first = F.greatest(F.ceil((p - width + 1) / F.lit(stride)), F.lit(0))
    last = F.least(F.floor(p / F.lit(stride)), F.floor((length - width) / F.lit(stride)))
    starts = F.when(last >= first, F.sequence(first, last))
    return df.withColumn("_w", F.explode(starts)).withColumn("window_start", (F.col("_w") * stride).cast("long")) \
        .withColumn("offset", (p - F.col("_w") * stride).cast("int")).drop("_w")


def window_signals(df: DataFrame, record: str, value: str) -> DataFrame:
    """One array per (record, window) in time order; a window holds a fixed number of samples."""
    packed = df.groupBy(record, "window_start").agg(F.array_sort(F.collect_list(F.struct("offset", F.col(value).alias("x")))).alias("_s"))
    return packed.select(record, "window_start", F.transform("_s", lambda s: s["x"]).alias("signal"))


def sparse_window_signals(df: DataFrame, record: str, at: str, value: str, length: int, width: int, stride: int) -> DataFrame:
    """``window_signals`` of all complete windows of records of ``length`` samples, of which ``df`` holds those that are not zero, one row each.

    A record's samples travel once and the zeros not at all; samples at NULL or outside the record are left out, the record stays.
    """
    starts = range(0, length - width + 1, stride)

    @F.pandas_udf("array<array<double>>")
    def dense(ats: pd.Series, xs: pd.Series) -> pd.Series:
        out = []
        for places, x in zip(ats, xs, strict=True):
            whole = np.zeros(length)
            whole[np.asarray(places, int)] = x
            out.append([whole[s:s + width] for s in starts])
        return pd.Series(out, dtype=object)

    inside = F.col(record).isNotNull() & F.col(at).between(0, length - 1) & F.col(value).isNotNull()
    packed = df.groupBy(record).agg(F.collect_list(F.when(inside, F.struct(F.col(at).cast("int").alias("at"), F.col(value).cast("double").alias("x")))).alias("_s"))
    signals = packed.select(record, F.posexplode(dense("_s.at", "_s.x")).alias("_w", "signal"))
    return signals.select(record, (F.col("_w") * stride).cast("long").alias("window_start"), "signal")


def band_power(df: DataFrame, signal: str, bands: list[tuple[float, float]], rate: float, out: str = "power") -> DataFrame:
    """Power in half-open bands: demean, Hann window, FFT padded to at least 512, summed density."""
    if rate <= 2 * max(hi for _, hi in bands):
        raise ValueError("sampling rate is too low for the bands")

    @F.pandas_udf(ArrayType(DoubleType()))
    def power(s: pd.Series) -> pd.Series:
        result = pd.Series([None] * len(s), dtype=object)
        lengths = s.map(len)
        for n in lengths.unique():
            rows = np.flatnonzero((lengths == n).to_numpy())
            x = np.vstack(s.iloc[rows].to_numpy()).astype(float)
            hann = np.hanning(n)
            if n < 3 or not np.isfinite(x).all():  # two samples or fewer leave the window without weight
                raise ValueError("every signal needs at least three samples, all of them finite numbers")
            size = max(512, 1 << (int(n) - 1).bit_length())
            spectrum = np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * hann, n=size, axis=1)
            freq = np.fft.rfftfreq(size, d=1.0 / rate)
            density = np.abs(spectrum) ** 2 / (rate * np.sum(hann**2)) * (freq[1] - freq[0])
            table = np.stack([density[:, (freq >= lo) & (freq < hi)].sum(axis=1) for lo, hi in bands], axis=1)
            for i, r in enumerate(rows):
                result.iat[r] = table[i].tolist()
        return result

    return df.withColumn(out, power(F.col(signal)))


def hashed_bag(df: DataFrame, key: str, text: str, buckets: int = 512) -> DataFrame:
    """Sparse unit-length bag of words: (key, bucket, weight). Words are folded to lower case."""
    words = df.select(key, F.explode(tokens(F.lower(F.col(text)))).alias("_t"))
    counts = words.groupBy(key, hash_index(buckets, "_t").alias("bucket")).agg(F.count(F.lit(1)).alias("_n"))
    norm = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_l"))
    return counts.join(norm, key).select(key, "bucket", (F.col("_n") / F.col("_l")).alias("weight"))


def mean_vectors(df: DataFrame, group: list[str], vector: str, width: int, out: str = "mean_vector") -> DataFrame:
    """Unit-length mean vector per group."""
    from ..functions.vectors import unit

    sums = df.groupBy(*group).agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"_d{i}") for i in range(width)])
    return sums.select(*group, unit(F.array(*[f"_d{i}" for i in range(width)])).alias(out))

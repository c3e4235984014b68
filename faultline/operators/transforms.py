"""Wavelet denoising and scalograms of signals held as arrays (WAV, SCL, NN-01).

A row is one signal or one block of a long signal; rows pass through Arrow in batches, so nothing is grouped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb, floor, log, log2, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache
def daubechies(order: int) -> np.ndarray:
    """Low-pass reconstruction filter of ``2 * order`` taps, by spectral factorisation (minimum phase)."""
    # P(y) has the coefficients C(order - 1 + k, k); y = (2 - z - 1/z) / 4 gives root pairs, one inside the circle
    poly = np.zeros(1, complex)
    for k in range(order):
        term = np.array([comb(order - 1 + k, k)], complex)
        for _ in range(k):
            term = np.convolve(term, [-0.25, 0.5, -0.25])
        pad = order - 1 - k
        poly = np.polyadd(poly, np.convolve(term, np.eye(1, 2 * pad + 1, pad)[0]))
    inner = [r for r in np.roots(poly) if abs(r) < 1] if order > 1 else []
    taps = np.real(np.poly(inner)) if len(inner) else np.ones(1)
    for _ in range(order):
        taps = np.convolve(taps, [1.0, 1.0])
    return taps * sqrt(2) / taps.sum()


def _filters(wavelet: str) -> tuple[np.ndarray, np.ndarray]:
    """Decomposition low-pass and high-pass."""
    low = daubechies(int(wavelet.removeprefix("db")))[::-1]
    high = low[::-1] * (-1.0) ** (np.arange(len(low)) + 1)
    return low, high


def max_level(n: int, wavelet: str) -> int:
    """WAV-03: the deepest level that a signal of ``n`` values allows."""
    taps = 2 * int(wavelet.removeprefix("db"))
    return max(0, floor(log2(n / (taps - 1)))) if n >= taps - 1 else 0


def _spots(n: int, taps: int) -> np.ndarray:
    return (taps // 2 + 2 * np.arange(n // 2)[:, None] - np.arange(taps)[None, :]) % n


def decompose(x: np.ndarray, wavelet: str = "db4", level: int = 3) -> list[np.ndarray]:
    """WAV-01: periodised transform: approximation, then details from coarse to fine."""
    low, high = _filters(wavelet)
    bands = []
    for _ in range(level):
        if len(x) % 2:
            x = np.append(x, x[-1])
        spread = x[_spots(len(x), len(low))]
        bands.append(spread @ high)
        x = spread @ low
    return [x, *bands[::-1]]


def recompose(bands: list[np.ndarray], wavelet: str = "db4") -> np.ndarray:
    """The inverse of :func:`decompose`, up to a repeated last value of odd lengths."""
    low, high = _filters(wavelet)
    x = bands[0]
    for detail in bands[1:]:
        x = x[: len(detail)]
        out = np.zeros(2 * len(detail))
        np.add.at(out, _spots(len(out), len(low)), x[:, None] * low + detail[:, None] * high)
        x = out
    return x


def sigma_of(detail: np.ndarray, method: str = "mad") -> float:
    """WAV-04: noise level of the finest band."""
    return float(np.median(np.abs(detail - np.median(detail))) / 0.6745) if method == "mad" else float(np.std(detail))


def threshold(sigma: float, n: int, variance: float, method: str = "universal") -> float:
    """WAV-05."""
    universal = sigma * sqrt(2.0 * log(n))
    if method == "universal":
        return universal
    if method == "sure":
        return sigma * sqrt(log(n))
    signal = sqrt(max(variance - sigma * sigma, 0.0))
    return universal if signal < 1e-15 else sigma * sigma / signal


def shrink(c: np.ndarray, t: float, mode: str = "soft") -> np.ndarray:
    """WAV-06."""
    return np.sign(c) * np.maximum(np.abs(c) - t, 0.0) if mode == "soft" else np.where(np.abs(c) >= t, c, 0.0)


def denoise_array(x: np.ndarray, wavelet: str = "db4", level: int = 3, method: str = "universal", mode: str = "soft", sigma_method: str = "mad") -> np.ndarray:
    """WAV-02: same length out; a level that the length does not allow is an error."""
    if level > max_level(len(x), wavelet):
        raise ValueError(f"level {level} needs a longer signal than {len(x)} values")
    bands = decompose(np.asarray(x, float), wavelet, level)
    sigma = sigma_of(bands[-1], sigma_method)
    cut = [bands[0], *(shrink(d, threshold(sigma, len(x), float(np.var(d)), method), mode) for d in bands[1:])]
    return recompose(cut, wavelet)[: len(x)]


def denoise(df: DataFrame, signal: str, settings: dict[str, tuple[str, int, str]] | None = None, class_column: str | None = None, wavelet: str = "db4", level: int = 2, method: str = "universal", mode: str = "soft", clip: bool = False) -> DataFrame:
    """WAV-07, WAV-08: replaces an ARRAY<DOUBLE> column by its denoised values, with settings by signal class.

    With ``clip``, a signal too short for its level takes the deepest one that its length allows; at 0 it is as it was.
    """
    settings = settings or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            classes = pdf[class_column] if class_column else [None] * len(pdf)
            chosen = [settings.get(c, (wavelet, level, method)) for c in classes]
            pdf[signal] = [denoise_array(x, w, min(n, max_level(len(x), w)) if clip else n, m, mode).tolist() for x, (w, n, m) in zip(pdf[signal], chosen)]
            yield pdf

    return df.withColumn(signal, F.col(signal).cast("array<double>")).mapInPandas(run, df.withColumn(signal, F.col(signal).cast("array<double>")).schema)


def morlet(x: np.ndarray, scales: np.ndarray, bandwidth: float = 1.5, centre: float = 1.0) -> np.ndarray:
    """SCL-01: magnitudes ``(scales, len(x))`` of the transform with a complex Morlet wavelet."""
    n = len(x)
    reach = int(np.ceil(4 * sqrt(bandwidth) * scales.max())) + 1
    size = 1 << (n + 2 * reach - 1).bit_length()
    spectrum, t = np.fft.fft(x, size), np.arange(-reach, reach + 1)
    out = np.empty((len(scales), n))
    for k, a in enumerate(scales):
        wave = np.exp(-((t / a) ** 2) / bandwidth + 2j * pi * centre * t / a) / sqrt(pi * bandwidth * a)
        out[k] = np.abs(np.fft.ifft(spectrum * np.fft.fft(wave, size))[reach : reach + n])
    return out


def scalogram(df: DataFrame, key: str, signal: str, n_scales: int = 64, period: float = 1.0, logged: bool = False) -> DataFrame:
    """SCL-01 to SCL-03: ``key, scale, freq, magnitudes`` of each signal, one row per scale."""
    kind = df.schema[key].dataType.simpleString()
    scales = np.arange(1, n_scales + 1, dtype=float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, x in zip(pdf[key], pdf[signal]):
                power = morlet(np.asarray(x, float), scales)
                power = np.log1p(power) if logged else power
                yield pd.DataFrame({key: [k] * n_scales, "scale": scales, "freq": 1.0 / (scales * period), "magnitudes": list(power)})

    return df.select(key, signal).mapInPandas(run, f"`{key}` {kind}, scale double, freq double, magnitudes array<double>")


def positions(spark, length: int, width: int) -> DataFrame:
    """NN-01: the sinusoidal table ``pos, dim, value``."""
    grid = spark.range(length).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("dim"))
    rate = F.exp((F.col("dim") - F.col("dim") % 2) * F.lit(-log(10000.0) / width))
    return grid.withColumn("value", F.when(F.col("dim") % 2 == 0, F.sin(F.col("pos") * rate)).otherwise(F.cos(F.col("pos") * rate)))


def threshold_column(sigma: Column, n: Column, variance: Column, method: str) -> Column:
    """WAV-05 as an expression."""
    universal = sigma * F.sqrt(2.0 * F.log(n))
    if method == "universal":
        return universal
    if method == "sure":
        return sigma * F.sqrt(F.log(n))
    signal = F.sqrt(F.greatest(variance - sigma * sigma, F.lit(0.0)))
    return F.when(signal < 1e-15, universal).otherwise(sigma * sigma / signal)

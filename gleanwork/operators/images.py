"""Kernels over decoded images, vectorised in numpy, one Arrow batch at a time.

Perceptual hash: luma averaged to 32 x 32, DCT-II, signs against the median of
the lowest 8 x 8 coefficients. Colourfulness: Hasler and Suesstrunk 2003. Others
are textbook definitions on a 0..255 scale. Undecodable images give nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AuditThresholds

METRICS = "luma_stddev double, sat_stddev double, sat_mean double, colorfulness double, flat_ratio double, laplacian_var double, edge_density double, entropy double, edge_mean double, brightness double, phash string"


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """RGB floats of the image source's rows (BGR order)."""
    if height <= 0 or width <= 0 or channels not in (1, 3, 4):
        return None
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def shrink(a: np.ndarray, side: int) -> np.ndarray:
    """Block means so that no side is longer."""
    step = max(1, -(-max(a.shape[:2]) // side))
    h, w = max(1, a.shape[0] // step), max(1, a.shape[1] // step)
    step_h, step_w = min(step, a.shape[0]), min(step, a.shape[1])
    return a[: h * step_h, : w * step_w].reshape(h, step_h, w, step_w, -1).mean(axis=(1, 3))


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def phash(gray: np.ndarray) -> str:
    """16 hex digits. Coefficients below 1e-6 count as zero, so flat images hash alike."""
    edges = [np.linspace(0, n, 33).astype(int) for n in gray.shape]
    grid = np.array([[gray[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(edges[1][:-1], edges[1][1:], strict=True)] for a, b in zip(edges[0][:-1], edges[0][1:], strict=True)])
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (basis @ grid @ basis.T)[:8, :8]
    low[np.abs(low) < 1e-6] = 0
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def metrics(rgb: np.ndarray, t: AuditThresholds) -> dict:
    a = shrink(rgb, t.variance_max_side)
    gray, top = luma(a), a.max(axis=2)
    sat = np.where(top > 0, (top - a.min(axis=2)) / np.maximum(top, 1e-9), 0) * 255
    rg, yb = a[:, :, 0] - a[:, :, 1], (a[:, :, 0] + a[:, :, 1]) / 2 - a[:, :, 2]
    pad = np.pad(gray, 1, mode="edge")
    laplacian = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * gray
    gradient = np.hypot(pad[1:-1, 2:] - pad[1:-1, :-2], pad[2:, 1:-1] - pad[:-2, 1:-1]) / 2
    p = np.bincount(np.clip(np.rint(gray), 0, 255).astype(int).ravel(), minlength=256) / gray.size
    p = p[p > 0]
    tiles = [x for row in np.array_split(gray, min(t.flat_grid_size, gray.shape[0])) for x in np.array_split(row, min(t.flat_grid_size, gray.shape[1]), axis=1)]
    return {
        "luma_stddev": gray.std(), "sat_stddev": sat.std(), "sat_mean": sat.mean(), "colorfulness": np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean()),
        "flat_ratio": np.mean([x.std() < t.flat_tile_stddev_max for x in tiles]), "laplacian_var": laplacian.var(), "edge_density": (gradient > t.edge_threshold).mean(),
        "entropy": max(0.0, -(p * np.log2(p)).sum()), "edge_mean": np.abs(laplacian).mean(), "brightness": gray.mean(), "phash": phash(gray),
    }


def image_metrics(images: DataFrame, thresholds: AuditThresholds | None = None) -> DataFrame:
    """filepath, width, height and all metrics of rows of the image source (image struct)."""
    t = thresholds or AuditThresholds()
    names = [x.split()[0] for x in METRICS.split(", ")]

    @F.pandas_udf(f"struct<{', '.join(x.replace(' ', ':') for x in METRICS.split(', '))}>".replace(", ", ","))
    def kernel(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for h, w, c, d in parts:
            rows = []
            for row in zip(h, w, c, d, strict=True):
                a = pixels(*row)
                rows.append(dict.fromkeys(names) if a is None else metrics(a, t))
            yield pd.DataFrame(rows, columns=names)

    ok = F.col("image.height") > 0
    found = images.withColumn("_m", kernel("image.height", "image.width", "image.nChannels", "image.data"))
    return found.select(F.col("image.origin").alias("filepath"), F.when(ok, F.col("image.width")).alias("width"), F.when(ok, F.col("image.height")).alias("height"), "_m.*")


def size_gate(images: DataFrame, min_side: int, allow_undecoded: bool = False) -> DataFrame:
    """(filepath, reason): decode_failed, too_small size=WxH, or null."""
    h, w = F.col("image.height"), F.col("image.width")
    small = F.concat(F.lit("too_small size="), w.cast("string"), F.lit("x"), h.cast("string"))
    failed = "decode_failed_allowed" if allow_undecoded else "decode_failed"
    return images.select(F.col("image.origin").alias("filepath"), F.when(h <= 0, failed).when(F.least(h, w) < min_side, small).alias("reason"))

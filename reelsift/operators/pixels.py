"""Measures of pixels: grey statistics, tile sharpness, perceptual hash, shake.  Numpy in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAY_SCHEMA = "blur_var double, sharp_p90 double, sharp_tile_max double, brightness double, clip_high double, clip_low double, entropy double, phash string"


def laplacian(gray: np.ndarray) -> np.ndarray:
    """The four-neighbour Laplacian with mirrored borders (the border itself isn't repeated)."""
    g = np.pad(gray.astype(np.float64), 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray.astype(np.float64), 1, mode="edge")
    return g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]


def tiles(gray: np.ndarray, grid: int = 4) -> list[np.ndarray]:
    """The tiles of a grid that aren't empty."""
    rows, cols = (np.arange(grid + 1) * n // grid for n in gray.shape)
    cut = [gray[rows[i] : rows[i + 1], cols[j] : cols[j + 1]] for i in range(grid) for j in range(grid)]
    return [t for t in cut if t.size]


def tile_sharpness(gray: np.ndarray) -> float:
    """The 90th percentile of the tiles' Laplacian variances."""
    return float(np.percentile([laplacian(t).var() for t in tiles(gray)], 90))


def entropy(shares: np.ndarray) -> float:
    """Shannon entropy in bits of a histogram of shares."""
    p = shares[shares > 0]
    return float(-(p * np.log2(p)).sum()) + 0.0


def resize_mean(gray: np.ndarray, size: int) -> np.ndarray:
    """``gray`` reduced or enlarged to size x size; each cell is the mean of what it covers."""
    for axis in (0, 1):
        n = gray.shape[axis]
        edges = np.linspace(0, n, size + 1)
        total = np.concatenate([np.zeros_like(np.take(gray, [0], axis), dtype=np.float64), np.cumsum(gray, axis, dtype=np.float64)], axis)
        low = np.minimum(np.floor(edges).astype(int), n)
        part = edges - low
        shape = (-1, 1) if axis == 0 else (1, -1)
        at = np.take(total, low, axis) + part.reshape(shape) * (np.take(total, np.minimum(low + 1, n), axis) - np.take(total, low, axis))
        gray = np.diff(at, axis=axis) / (n / size)
    return gray


def perceptual_hash(gray: np.ndarray, size: int = 8, factor: int = 4) -> str:
    """64 bits in hex: low frequencies of a cosine transform against their median."""
    n = size * factor
    small = resize_mean(gray, n)
    k, x = np.arange(size)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * k * (2 * x + 1) / (2 * n))
    low = basis @ small @ basis.T
    return f"{int(''.join('1' if b else '0' for b in (low > np.median(low)).ravel()), 2):016x}"


def gray_measures(gray: np.ndarray) -> tuple:
    hist = np.bincount(gray.ravel().astype(np.int64).clip(0, 255), minlength=256) / gray.size
    tile_max = max(tile_sharpness(t) for t in tiles(gray))
    return (
        round(float(laplacian(gray).var()), 1),
        round(tile_sharpness(gray), 1),
        round(tile_max, 1),
        round(float(gray.mean()), 1),
        round(float(hist[250:].sum()), 3),
        round(float(hist[:5].sum()), 3),
        round(entropy(hist), 2),
        perceptual_hash(gray),
    )


def to_gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Grey levels of an uncompressed image in blue, green, red order, as Spark's image source gives it."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return a[:, :, 0]
    return np.rint(a[:, :, 2] * 0.299 + a[:, :, 1] * 0.587 + a[:, :, 0] * 0.114).astype(np.uint8)


def image_measures(images: DataFrame, key: str = "path") -> DataFrame:
    """(key, measures, error) of images (key, height, width, nChannels, data); an image that can't be read has an error.

    Pixels never leave the worker: only measures come back.  Null data, a size that doesn't fit or no pixels are errors.
    """
    kind = images.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["blur_var", "sharp_p90", "sharp_tile_max", "brightness", "clip_high", "clip_low", "entropy", "phash"]
        for pdf in batches:
            out = []
            for k, h, w, n, data in zip(pdf["key"], pdf["height"], pdf["width"], pdf["n"], pdf["data"]):
                try:
                    out.append((k, *gray_measures(to_gray(data, int(h), int(w), int(n))), None))
                except Exception as e:  # noqa: BLE001 - the error is the result
                    out.append((k, *[None] * len(names), type(e).__name__))
            yield pd.DataFrame(out, columns=["key", *names, "error"])

    cols = images.select(F.col(key).alias("key"), "height", "width", F.col("nChannels").alias("n"), "data")
    return cols.mapInPandas(measure, f"key {kind}, {GRAY_SCHEMA}, error string").withColumnRenamed("key", key)


def oriented(image: np.ndarray, orientation: int) -> np.ndarray:
    """An image turned upright by its orientation tag: 2 to 4 mirror and turn it by half, 5 to 8 swap its sides; others leave it."""
    if orientation in (5, 6, 7, 8):
        image = image.swapaxes(0, 1)
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    return image[:, ::-1] if orientation in (2, 3, 6, 7) else image


def reduced(image: np.ndarray, side: int = 1600) -> np.ndarray:
    """An image of which no side is longer than ``side``: each pixel the mean of those that it covers."""
    h, w = image.shape[:2]
    step = -(-max(h, w) // side)
    if step <= 1:
        return image
    cut = image[: max(1, h // step) * min(step, h), : max(1, w // step) * min(step, w)]
    blocks = cut.reshape(cut.shape[0] // min(step, h), min(step, h), cut.shape[1] // min(step, w), min(step, w), *image.shape[2:])
    return np.rint(blocks.mean((1, 3))).astype(image.dtype)


def eye_patches(images: DataFrame, key: str = "path", least: int = 8, margin: int = 2) -> DataFrame:
    """(key, mean, std): grey level and deviation of the patch that holds the eyes' landmarks, of images (key, height, width, nChannels, data, xs, ys).

    The patch is the landmarks' box, ``margin`` points wider on each side and cut at the edges.  Null for fewer than ``least`` landmarks, a patch
    under four points wide or high, or an image that can't be read.
    """
    kind = images.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, h, w, n, data, xs, ys in zip(*(pdf[c] for c in ("key", "height", "width", "n", "data", "xs", "ys"))):
                found = (None, None)
                if data is not None and xs is not None and ys is not None and len(xs) >= least and len(data) == h * w * n:
                    left, top = max(0, int(min(xs) - margin)), max(0, int(min(ys) - margin))
                    patch = np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(n)).mean(2)[top : int(max(ys) + margin), left : int(max(xs) + margin)]
                    if min(patch.shape) >= 4:
                        found = (float(patch.mean()), float(patch.std()))
                out.append((k, *found))
            yield pd.DataFrame(out, columns=["key", "mean", "std"])

    cols = images.select(F.col(key).alias("key"), "height", "width", F.col("nChannels").alias("n"), "data", "xs", "ys")
    return cols.mapInPandas(measure, f"key {kind}, mean double, std double").withColumnRenamed("key", key)


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(dx, dy) of b against a by phase correlation under a Hann window, refined by the peak's centroid."""
    h, w = a.shape
    win = np.outer(np.hanning(h), np.hanning(w))
    cross = np.fft.fft2(b * win) * np.conj(np.fft.fft2(a * win))
    peak = np.real(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)))
    y, x = np.unravel_index(np.argmax(peak), peak.shape)
    ys, xs = np.arange(y - 2, y + 3), np.arange(x - 2, x + 3)
    near = np.maximum(peak[np.ix_(ys % h, xs % w)], 0)
    weight = near.sum() or 1.0
    dy, dx = float((near.sum(1) * ys).sum() / weight), float((near.sum(0) * xs).sum() / weight)
    return (dx - w if dx > w / 2 else dx, dy - h if dy > h / 2 else dy)


def moved_frames(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Frames of a video by its number: a picture of noise moved by (vec_id mod 4, vec_id div 4 mod 3) per frame; frame 4 is cut short.  To test shifts with."""
    for pdf in batches:
        out = []
        for v, i in zip(pdf["vec_id"].tolist(), pdf["i"].tolist()):
            picture = np.random.default_rng(v).integers(0, 256, (size, size), np.uint8)
            data = np.roll(picture, (i * (v // 4 % 3), i * (v % 4)), (0, 1)).tobytes()
            out.append((v, 0, i, data[: len(data) // 2] if i == 4 else data))
        yield pd.DataFrame(out, columns=["vec_id", "window", "i", "data"])


def shake_of_frames(frames: DataFrame, video: str = "video", size: int = 256) -> DataFrame:
    """(video, window, i, dx, dy): shifts between neighbouring frames of (video, window, i, data), grey bytes of size x size.

    One group is the frames of one window, about a second of video.
    """
    kind = frames.schema[video].dataType.simpleString()

    def shifts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        seq = [np.frombuffer(d, np.uint8)[: size * size].reshape(size, size).astype(np.float64) for d in pdf["data"] if d is not None and len(d) >= size * size]
        moved = [phase_shift(a, b) for a, b in zip(seq, seq[1:])]
        return pd.DataFrame([(pdf[video].iloc[0], int(pdf["window"].iloc[0]), i, dx, dy) for i, (dx, dy) in enumerate(moved)], columns=[video, "window", "i", "dx", "dy"])

    return frames.groupBy(video, "window").applyInPandas(shifts, f"{video} {kind}, window int, i int, dx double, dy double")


def shake_score(shifts: DataFrame, video: str = "video", least: int = 4) -> DataFrame:
    """(video, shake): per window the mean size of the change of shift, then the median over windows.

    Windows with fewer than ``least`` shifts, that is of fewer than ``least`` + 1 frames, don't count.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(video, "window").orderBy("i")
    acc = shifts.withColumns({"ax": F.col("dx") - F.lag("dx").over(w), "ay": F.col("dy") - F.lag("dy").over(w)})
    per = acc.groupBy(video, "window").agg(F.avg(F.hypot("ax", "ay")).alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return per.groupBy(video).agg(F.round(F.percentile("a", 0.5), 3).alias("shake"))


IMAGE_TYPE = T.StructType([T.StructField("path", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("nChannels", T.IntegerType()), T.StructField("data", T.BinaryType())])

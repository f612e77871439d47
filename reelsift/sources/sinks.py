"""Writing: reports, ledgers, contact sheets."""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(items: DataFrame, path: str, meta: dict | None = None) -> None:
    """A report as Parquet, with its summary beside it; replaced as a whole."""
    items.write.mode("overwrite").parquet(f"{path}/items")
    spark = items.sparkSession
    spark.createDataFrame([(json.dumps(meta or {}, ensure_ascii=False),)], "meta STRING").write.mode("overwrite").json(f"{path}/meta")


def as_json(items: DataFrame) -> DataFrame:
    """A row of JSON text per item."""
    return items.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in items.columns])).alias("value"))


def append_log(path: str, record: dict) -> None:
    """A line appended to the ledger and synced to disk before the caller acts.  The driver's."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, ensure_ascii=False) + "\n")
        f.flush()
        os.fsync(f.fileno())


def contact_sheet(images: list[np.ndarray], cols: int = 3, cell: int = 400) -> np.ndarray:
    """RGB images (height, width, 3), fitted into the cells of a grid, row by row."""
    rows = -(-len(images) // cols)
    sheet = np.full((rows * cell, cols * cell, 3), 30, np.uint8)
    for i, image in enumerate(images):
        h, w = image.shape[:2]
        scale = min(1.0, cell / max(h, w))
        nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
        small = image[np.arange(nh) * h // nh][:, np.arange(nw) * w // nw]
        top, left = (i // cols) * cell + (cell - nh) // 2, (i % cols) * cell + (cell - nw) // 2
        sheet[top : top + nh, left : left + nw] = small
    return sheet


def png(image: np.ndarray) -> bytes:
    """An RGB image as PNG."""
    h, w = image.shape[:2]
    raw = b"".join(b"\x00" + image[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

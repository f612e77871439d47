"""Reading: file manifests, tags, reports, ledgers, images, probes."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelsift import config as c
from reelsift import schema
from reelsift.functions import media as m
from reelsift.functions.text import nfc

KNOWN_EXTS = frozenset((*c.IMAGE_EXTS, *c.RAW_EXTS, *c.VIDEO_EXTS, *c.PROXY_EXTS, *c.SIDECAR_EXTS))
SKIPPED = frozenset((*c.TIER_DIRS.values(), c.REPORT_DIR, *c.OTHER_SKIPPED_DIRS))


def walk(root: str) -> Iterator[tuple[str, int, float]]:
    """(path, size, mtime) of the known files below ``root``, in order; hidden and skipped folders and files are left out."""
    for here, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in SKIPPED and not f.startswith("."))
        for name in sorted(names):
            if name.startswith(".") or name in SKIPPED or Path(name).suffix.lower() not in KNOWN_EXTS:
                continue
            full = os.path.join(here, name)
            st = os.stat(full)
            yield Path(os.path.relpath(full, root)).as_posix(), st.st_size, st.st_mtime


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of a library on a mounted file system.  The walk is the driver's; names beginning with '_' are listed, too."""
    rows = spark.createDataFrame(walk(root), "path STRING, size BIGINT, mtime DOUBLE")
    p = F.col("path")
    return rows.withColumn("path", nfc(p)).select("path", m.parent_of(p).alias("parent"), m.stem_of(p).alias("stem"), m.ext_of(p).alias("ext"), "size", "mtime")


def manifest_of_listing(listing: DataFrame) -> DataFrame:
    """A manifest from a listing table (path, size, mtime), filtered by the walk's rules; for libraries in object stores."""
    p = F.col("path")
    hidden = F.exists(F.split(p, "/"), lambda x: x.startswith(".") | x.isin(*SKIPPED))
    rows = listing.where(p.isNotNull() & ~hidden & m.ext_of(p).isin(*KNOWN_EXTS)).withColumn("path", nfc(p))
    return rows.select("path", m.parent_of(p).alias("parent"), m.stem_of(p).alias("stem"), m.ext_of(p).alias("ext"), "size", "mtime")


def count_files(manifest: DataFrame) -> int:
    return manifest.count()


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Tags extracted beforehand, a JSON array of objects; one row per file in NFC, the last one of a file wins."""
    rows = spark.read.schema(schema.EXIF_TAGS).option("multiLine", True).json(path).withColumn("__n", F.monotonically_increasing_id())
    rows = rows.where("SourceFile IS NOT NULL").withColumn("path", nfc(F.col("SourceFile")))
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.col("__n").desc()))
    return rows.withColumn("__k", last).where("__k = 1").drop("__k", "__n", "SourceFile")


def with_tags(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Files with their tags, null where there are none."""
    return files.join(tags, "path", "left")


def read_report(spark: SparkSession, path: str, item: str = schema.ITEM) -> DataFrame:
    """The rows of a report; a malformed or missing file is an error."""
    return spark.read.schema(schema.report(item)).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("items"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """An append-only ledger with ``ord``, its line; a missing file is empty, a malformed line an error."""
    try:
        lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where("trim(value) <> ''")
    except AnalysisException:
        return spark.createDataFrame([], f"{schema.LEDGER}, ord BIGINT")
    return lines.select(F.from_json("value", schema.LEDGER, {"mode": "FAILFAST"}).alias("r"), "ord").select("r.*", "ord")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (path, height, width, nChannels, data); one that can't be decoded has null data."""
    i = spark.read.format("image").option("dropInvalid", False).load(path)
    ok = F.col("image.width") > 0
    return i.select(F.col("image.origin").alias("path"), *[F.when(ok, F.col(f"image.{x}")).alias(x) for x in ("height", "width", "nChannels", "data")])


def best_preview(candidates: DataFrame, key: str = "path") -> DataFrame:
    """Of a raw file's embedded previews (key, ord, width, height) the one with the longest side, the first on ties."""
    w = Window.partitionBy(key).orderBy(F.greatest("width", "height").desc_nulls_last(), "ord")
    return candidates.where("width > 0 AND height > 0").withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def decode_with_fallback(blobs: DataFrame, decode, schema_out: str) -> DataFrame:
    """Blobs (path, content, primary_len) decoded by ``decode``(bytes) -> tuple; on failure once more from the first ``primary_len`` bytes.

    ``schema_out`` types the tuple.  Added: used_fallback, error (the exception's name if nothing helped).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split()[0] for x in schema_out.split(",")]
        for pdf in batches:
            out = []
            for path, content, length in zip(pdf["path"], pdf["content"], pdf["primary_len"]):
                row, used, error = (None,) * len(names), False, None
                try:
                    row = decode(content)
                except Exception as first:  # noqa: BLE001
                    error = type(first).__name__
                    if length == length and length:
                        try:
                            row, used, error = decode(content[: int(length)]), True, None
                        except Exception as second:  # noqa: BLE001
                            error = type(second).__name__
                out.append((path, *row, used, error))
            yield pd.DataFrame(out, columns=["path", *names, "used_fallback", "error"])

    return blobs.select("path", "content", "primary_len").mapInPandas(run, f"path STRING, {schema_out}, used_fallback BOOLEAN, error STRING")


def probe_fields(text: Column) -> Column:
    """A probe's JSON as fields: the first video stream, whether there is audio, the container's duration."""
    p = F.from_json(text, schema.PROBE)
    v = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    return F.struct(
        v["width"].alias("width"),
        v["height"].alias("height"),
        m.rate(v["r_frame_rate"]).alias("fps"),
        v["codec_name"].alias("codec"),
        v["pix_fmt"].alias("pix_fmt"),
        v["color_transfer"].alias("color_transfer"),
        v["color_primaries"].alias("color_primaries"),
        F.coalesce(F.exists(p["streams"], lambda s: s["codec_type"] == "audio"), F.lit(False)).alias("has_audio"),
        p["format"]["duration"].try_cast("double").alias("duration"),
    )


def tail_color_mode(paths: DataFrame, n_bytes: int = 4 << 20, marker: bytes = b"I_Log") -> DataFrame:
    """(path, color_mode): ilog if a file's last bytes hold the marker, else standard; null if it can't be read.

    Only the tail is read, by offset, from a file system mounted on the executors.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            modes = []
            for path in pdf["path"]:
                try:
                    with open(path, "rb") as f:
                        f.seek(max(0, f.seek(0, os.SEEK_END) - n_bytes))
                        modes.append("ilog" if marker in f.read() else "standard")
                except (OSError, TypeError):
                    modes.append(None)
            yield pd.DataFrame({"path": pdf["path"], "color_mode": modes})

    return paths.select("path").mapInPandas(look, "path STRING, color_mode STRING")


def with_digests(blobs: DataFrame, content: str = "content") -> DataFrame:
    """``blobs`` with ``md5`` and ``sha256`` of their content in hex; of null content null."""
    return blobs.withColumns({"md5": F.md5(content), "sha256": F.sha2(content, 256)})


def digest(manifest: DataFrame) -> DataFrame:
    """(n_files, digest): by which a stored scan is known to be stale; sees renames, sizes and times, not only the count."""
    h = F.xxhash64("path", "size", "mtime").cast("decimal(38,0)")
    return manifest.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def ensure_scan(spark: SparkSession, manifest: DataFrame, path: str, build) -> DataFrame:
    """The stored scan at ``path``, or ``build()`` stored there, if the manifest's digest has changed."""
    now = digest(manifest).first()
    try:
        kept = spark.read.parquet(f"{path}/digest").first()
    except AnalysisException:
        kept = None
    if kept != now:
        build().write.mode("overwrite").parquet(f"{path}/items")
        spark.createDataFrame([now]).write.mode("overwrite").parquet(f"{path}/digest")
    return spark.read.parquet(f"{path}/items")

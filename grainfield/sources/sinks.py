"""Sinks: PNG files per frame, JSON reports, saved calibration, output names."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(codes: np.ndarray, srgb: bool = False) -> bytes:
    """A 16-bit PNG, gray (h, w) or RGB (h, w, 3)."""
    h, w = codes.shape[:2]
    rows = codes.astype(">u2").reshape(h, -1).view(np.uint8).reshape(h, -1)
    body = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 16, 2 if codes.ndim == 3 else 0, 0, 0, 0)
    note = _chunk(b"sRGB", b"\0") if srgb else _chunk(b"gAMA", struct.pack(">I", 100000))
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + note + _chunk(b"IDAT", zlib.compress(body, 9)) + _chunk(b"IEND", b"")


def read_png(raw: bytes) -> np.ndarray:
    """What `png` wrote."""
    at, data, head = 8, b"", b""
    while at < len(raw):
        (n,) = struct.unpack_from(">I", raw, at)
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        head, data, at = (body if kind == b"IHDR" else head), data + (body if kind == b"IDAT" else b""), at + 12 + n
    w, h, _, color = struct.unpack_from(">IIBB", head)
    depth = 3 if color == 2 else 1
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + 2 * w * depth)[:, 1:]
    out = np.ascontiguousarray(rows).view(">u2").astype(np.int32).reshape(h, w, depth)
    return out if depth == 3 else out[:, :, 0]


def rendered_png(samples: DataFrame, value: str = "out", srgb: bool = False) -> DataFrame:
    """`frame, plane, png binary` of samples with a 16-bit value each; one frame and plane is one image."""
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}

    def one(f: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((int(f["y"].max()) + 1, int(f["x"].max()) + 1), np.int32)
        img[f["y"], f["x"]] = f[value]
        return pd.DataFrame({"frame": [f["frame"].iloc[0]], "plane": [f["plane"].iloc[0]], "png": [png(img, srgb)]})

    return samples.select("frame", "plane", "y", "x", value).groupBy("frame", "plane").applyInPandas(one, f"frame {kinds['frame']}, plane {kinds['plane']}, png binary")


def _entries(tags: dict[int, tuple[int, tuple]], at: int) -> bytes:
    """A little-endian TIFF directory that starts at byte `at`, followed by those of its values that take more than four bytes."""
    after, head, tail = at + 6 + 12 * len(tags), struct.pack("<H", len(tags)), b""
    for tag, (kind, values) in sorted(tags.items()):
        packed = b"".join(v if isinstance(v, bytes) else struct.pack({3: "<H", 4: "<I", 5: "<II"}[kind], *np.atleast_1d(v)) for v in values)
        n = len(packed) if kind in (2, 7) else len(values)
        if len(packed) > 4:
            tail, packed = tail + packed + b"\0" * (len(packed) % 2), struct.pack("<I", after + len(tail))
        head += struct.pack("<HHI", tag, kind, n) + packed.ljust(4, b"\0")
    return head + b"\0\0\0\0" + tail


def exif(meta: dict, width: int, height: int, channels: int = 1, bits: int = 16, srgb: bool = False) -> bytes:
    """EXIF 2.32 of an upright image: camera, lens and exposure as far as `meta` (a row of `raw.META`) has them, and the image's
    own size, depth, channels and colour space. A speed beyond 65534 is left out, as are texts that are empty."""
    text = lambda v: (2, (v.encode() + b"\0",)) if v else None
    ratio = lambda v: (5, ((int(v["n"]), int(v["d"])),)) if v and v["d"] and max(v["n"], v["d"]) < 1 << 32 else None
    # Batches have numbers as floating point where one of them is null, and null as NaN.
    focal, iso = meta.get("focal"), meta.get("iso")
    iso = int(iso) if iso is not None and iso == iso else None
    # EXIF tag numbers, with the codes for an upright image, its channels and its colour space.
    inner = {
        33434: ratio(meta.get("exposure")), 33437: ratio(meta.get("f_number")), 34855: (3, (iso,)) if iso and 0 < iso < 65535 else None, 36864: (7, (b"0232",)),
        37121: (7, (b"\1\0\0\0" if channels == 1 else b"\4\5\6\0",)), 37386: (5, ((round(focal * 1000), 1000),)) if focal and 0 < focal < 4e6 else None,
        40961: (3, (1 if srgb else 65535,)), 40962: (4, (width,)), 40963: (4, (height,)), 42036: text(meta.get("lens")),
    }
    outer = {
        256: (4, (width,)), 257: (4, (height,)), 258: (3, (bits,) * channels), 262: (3, (1 if channels == 1 else 2,)), 271: text(meta.get("make")), 272: text(meta.get("model")),
        274: (3, (1,)), 277: (3, (channels,)), 305: text("grainfield"), 34665: (4, (0,)),
    }
    inner, outer = ({k: v for k, v in tags.items() if v} for tags in (inner, outer))
    start = 8 + len(_entries(outer, 8))
    return b"II*\0\x08\0\0\0" + _entries(outer | {34665: (4, (start,))}, 8) + _entries(inner, start)


def described(images: DataFrame, meta: DataFrame, srgb: bool = False) -> DataFrame:
    """`images` (`frame, plane, png`) with an EXIF chunk each, from the row of `meta` (columns of `raw.META` and `frame`) of their frame.
    Images without such a row get size and colour space alone."""
    known = [c for c in ("make", "model", "lens", "iso", "exposure", "f_number", "focal") if c in meta.columns]

    def batches(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in them:
            done = []
            for raw, row in zip(f["png"], f["about"], strict=True):
                width, height, bits, color = struct.unpack_from(">IIBB", raw, 16)
                chunk = _chunk(b"eXIf", exif(row or {}, width, height, 3 if color == 2 else 1, bits, srgb))
                done.append(raw[:33] + chunk + raw[33:])  # after the header
            yield f.assign(png=done)[["frame", "plane", "png"]]

    kinds = {f.name: f.dataType.simpleString() for f in images.schema}
    about = meta.groupBy("frame").agg(F.first(F.struct(*known)).alias("about"))
    made = images.select("frame", "plane", "png").join(about, "frame", "left")
    return made.mapInPandas(batches, f"frame {kinds['frame']}, plane {kinds['plane']}, png binary")


def output_name(path: Column, mode: Column | None = None, plane: Column | None = None, suffix: str = "png") -> Column:
    """The output for an input: its relative path in the folder of its mode, with the plane before the extension."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    out = F.concat(stem, F.concat(F.lit("-"), F.lower(plane)) if plane is not None else F.lit(""), F.lit(f".{suffix}"))
    return F.concat(mode, F.lit("/"), out) if mode is not None else out


def duplicate_outputs(names: DataFrame, name: str = "name") -> DataFrame:
    return names.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def write_files(files: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Writes `name, content` rows below a local or mounted folder that all executors share, each file in full
    before it takes its name, and returns `name, bytes`. Files that exist are an error unless `overwrite`."""

    def batches(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for f in them:
            for name, content in zip(f["name"], f["content"], strict=True):
                path = os.path.join(folder, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                if os.path.lexists(path) and (not overwrite or not os.path.isfile(path) or os.path.islink(path)):
                    raise FileExistsError(path)
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as out:
                    out.write(content)
                os.replace(part, path)
            yield pd.DataFrame({"name": f["name"], "bytes": f["content"].map(len)})

    return files.mapInPandas(batches, "name string, bytes long")


def json_report(rows: DataFrame) -> DataFrame:
    """One JSON text per row, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def json_lines(rows: DataFrame, folder: str, order: str = "ordinal") -> None:
    """JSON lines in order of `order`, which isn't written: files in that order, each with lines in it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = rows.repartitionByRange(parts, order).sortWithinPartitions(order)
    kept = [c for c in rows.columns if c != order]
    at.select(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(folder)


def published(files: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """`write_files` after checks of all of them: no two outputs of one name, and with every content there, so that nothing is
    published of a batch that can't be published as a whole."""
    twice = duplicate_outputs(files).limit(5).collect()
    if twice:
        raise ValueError(f"outputs meet: {', '.join(r['name'] for r in twice)}")
    if not files.where("content is null").isEmpty():
        raise ValueError("an output has no content")
    return write_files(files, folder, overwrite)


VERSION = 1


def save_calibration(spots: DataFrame, stacks: DataFrame, folder: str, extra: bool) -> None:
    """Spots by geometry, residual maps by buckets of their ordinal, and a manifest."""
    spots.write.mode("errorifexists").parquet(f"{folder}/spots")
    stacks.withColumn("bucket", F.floor(F.col("ordinal") / 128)).write.mode("errorifexists").partitionBy("bucket").parquet(f"{folder}/stacks")
    spots.sparkSession.range(1).select(F.lit(VERSION).alias("version"), F.lit(extra).alias("extra")).write.mode("errorifexists").parquet(f"{folder}/manifest")


def load_calibration(spark: SparkSession, folder: str, near: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Spots and residual maps; with `near` only maps of these ordinals' buckets are read."""
    manifest = spark.read.parquet(f"{folder}/manifest").first()
    if manifest is None or manifest["version"] != VERSION:
        raise ValueError("the calibration was saved by another version")
    stacks = spark.read.parquet(f"{folder}/stacks")
    if near:
        stacks = stacks.where(F.col("bucket").between(near[0] // 128, near[1] // 128) & F.col("ordinal").between(*near))
    return spark.read.parquet(f"{folder}/spots"), stacks

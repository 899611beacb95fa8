"""Raw frames from files: discovery, uncompressed DNG/TIFF decoding, and frame metadata."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: TIFF field types as struct code and size.
_KINDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8)}
#: Tag numbers.
TAGS = {
    "subfile": 254, "width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "make": 271, "model": 272, "offsets": 273, "orientation": 274, "samples": 277,
    "counts": 279, "subifds": 330, "cfa_dim": 33421, "cfa": 33422, "exposure": 33434, "f_number": 33437, "exif": 34665, "iso": 34855, "standard_sensitivity": 34865, "recommended_index": 34866,
    "iso_speed": 34867, "aperture_apex": 37378, "focal": 37386, "lens": 42036, "black": 50714, "white": 50717, "crop_origin": 50719, "crop_size": 50720, "neutral": 50728, "active": 50829, "black_dim": 50713, "noise": 51041,
}
_NAMES = {v: k for k, v in TAGS.items()}
LETTERS = "RGB"

META = (
    "make string, model string, width int, height int, orientation int, bits int, black double, blacks array<double>, whites array<int>, white int, crop array<int>, iso int, exposure struct<n:bigint,d:bigint>, "
    "f_number struct<n:bigint,d:bigint>, aperture_apex double, focal double, lens string, cfa string, neutral array<double>, profile array<double>"
)


class RawError(ValueError):
    """A file isn't a raw frame that can be read here."""


@dataclass
class Frame:
    codes: np.ndarray
    meta: dict = field(default_factory=dict)


def _directory(raw: bytes, at: int, order: str) -> tuple[dict[str, tuple], int]:
    try:
        (n,) = struct.unpack_from(order + "H", raw, at)
        out = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            if tag not in _NAMES or kind not in _KINDS:
                continue
            code, size = _KINDS[kind]
            where = at + 2 + 12 * i + 8
            if size * count > 4:
                (where,) = struct.unpack_from(order + "I", raw, where)
            if kind == 2:
                out[_NAMES[tag]] = (raw[where : where + count].split(b"\0")[0].decode("utf-8", "replace"),)
            else:
                v = struct.unpack_from(order + code * count, raw, where)
                out[_NAMES[tag]] = tuple(zip(v[::2], v[1::2], strict=True)) if len(code) == 2 else v
        (after,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)
    except struct.error as e:
        raise RawError("the file ends within a directory") from e
    return out, after


def _unpacked(raw: bytes, width: int, height: int, bits: int, order: str) -> np.ndarray:
    row = (width * bits + 7) // 8
    if len(raw) < row * height:
        raise RawError("the file has fewer samples than its dimensions say")
    rows = np.frombuffer(raw, np.uint8, row * height).reshape(height, row)
    if bits == 16:
        return rows.reshape(height, width, 2).copy().view(order + "u2")[:, :, 0].astype(np.int32)
    if bits == 8:
        return rows.astype(np.int32)
    flat = np.unpackbits(rows, axis=1)[:, : width * bits].reshape(height, width, bits)
    return flat.astype(np.int32) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int32))


def _number(v) -> float | None:
    n, d = v if isinstance(v, tuple) else (v, 1)
    return n / d if d else None


def decode(raw: bytes, no_crop: bool = False) -> Frame:
    """The one-sample raster of a DNG or TIFF, uncompressed at 8 to 16 bits, with its metadata. Rows of fewer than
    16 bits are packed from the highest bit, each padded to whole bytes. A file with parts that are missing, of another
    type or out of bounds is a `RawError`.

    The pattern, and with it `blacks` and `whites` (a value for each of the four phases), are those of the cropped raster: an
    odd crop origin turns them. Black levels repeat from the active area's corner."""
    try:
        return _decoded(raw, no_crop)
    except (LookupError, TypeError, ValueError, ArithmeticError, struct.error) as e:
        raise e if isinstance(e, RawError) else RawError(f"malformed file: {e}") from e


def _phases(values: tuple, rows: int, columns: int, y0: int, x0: int) -> list:
    """A pattern's value at each of the four phases of a cell whose corner lies at (y0, x0)."""
    if rows * columns != len(values):
        raise RawError("a pattern has another number of values than its dimensions say")
    return [values[(y0 + y) % rows * columns + (x0 + x) % columns] for y in (0, 1) for x in (0, 1)]


def _decoded(raw: bytes, no_crop: bool) -> Frame:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if not order or len(raw) < 8 or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise RawError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", raw, 4)
    ifds, todo, seen = [], [at], set()
    while todo:
        at = todo.pop(0)
        if not at or at in seen:
            continue
        seen.add(at)
        tags, after = _directory(raw, at, order)
        ifds.append(tags)
        todo += [*tags.get("subifds", ()), after]
    top = ifds[0]
    exif = _directory(raw, top["exif"][0], order)[0] if "exif" in top else {}
    main = next((t for t in ifds if t.get("photometric", (0,))[0] in (32803, 34892) and t.get("subfile", (0,))[0] == 0), None) or next((t for t in ifds if "offsets" in t), None)
    if main is None or "width" not in main or "height" not in main:
        raise RawError("no raw raster in the file")
    width, height, bits = main["width"][0], main["height"][0], main.get("bits", (16,))[0]
    if main.get("samples", (1,))[0] != 1 or main.get("compression", (1,))[0] != 1 or not 8 <= bits <= 16:
        raise RawError("only uncompressed rasters of one sample of 8 to 16 bits are read")
    strips = b"".join(raw[o : o + c] for o, c in zip(main["offsets"], main["counts"], strict=True))
    codes = _unpacked(strips, width, height, bits, order)
    tag = lambda name, default=None: main.get(name) or top.get(name) or default
    blacks = [_number(v) or 0.0 for v in tag("black", (0,))]
    white = int(_number(tag("white", ((1 << bits) - 1,))[0]) or 0)
    black = float(np.mean(blacks))
    if not 0 <= black < white <= 65535:
        raise RawError("black and white levels are out of order")
    orientation = int(top.get("orientation", (1,))[0])
    pattern = main.get("cfa")
    origin, size = tag("crop_origin"), tag("crop_size")
    crop = [int(_number(v) or 0) for v in (*origin, *size)] if origin and size else None
    if crop:
        crop = [crop[0], crop[1], crop[2], crop[3]]
        if min(crop) < 0 or crop[2] == 0 or crop[3] == 0 or crop[0] + crop[2] > width or crop[1] + crop[3] > height:
            raise RawError("the crop lies outside the raster")
    if crop and not no_crop:
        codes = codes[crop[1] : crop[1] + crop[3], crop[0] : crop[0] + crop[2]]
    left, top_row = (crop[0], crop[1]) if crop and not no_crop else (0, 0)
    cfa, phase_blacks, whites = None, None, None
    if pattern:
        cells = _phases(pattern[:4], 2, 2, top_row, left)
        if sorted(cells) != [0, 1, 1, 2]:
            raise RawError("a cell needs a red, two green and a blue sample")
        cfa = "".join(LETTERS[c] for c in cells)
        area = tag("active", (0, 0))
        rows, columns = tag("black_dim", (1, 1) if len(blacks) == 1 else (2, 2))
        phase_blacks = _phases(tuple(blacks[: rows * columns]), rows, columns, top_row - area[0], left - area[1])
        levels = [int(_number(v) or 0) for v in tag("white", ((1 << bits) - 1,))]
        whites = [levels[c] if len(levels) == 3 else levels[0] for c in cells]
        if any(not 0 <= b < w <= 65535 for b, w in zip(phase_blacks, whites, strict=True)):
            raise RawError("black and white levels are out of order")
    codes = gathered(codes, orientation) if cfa is None else codes
    iso = next((int(v) for k in ("iso_speed", "standard_sensitivity", "recommended_index") if (v := exif.get(k, (0,))[0])), None)
    legacy = exif.get("iso", (0,))[0]
    profile = main.get("noise") or top.get("noise")
    pair = lambda name: next(({"n": n, "d": d} for n, d in exif.get(name, ()) if d), None)
    if profile and (not np.isfinite(profile).all() or min(profile) < 0 or not any(profile)):
        profile = None
    meta = {
        "make": top.get("make", (None,))[0], "model": top.get("model", (None,))[0], "width": codes.shape[1], "height": codes.shape[0], "orientation": orientation, "bits": bits, "black": black,
        "blacks": phase_blacks or blacks, "whites": whites, "white": white, "crop": crop, "iso": iso or (int(legacy) if 0 < legacy < 65535 else None), "exposure": pair("exposure"), "f_number": pair("f_number"),
        "aperture_apex": _number(exif["aperture_apex"][0]) if "aperture_apex" in exif else None, "focal": _number(exif["focal"][0]) if "focal" in exif else None, "lens": exif.get("lens", (None,))[0],
        "cfa": cfa, "neutral": [_number(v) or 0.0 for v in top["neutral"]] if "neutral" in top else None, "profile": list(profile) if profile and len(profile) in (2, 6) else None,
    }
    return Frame(codes, meta)


def gathered(codes: np.ndarray, orientation: int) -> np.ndarray:
    """A raster turned upright by its EXIF orientation."""
    if orientation >= 5:
        codes = codes.T
    if orientation in (2, 3, 6, 7):
        codes = codes[:, ::-1]
    if orientation in (3, 4, 7, 8):
        codes = codes[::-1]
    return np.ascontiguousarray(codes)


#: Files taken as raw frames, and characters that make a path a pattern.
RAW_FILE, PATTERN = r"\.(dng|arw)$", "*?[]{}\\"


def resolved(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files and folders that `paths` name. A path that exists is itself, whatever its characters; else it is a pattern, in
    which `*` and `?` keep to one level, with regard to case, and meet no leading dot. One that meets nothing is an error."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    out = []
    for text in paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        files = path.getFileSystem(conf)
        if files.exists(path):
            out.append(files.makeQualified(path).toString())
            continue
        found = [x.getPath() for x in files.globStatus(path) or []] if any(c in text for c in PATTERN) else []
        parts = text.rstrip("/").split("/")
        dotted = lambda f, parts=parts: any(n.startswith(".") and not w.startswith(".") for n, w in zip(f.toString().split("/")[-len(parts) :], parts, strict=False) if w)
        found = sorted(f.toString() for f in found if not dotted(f))
        if not found:
            raise FileNotFoundError(text)
        out += found
    return list(dict.fromkeys(out))


def _listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw files in order to be read: folders with all that is below them, hidden files left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("__globPaths__", "false").load(resolved(spark, paths))
    return files.where(F.lower("path").rlike(RAW_FILE) & ~F.element_at(F.split("path", "/"), -1).startswith("."))


def numbered(files: DataFrame, path: str = "path") -> DataFrame:
    """Each path once, with `ordinal` in path order. Paths alone meet in one task, as they do in any listing."""
    return files.dropDuplicates([path]).withColumn("ordinal", F.row_number().over(Window.orderBy(path)) - 1)


def discovered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw files under paths, directories and globs, once each, with `ordinal` in path order. None at all is an error."""
    files = _listed(spark, paths).select("path", "length", "modificationTime")
    if files.isEmpty():
        raise FileNotFoundError(f"no raw files in {paths}")
    return numbered(files)


#: Rows of a raster that make up one row of `frames`.
BAND = 256


def frames(spark: SparkSession, paths: list[str], no_crop: bool = False, band: int = BAND) -> DataFrame:
    """Rows per file: `frame` (path), `meta`, `top` and `rows array<array<int>>` for each `band` raster rows from `top` on,
    so that a row stays small; a file that can't be read has one row with its `error` alone."""
    files = _listed(spark, paths).select("path", "content").dropDuplicates(["path"])

    def batches(them: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in them:
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    got = decode(bytes(content), no_crop)
                except RawError as e:
                    yield pd.DataFrame([(path, None, None, None, str(e))], columns=["frame", "meta", "top", "rows", "error"])
                    continue
                for top in range(0, len(got.codes), band):
                    yield pd.DataFrame([(path, got.meta, top, list(got.codes[top : top + band]), None)], columns=["frame", "meta", "top", "rows", "error"])

    return files.mapInPandas(batches, f"frame string, meta struct<{_struct(META)}>, top int, rows array<array<int>>, error string")


def _struct(schema: str) -> str:
    out, depth = "", 0
    for part in schema.split(", "):
        name, kind = part.split(" ", 1)
        out += ("," if out else "") + f"{name}:{kind}"
        depth += 1
    return out


def samples(read: DataFrame) -> DataFrame:
    """`frame, plane, y, x, code` of frames that could be read."""
    at = read.where("error is null").select("frame", "top", F.posexplode("rows").alias("y", "r"))
    return at.select("frame", F.lit("mono").alias("plane"), (F.col("top") + F.col("y")).alias("y"), F.posexplode("r").alias("x", "code"))


def metadata(read: DataFrame) -> DataFrame:
    """`frame` and its metadata as columns, a row per frame that could be read."""
    return read.where("error is null and top = 0").select("frame", "meta.*")


def outcome(read: DataFrame) -> DataFrame:
    """One row: `files`, `failed`, and `status` of a batch, 0 if all could be read, 1 if some could not, 2 without any."""
    got = read.where("error is not null or top = 0").agg(F.count("*").alias("files"), F.count("error").alias("failed"))
    return got.withColumn("status", F.when((F.col("files") == 0) | (F.col("files") == F.col("failed")), 2).when(F.col("failed") > 0, 1).otherwise(0))


def written(codes: np.ndarray, bits: int = 16, big: bool = False, tags: dict[str, tuple[int, tuple]] | None = None) -> bytes:
    """A DNG of one strip. `tags` maps names to a TIFF field type and its values."""
    order = ">" if big else "<"
    h, w = codes.shape
    if bits == 16:
        data = codes.astype(order + "u2").tobytes()
    else:
        spread = (codes[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1
        data = np.packbits(spread.reshape(h, w * bits).astype(np.uint8), axis=1).tobytes()
    entries = {"subfile": (4, (0,)), "width": (4, (w,)), "height": (4, (h,)), "bits": (3, (bits,)), "compression": (3, (1,)), "photometric": (3, (34892,)), "offsets": (4, (0,)), "samples": (3, (1,)), "counts": (4, (len(data),))}
    entries |= tags or {}
    rows = sorted((TAGS[k], *v) for k, v in entries.items())
    body_at = 8 + 2 + 12 * len(rows) + 4
    extra, ifd = b"", struct.pack(order + "H", len(rows))
    for tag, kind, values in rows:
        code, size = _KINDS[kind]
        if kind == 2:
            packed = values[0].encode() + b"\0"
            count = len(packed)
        else:
            flat = [x for v in values for x in (v if isinstance(v, tuple) else (v,))]
            packed, count = struct.pack(order + code * len(values), *flat), len(values)
        if tag == TAGS["offsets"]:
            packed = b"HERE"
        if len(packed) > 4:
            place = struct.pack(order + "I", body_at + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
            packed = place
        ifd += struct.pack(order + "HHI", tag, kind, count) + packed.ljust(4, b"\0")
    out = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 8) + ifd + struct.pack(order + "I", 0) + extra
    return out.replace(b"HERE", struct.pack(order + "I", len(out)), 1) + data

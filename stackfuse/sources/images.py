"""Image files as frames, and frames as image files.

A frame is a row: stack_id, frame_idx, origin, width, height, n_channels, depth (8 or 16), data (row by row, little-endian).
PNG and TIFF of 8 and 16 bits are read by decoders here, as Spark's own image source loses the lower byte of 16-bit files;
JPEG is read through Spark's image source. WebP raises an error, as nothing here reads it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable
from . import tables as T

FRAMES = "stack_id string, frame_idx int, origin string, width int, height int, n_channels int, depth int, data binary"
MAGIC = b"\x89PNG\r\n\x1a\n"


def decode_png(raw: bytes) -> np.ndarray:
    """(height, width, channels) of uint8 or uint16; palettes and fewer bits are spread to 8."""
    if raw[:8] != MAGIC:
        raise ValueError("not a PNG file")
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += size + 12
    if head is None:
        raise ValueError("a PNG file without a header")
    width, height, bits, colour, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced PNG files aren't supported")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    row = (width * channels * bits + 7) // 8
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)[: height * (row + 1)].reshape(height, row + 1)
    except (zlib.error, ValueError) as e:
        raise ValueError("a damaged PNG file") from e
    step = max(1, channels * bits // 8)
    out = np.zeros((height + 1, row), np.uint8)
    for i, line in enumerate(lines):
        out[i + 1] = _unfilter(int(line[0]), line[1:], out[i], step)
    out = out[1:]
    if bits == 16:
        img = out.reshape(height, width, channels, 2).astype(np.uint16)
        img = (img[..., 0] << 8) | img[..., 1]
    elif bits == 8:
        img = out.reshape(height, width, channels)
    else:
        values = np.unpackbits(out, axis=1).reshape(height, -1, bits)[:, : width * channels]
        img = (values @ (1 << np.arange(bits - 1, -1, -1))).reshape(height, width, channels).astype(np.uint8)
        if colour != 3:
            img = (img.astype(int) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    return palette[img[:, :, 0]] if colour == 3 else img


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:  # a running sum for each byte of a pixel
        wide = np.zeros(-(-len(line) // step) * step, np.uint8)
        wide[: len(line)] = line
        return np.cumsum(wide.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(line)]
    if kind not in (3, 4):
        raise ValueError("a PNG file with an unknown filter")
    out, up = bytearray(line.tobytes()), above.tobytes()
    for i in range(len(out)):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + up[i]) >> 1
        else:
            dl, du, dc = abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner)
            guess = left if dl <= du and dl <= dc else up[i] if du <= dc else corner
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def encode_png(img: np.ndarray) -> bytes:
    if img.ndim == 2:
        img = img[:, :, None]
    height, width, channels = img.shape
    bits = 16 if img.dtype == np.uint16 else 8
    rows = img.astype(">u2").reshape(height, -1).view(np.uint8) if bits == 16 else img.astype(np.uint8).reshape(height, -1)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rows.reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, bits, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def encode(img: np.ndarray, extension: str, quality: int = 95, spark: SparkSession | None = None) -> bytes:
    """An image file's bytes: PNG here; JPEG and TIFF through the JVM's writers. 16 bits are kept but in JPEG."""
    extension = extension.lower().lstrip(".")
    if extension == "png":
        return encode_png(img)
    if extension not in ("jpg", "jpeg", "tif", "tiff"):
        raise ValueError(f"no writer for .{extension} files")
    if extension in ("tif", "tiff"):
        return _encode_tiff(img)
    if img.dtype == np.uint16:
        img = (img >> 8).astype(np.uint8)
    jvm = (spark or SparkSession.active()).sparkContext._jvm
    # through a PNG, which the JVM reads by itself
    buffered = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(encode_png(img)))
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    params = writer.getDefaultWriteParam()
    params.setCompressionMode(2)
    params.setCompressionQuality(max(1, min(100, quality)) / 100)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(buffered, None, None), params)
    stream.close()
    return bytes(out.toByteArray())


def _encode_tiff(img: np.ndarray) -> bytes:
    """One uncompressed strip, little-endian."""
    if img.ndim == 2:
        img = img[:, :, None]
    height, width, channels = img.shape
    size = img.dtype.itemsize
    data = img.astype(f"<u{size}").tobytes()
    bits_at = 8 + len(data)
    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, channels, bits_at if channels > 2 else 8 * size), (259, 3, 1, 1), (262, 3, 1, 2 if channels >= 3 else 1), (273, 4, 1, 8), (277, 3, 1, channels), (278, 4, 1, height), (279, 4, 1, len(data))]
    bits = struct.pack(f"<{channels}H", *[8 * size] * channels)
    table = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", bits_at + len(bits)) + data + bits + table


def _tiff_tags(raw: bytes) -> dict[int, list[int]]:
    """The whole-number tags of a TIFF file's first image."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(raw[:4])
    if order is None:
        raise ValueError("not a TIFF file")
    out = {}
    try:
        (at,) = struct.unpack_from(order + "I", raw, 4)
        (n,) = struct.unpack_from(order + "H", raw, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * i)
            letter = {1: "B", 3: "H", 4: "I"}.get(kind)
            if letter is None:
                continue
            spot = at + 10 + 12 * i
            if struct.calcsize(letter) * count > 4:
                (spot,) = struct.unpack_from(order + "I", raw, spot)
            out[tag] = list(struct.unpack_from(f"{order}{count}{letter}", raw, spot))
    except struct.error as e:
        raise ValueError("a damaged TIFF file") from e
    out[0] = [order == "<"]
    return out


def _unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, highest bit first; 256 starts the table anew, 257 ends."""
    out, bits, width, held, at, last = bytearray(), 0, 9, 0, 0, None
    table: list[bytes] = []
    while True:
        while held < width:
            if at >= len(data):
                return bytes(out)
            bits, held, at = (bits << 8 | data[at]) & 0xFFFFFFF, held + 8, at + 1
        held -= width
        code = bits >> held & ((1 << width) - 1)
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            width = min(12, max(9, (len(table) + 1).bit_length()))
        out += word
        last = word


def _unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def decode_tiff(raw: bytes) -> np.ndarray:
    """(height, width, channels) of uint8 or uint16: strips, plain or packed (LZW, deflate, bits), pixel by pixel."""
    tags = _tiff_tags(raw)
    one = lambda tag, default=None: tags.get(tag, [default])[0]
    width, height, channels, bits, packed = one(256), one(257), one(277, 1), one(258, 1), one(259, 1)
    unpack = {1: bytes, 5: _unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack_bits}.get(packed)
    if bits not in (8, 16) or unpack is None or one(284, 1) != 1 or one(317, 1) not in (1, 2) or one(262) not in (0, 1, 2) or 273 not in tags or 279 not in tags:
        raise ValueError("a kind of TIFF file that isn't supported")
    size = bits // 8
    try:
        data = b"".join(unpack(raw[a : a + n]) for a, n in zip(tags[273], tags[279], strict=True))
        img = np.frombuffer(data, ("<u" if one(0) else ">u") + str(size))[: height * width * channels].reshape(height, width, channels)
    except (ValueError, IndexError, zlib.error) as e:
        raise ValueError("a damaged TIFF file") from e
    img = img.astype(np.uint16 if bits == 16 else np.uint8)
    if one(317, 1) == 2:
        img = np.cumsum(img, axis=1, dtype=img.dtype)
    return ~img if one(262) == 0 else img


def header(raw: bytes) -> tuple[int, int, int]:
    """Width, height and depth (8 or 16) of a PNG, JPEG or TIFF file, from its first bytes; no pixel is decoded."""
    if raw[:8] == MAGIC and len(raw) >= 26:
        width, height, bits = struct.unpack(">IIB", raw[16:25])
        return width, height, 16 if bits == 16 else 8
    if raw[:4] in (b"II*\0", b"MM\0*"):
        tags = _tiff_tags(raw)
        return tags[256][0], tags[257][0], 16 if tags.get(258, [8])[0] == 16 else 8
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(raw) and raw[at] == 0xFF:
            kind, size = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's header
                height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
                return width, height, 8
            at += 2 + size
    raise ValueError("not an image file that can be read")


def rgb(img: np.ndarray) -> np.ndarray:
    """Three channels: grey thrice, alpha left out."""
    if img.ndim == 2:
        img = img[:, :, None]
    if img.shape[2] in (1, 2):
        return np.repeat(img[:, :, :1], 3, axis=2)
    return img[:, :, :3]


def array(row) -> np.ndarray:
    """The array of a frame's row."""
    return np.frombuffer(row["data"], "<u2" if row["depth"] == 16 else np.uint8).reshape(row["height"], row["width"], row["n_channels"])


def record(stack: str, idx: int, origin: str | None, img: np.ndarray) -> tuple:
    return (stack, idx, origin, img.shape[1], img.shape[0], img.shape[2], 16 if img.dtype == np.uint16 else 8, np.ascontiguousarray(img).tobytes())


def batch(rows: Sequence[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = [x.split()[0] for x in FRAMES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def from_arrays(spark: SparkSession, images: Sequence[np.ndarray], stack: str = "stack") -> DataFrame:
    """Frames of arrays (height, width, 3); other types than uint8 and uint16 count as 16-bit values and are cut to 8."""
    importable(spark)
    rows = [record(stack, i, None, a if a.dtype in (np.uint8, np.uint16) else np.clip(a / 257, 0, 255).astype(np.uint8)) for i, a in enumerate(images)]
    return spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in rows], FRAMES).repartition(max(1, len(rows)), "frame_idx")


def first_depth(frames: DataFrame) -> int:
    """The depth of the frame with the least number."""
    return frames.agg(F.min_by("depth", "frame_idx")).first()[0]


def _decoded(batches):
    for b in batches:
        for i in range(b.num_rows):
            raw = b.column("content")[i].as_py()
            try:
                img = rgb(decode_png(raw) if raw[:8] == MAGIC else decode_tiff(raw))
            except ValueError as e:
                raise ValueError(f"can't read {b.column('path')[i].as_py()}: {e}") from e
            yield batch([record(b.column("stack_id")[i].as_py(), b.column("frame_idx")[i].as_py(), b.column("path")[i].as_py(), img)])


def _kind():
    """A column: the ending of path, in lower case."""
    return F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))


def _full(path):
    """A column of paths, with one slash before absolute local ones, however the source writes them."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def listing(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(path, frame_idx, stack_id) of the images of a folder (by path) or of listed files (in their order), and their files."""
    importable(spark)
    listed = None if isinstance(path, (str, Path)) else [str(p) for p in path]
    files = spark.read.format("binaryFile").load(listed if listed is not None else str(path)).withColumn("path", _full(F.col("path")))
    rows = files.where(T.supported(F.col("path"))).select("path")
    if listed is None:
        return T.ordered(rows).withColumn("stack_id", F.lit("stack")), files
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    full = []
    for i, p in enumerate(listed):
        there = jvm.org.apache.hadoop.fs.Path(p)
        full.append((there.getFileSystem(conf).makeQualified(there).toString(), i))
    order = spark.createDataFrame(full, "path string, frame_idx int").withColumn("path", _full(F.col("path")))
    return rows.dropDuplicates(["path"]).join(order, "path").withColumn("stack_id", F.lit("stack")), files.dropDuplicates(["path"])


def probe(spark: SparkSession, path: str | Sequence[str]) -> list[tuple[int, int, int]]:
    """(width, height, depth) of the first two images, from their headers."""
    rows, files = listing(spark, path)
    first = rows.orderBy("frame_idx").limit(2).join(files.select("path", "content"), "path").orderBy("frame_idx")
    out = []
    for r in first.collect():  # two rows
        if r["path"].lower().endswith(".webp"):
            raise ValueError("no reader for .webp files")
        try:
            out.append(header(bytes(r["content"])))
        except (ValueError, KeyError, struct.error) as e:
            raise ValueError(f"can't read {r['path']}: {e}") from e
    return out


def from_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Frames of a folder (by path), or of listed files (in their order). Anything that can't be read raises an error."""
    rows, files = listing(spark, path)
    kinds = {r[0] for r in rows.select(_kind().alias("k")).distinct().collect()}  # six at most
    if ".webp" in kinds:
        raise ValueError("no reader for .webp files")
    parts = []
    own = (".png", ".tif", ".tiff")
    if kinds & set(own):
        # the numbers are small: they go to the files, which aren't shuffled where Spark finds them so
        parts.append(files.select("path", "content").join(rows.where(_kind().isin(*own)), "path").select("stack_id", "frame_idx", "path", "content").mapInArrow(_decoded, FRAMES))
    if kinds - set(own):
        pictures = spark.read.format("image").load(path if isinstance(path, (str, Path)) else [str(p) for p in path]).select("image.*")
        pictures = pictures.withColumn("path", _full(F.col("origin"))).drop("origin")
        found = pictures.join(rows.where(~_kind().isin(*own)), "path")
        parts.append(found.select("stack_id", "frame_idx", "path", "width", "height", "nChannels", "data").mapInArrow(_spark_frames, FRAMES))
    if not parts:
        raise ValueError(f"no images in {path}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _spark_frames(batches):
    for b in batches:
        for r in b.to_pylist():
            if r["width"] < 0:
                raise ValueError(f"can't read {r['path']}")
            img = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
            img = rgb(img if r["nChannels"] == 1 else img[:, :, 2::-1])  # blue comes first
            yield batch([record(r["stack_id"], r["frame_idx"], r["path"], img)])


def write(img: np.ndarray, path: str | Path, quality: int = 95, spark: SparkSession | None = None) -> None:
    """Writes an image by its extension, to a local path or any store Spark's file systems reach."""
    data = encode(img, str(path).rpartition(".")[2], quality, spark)
    if "://" not in str(path):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_bytes(data)
        return
    sc = (spark or SparkSession.active()).sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(str(path))
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    out.write(data)
    out.close()

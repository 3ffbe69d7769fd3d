"""TIFF pages as rows: image directories are walked, strips or tiles decoded (none, PackBits, LZW,
deflate), predictors undone, and one row is emitted per page.

Baseline and common extensions are read: both byte orders, 1 to 4 samples of 8 or 16 bits, chunky or
planar, strips and tiles, horizontal differencing. Everything else gives a row with an error and no
samples, whatever the bytes are, so one broken file never stops a job. Directories that refer to themselves end
the walk; what is wrong in one directory doesn't take the pages before it. No page may be larger than the file's
bytes times EXPANSION (more than any of the codecs can give) or than one value of a column; blocks are decoded no
further than their size. Pages are given out one after the other, so a file's pages never stand in memory together.

Nulls: a null file is one row with error "null"; an empty file one with "not a TIFF". Equal files
give equal rows. An empty table gives no rows. Extra columns are kept; those named like a result
column are replaced.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelab.llm import common

#: Fixed values of the format: tags, compression schemes, field sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}

ROW = 64
#: Bytes that a byte of a file can become, at most; bytes of a page; directories of a file.
EXPANSION, PAGE_BYTES, PAGES = 1400, (1 << 31) - 1024, 1 << 16
PAGE = [
    T.StructField("page", T.IntegerType()),
    T.StructField("n_pages", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("channels", T.IntegerType()),
    T.StructField("bits", T.IntegerType()),
    T.StructField("compression", T.IntegerType()),
    T.StructField("samples", T.BinaryType()),
    T.StructField("feature", T.StringType()),
    T.StructField("error", T.StringType()),
]


class BadTiff(ValueError):
    pass


# --- codecs ------------------------------------------------------------------------------------


def unpack_bits(data: bytes, most: int = PAGE_BYTES) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < most:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += head + 2
        elif head == 128:
            i += 1
        else:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    x = np.frombuffer(data, np.uint8)
    if not len(x):
        return b""
    edges = np.flatnonzero(np.diff(x)) + 1
    starts = np.concatenate([[0], edges])
    lengths = np.diff(np.append(starts, len(x)))
    out, plain = bytearray(), 0  # from `plain` on, bytes wait to be written as they are

    def literal(to: int) -> None:
        for at in range(plain, to, 128):
            part = data[at : min(at + 128, to)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, length in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
        literal(start)
        for at in range(0, length, 128):
            run = min(128, length - at)
            out.append((257 - run) & 255 if run > 1 else 0)
            out.append(data[start])
        plain = start + length
    literal(len(data))
    return bytes(out)


CLEAR, END, FIRST = 256, 257, 258


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early."""
    out, acc, have, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal acc, have
        acc, have = (acc << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append((acc >> have) & 255)
        acc &= (1 << have) - 1

    table: dict[tuple[int, int], int] = {}
    put(CLEAR)
    free, prefix = FIRST, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        code = table.get((prefix, byte))
        if code is not None:
            prefix = code
            continue
        put(prefix)
        table[prefix, byte] = free
        free, prefix = free + 1, byte
        if free == 4095:
            put(CLEAR)
            table, free, width = {}, FIRST, 9
        elif free >= 1 << width:
            width += 1
    if prefix >= 0:
        put(prefix)
        free += 1
        if free >= 1 << width and width < 12:
            width += 1
    put(END)
    if have:
        out.append((acc << (8 - have)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, most: int = PAGE_BYTES) -> bytes:
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, acc, have, width, last = list(single), bytearray(), 0, 0, 9, b""
    for byte in data:
        acc, have = (acc << 8) | byte, have + 8
        while have >= width:
            have -= width
            code = (acc >> have) & ((1 << width) - 1)
            acc &= (1 << have) - 1
            if code == END:
                return bytes(out)
            if code == CLEAR:
                table, width, last = list(single), 9, b""
                continue
            if not last:
                if code > 255:
                    raise BadTiff("LZW: first code isn't a byte")
                last = table[code]
                out += last
                continue
            if code < len(table):
                now = table[code]
            elif code == len(table):
                now = last + last[:1]
            else:
                raise BadTiff("LZW: code beyond the table")
            if len(table) < 4096:
                table.append(last + now[:1])
            out += now
            last = now
            if len(out) >= most:
                return bytes(out)
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
    return bytes(out)


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


def decode_block(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        got = data
    elif compression == PACKBITS:
        got = unpack_bits(data, size)
    elif compression == LZW:
        got = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        got = inflate(data, size) if size else b""
    else:
        raise BadTiff(f"compression {compression}")
    if len(got) < size:
        raise BadTiff("a strip or tile is short")
    return got[:size]


def undo_predictor(x: np.ndarray) -> np.ndarray:
    """x: rows, columns, channels."""
    return np.cumsum(x, axis=1, dtype=x.dtype)


# --- reading -----------------------------------------------------------------------------------


def directories(data: bytes):
    """The tags of each directory, one after the other; 0 stands for the byte order."""
    if data[:4] == b"II*\0":
        order = "<"
    elif data[:4] == b"MM\0*":
        order = ">"
    else:
        raise BadTiff("not a TIFF")
    seen = set()
    (at,) = struct.unpack_from(order + "I", data, 4)
    while at and at not in seen:
        if len(seen) >= PAGES:
            raise BadTiff("too many directories")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, list[int]] = {0: [int(order == ">")]}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in FIELD:
                letter, width = FIELD[kind]
                place = at + 10 + 12 * k
                if width * count > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                if place + width * count > len(data):
                    raise BadTiff("a field is beyond the file")
                tags[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, place))
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def first(tags: dict[int, list[int]], tag: int, other: int | None = None) -> int | None:
    """The first value of a field; `other` if the field is missing or empty."""
    return (tags.get(tag) or [other])[0]


def read_page(data: bytes, tags: dict[int, list[int]]) -> np.ndarray:
    """rows x columns x channels, 8 or 16 bits in the machine's order."""
    one = lambda tag, other=None: first(tags, tag, other)
    width, height, channels, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    if not width or not height or bits not in (8, 16) or not 1 <= channels <= 4:
        raise BadTiff(f"{width} x {height}, {channels} channels of {bits} bits")
    planar, predictor, compression = one(PLANAR, 1) == 2, one(PREDICTOR, 1), one(COMPRESSION, 1)
    if predictor not in (1, 2):
        raise BadTiff(f"predictor {predictor}")
    if width * height * channels * bits // 8 > min(PAGE_BYTES, EXPANSION * len(data)):
        raise BadTiff(f"{width} x {height} is more than the file can hold")
    kind = np.dtype(np.uint8 if bits == 8 else (">u2" if tags[0][0] else "<u2"))
    tiled = TILES in tags
    places, sizes = (tags.get(t, []) for t in ((TILES, TILE_BYTES) if tiled else (STRIPS, STRIP_BYTES)))
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if not w or not h or w * h * channels * bits // 8 > PAGE_BYTES:
        raise BadTiff(f"strips or tiles of {w} x {h}")
    across, down, layers, deep = -(-width // w), -(-height // h), channels if planar else 1, 1 if planar else channels
    if len(places) != across * down * layers or len(sizes) != len(places):
        raise BadTiff("the number of strips or tiles")
    image = np.zeros((height, width, channels), kind.newbyteorder("="))
    for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
        layer, cell = divmod(k, across * down)
        y, x = cell // across * h, cell % across * w
        rows = h if tiled else min(h, height - y)
        raw = decode_block(data[place : place + size], compression, rows * w * deep * kind.itemsize)
        part = np.frombuffer(raw, kind).astype(kind.newbyteorder("=")).reshape(rows, w, deep)
        part = undo_predictor(part) if predictor == 2 else part
        part = part[: height - y, : width - x]
        if planar:
            image[y : y + h, x : x + w, layer] = part[:, :, 0]
        else:
            image[y : y + h, x : x + w] = part
    return image


def feature(image: np.ndarray) -> str:
    """Whole numbers only: size, least and largest sample, sum, and counts of 16 equal ranges of the sample."""
    flat = image.reshape(-1)
    bins = np.bincount((flat >> (image.dtype.itemsize * 8 - 4)).astype(np.int64), minlength=16)
    return f"{image.shape[1]}x{image.shape[0]}x{image.shape[2]};{flat.min()},{flat.max()},{flat.sum(dtype=np.uint64)};" + ",".join(map(str, bins))


def page_rows(data: bytes | None):
    """A row for each page, or for what is wrong; n_pages is the number of directories read."""
    empty = {f.name: None for f in PAGE} | {"page": 0, "n_pages": 0}
    if data is None:
        yield empty | {"error": "null"}
        return
    found, wrong = [], None
    try:
        for tags in directories(data):
            found.append(tags)
    except Exception as e:  # whatever the bytes make of the walk
        wrong = str(e) or type(e).__name__
    for i, tags in enumerate(found):
        row = empty | {"page": i, "n_pages": len(found)}
        try:
            row["compression"] = first(tags, COMPRESSION, NONE)
            image = read_page(data, tags)
            row |= {"width": image.shape[1], "height": image.shape[0], "channels": image.shape[2], "bits": image.dtype.itemsize * 8, "samples": image.tobytes(), "feature": feature(image)}
        except Exception as e:  # whatever the fields make of the page
            row["error"] = str(e) or type(e).__name__
        yield row
    if wrong or not found:
        yield empty | {"page": len(found), "n_pages": len(found), "error": wrong or "no page"}


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page of the files in `media`, with the other columns of df."""
    new = {f.name for f in PAGE}
    base = df.drop(*[c for c in df.columns if c.lower() in new])
    schema = T.StructType([*base.schema.fields, *PAGE])
    names = [f.name for f in schema.fields]
    kinds = {"page": pa.int32(), "n_pages": pa.int32(), "width": pa.int32(), "height": pa.int32(), "channels": pa.int32(), "bits": pa.int32(), "compression": pa.int32(), "samples": pa.binary(), "feature": pa.string(), "error": pa.string()}

    def run(batches):
        for part in common.slices(batches, media, 4 * common.STEP_BYTES):
            held, of, size = [], [], 0

            def out():
                kept = part.take(pa.array(of, pa.int64()))
                return pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([r[n] for r in held], kinds[n]) for n in kinds)], names=names)

            for i, x in enumerate(common.column(part, media)):
                for row in page_rows(x.as_py()):
                    n = len(row["samples"] or b"")
                    if held and size + n > 8 * common.STEP_BYTES:
                        yield out()
                        held, of, size = [], [], 0
                    held.append(row)
                    of.append(i)
                    size += n
            if held:
                yield out()

    return base.mapInArrow(run, schema)


# --- writing -----------------------------------------------------------------------------------


def write_tiff(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 512, tile: tuple[int, int] | None = None, order: str = "<", planar: bool = False, level: int = 1) -> bytes:
    """One page per image (rows x columns x channels), in strips of `rows` rows or in tiles."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4
    for image in images:
        height, width, channels = image.shape
        bits = image.dtype.itemsize * 8
        w, h = tile or (width, min(rows, height))
        places, sizes = [], []
        for layer in range(channels if planar else 1):
            for y in range(0, height, h):
                for x in range(0, width, w):
                    part = image[y : y + h, x : x + w, layer : layer + 1] if planar else image[y : y + h, x : x + w]
                    if tile:
                        part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                    if predictor == 2:
                        part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1).astype(image.dtype)
                    raw = part.astype(np.uint8 if bits == 8 else f"{order}u2").tobytes()
                    raw = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, level)}[compression](raw)
                    places.append(len(out))
                    sizes.append(len(raw))
                    out += raw
        out += b"\0" * (len(out) % 2)
        fields = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [bits] * channels), (COMPRESSION, [compression]), (PHOTOMETRIC, [2 if channels > 2 else 1]), (SAMPLES, [channels]), (PLANAR, [2 if planar else 1]), (PREDICTOR, [predictor])]
        fields += [(TILE_WIDTH, [w]), (TILE_HEIGHT, [h]), (TILES, places), (TILE_BYTES, sizes)] if tile else [(STRIPS, places), (ROWS_PER_STRIP, [h]), (STRIP_BYTES, sizes)]
        entries = b""
        for tag, values in sorted(fields):
            short = tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR)
            body = struct.pack(f"{order}{len(values)}{'H' if short else 'I'}", *values)
            if len(body) > 4:
                place, _ = len(out), out.extend(body)
                out += b"\0" * (len(out) % 2)
                body = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, 3 if short else 4, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % ROW if text else ROW)


#: How a payload is stored, by the last three bits of its CRC: most as deflated strips, the rest by the other ways.
LAYOUTS = {0: {"compression": PACKBITS, "predictor": 1}, 1: {"compression": LZW}, 2: {"compression": DEFLATE, "tile": (ROW, 256)}}


def store(text: bytes) -> bytes:
    raw = payload(text)
    return write_tiff([np.frombuffer(raw, np.uint8).reshape(-1, ROW, 1)], **LAYOUTS.get(zlib.crc32(raw) & 7, {}))


def texts_as_tiff(docs: DataFrame) -> DataFrame:
    """docs with n_bytes and media: the text's bytes, filled up with 0 to whole rows of 64, as one page of 8-bit samples."""

    def fn(batch):
        raw = [(x.as_py() or "").encode() for x in common.column(batch, "text")]
        media = [store(x) for x in raw]
        return [pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())]

    return common.annotate(docs, "text", [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], fn)


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = texts_as_tiff(common.documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    pages = tiff_pages(stored)
    size = F.octet_length("samples")
    return pages.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(samples, octet_length(samples) - {ROW - 1}, {ROW})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )

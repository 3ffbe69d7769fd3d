"""Shared pieces: Arrow slices of bounded size, byte and word hashing, checkpoints."""

from __future__ import annotations

import contextlib
import gc
import itertools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelab.lineage import shared_folder

#: Bytes of text that one vectorised step handles; a longer document is a step of its own.
STEP_BYTES = 1 << 20


class WorkerCache(dict):
    """A per-process cache that is never sent to another process."""

    def __reduce__(self):
        return (WorkerCache, ())


_CACHE = WorkerCache()


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches, column: str, limit: int = STEP_BYTES):
    """Record batches cut so that `column` has at most `limit` bytes in each (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(values) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets (null: empty)."""
    if pa.types.is_string(values.type):
        values = values.cast(pa.binary())
    elif pa.types.is_large_string(values.type):
        values = values.cast(pa.large_binary())
    if pa.types.is_binary(values.type):
        values = values.cast(pa.large_binary())
    if values.null_count:
        values = pc.fill_null(values, b"")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def annotate(df: DataFrame, text: str, added: list[T.StructField], fn) -> DataFrame:
    """All columns of df and those that fn(batch) returns as arrays; a column of df named like one of them is replaced."""
    new = {f.name.lower() for f in added}
    base = df.drop(*[c for c in df.columns if c.lower() in new])
    schema = T.StructType([*base.schema.fields, *added])
    names = [f.name for f in schema.fields]

    def run(batches):
        for part in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, *fn(part)], names=names)

    return base.mapInArrow(run, schema)


# --- hashing -----------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed odd-looking 64-bit numbers for a seed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    got = _CACHE.get(seed)
    if got is None or len(got[0]) < n:
        base = int(seeded(seed + 77, 1)[0]) | 1
        size = max(n, STEP_BYTES + 1)

        def ladder(b: int) -> np.ndarray:
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            return np.multiply.accumulate(steps)

        got = _CACHE[seed] = (ladder(base), ladder(pow(base, -1, 1 << 64)))
    return got


def prefix_hash(data: np.ndarray, seed: int) -> np.ndarray:
    """P with which span_hash() gives the hash of any span of data."""
    powers = _powers(seed, len(data) + 1)[0]
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(seeded(seed, 256)[data] * powers[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    inverse = _powers(seed, len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def class_table(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, which never cross rows, and the first word of each row (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    is_word = table[data]
    before = np.empty_like(is_word)
    before[0], before[1:] = False, is_word[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[-1], after[:-1] = False, is_word[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def gram_hash(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hashes of the k words from each position (rows are not regarded)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = seeded(seed, k) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * factors[j]
    return mix(out)


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    out, have = values, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[:n], out[rest : rest + n]) if rest else out[:n]


# --- lineage -----------------------------------------------------------------------------------


def cut(df: DataFrame) -> DataFrame:
    """df by way of a checkpoint in the folder that the cluster shares; a lost executor can't take it away."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    out = df.checkpoint(eager=True)
    del df
    # what led to it isn't needed any more: lets Spark's cleaner remove shuffle files that nothing refers to
    gc.collect()
    spark._jvm.System.gc()
    return out


#: Bits of a membership filter for each member; the least and the most bits of a filter as powers of two (128 KB and
#: 64 MB: the bound of what is broadcast); bits of one of its pages (what bitmap_construct_agg makes).
BITS_EACH, LEAST_BITS, MOST_BITS, PAGE_BITS = 32, 20, 29, 15


def bits_for(members: int) -> int:
    """The size of a filter of so many members. Beyond 2**MOST_BITS / BITS_EACH of them a filter lets more and more
    others pass, and the join behind it, which is exact, does that work."""
    return min(MOST_BITS, max(LEAST_BITS, (members * BITS_EACH).bit_length()))


def filter_pages(members: DataFrame, key: str, bits: int) -> DataFrame:
    """(page, bitmap): a set of the hashes in `key` with one bit each; 2**bits / 8 bytes at most, however many there are."""
    p = F.pmod(F.col(key), F.lit(1 << bits))
    placed = members.select(F.floor(p / (1 << PAGE_BITS)).alias("page"), (p % (1 << PAGE_BITS)).alias("bit"))
    return placed.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def perhaps_in(df: DataFrame, key: str, members: DataFrame, member_key: str, bits: int | None = None) -> DataFrame:
    """Rows of df whose hash in `key` is in the filter of members: all that are members and some others.

    It is put before a join to spare its exchange. Its size follows the number of members up to a bound, so it is
    broadcast. Members are counted first: they are cheap to read.
    """
    flag = flagged(df, key, members, member_key, bits)
    return flag.where(F.col(flag.columns[-1])).select(*df.columns)


def flagged(df: DataFrame, key: str, members: DataFrame, member_key: str, bits: int | None = None) -> DataFrame:
    """df with a last column that says whether a row's hash is in the filter of members; never null."""
    bits = bits or bits_for(members.count())
    in_, p_, page_, bitmap_ = unused(df, "in", "p", "page", "bitmap")
    # a page as numbers of 64 bits: looked up without leaving generated code
    longs = F.transform(F.sequence(F.lit(0), F.lit((1 << PAGE_BITS) // 64 - 1)), lambda i: F.conv(F.hex(F.substring("bitmap", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    pages = filter_pages(members, member_key, bits).select(F.col("page").alias(page_), longs.alias(bitmap_))
    p = F.pmod(F.col(key), F.lit(1 << bits))
    probed = df.withColumns({p_: p, page_: F.floor(p / (1 << PAGE_BITS))}).join(F.broadcast(pages), page_, "left")
    inner = F.col(p_).bitwiseAND((1 << PAGE_BITS) - 1).cast("int")
    # bytes are in order, the first is the highest of its number
    shift = F.lit(56) - F.shiftright(inner.bitwiseAND(63), 3) * 8 + inner.bitwiseAND(7)
    there = F.call_function("shiftrightunsigned", F.try_element_at(bitmap_, F.shiftright(inner, 6) + 1), shift).bitwiseAND(1) == 1
    return probed.select(*[F.col(c) for c in df.columns], F.coalesce(there, F.lit(False)).alias(in_))


#: The second bit of a hash in a filter on the Python side is that of its bits from here on.
SECOND = 30


def in_filter(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which hashes have both of their bits set: all members, and about one in 250 of the others."""
    out = np.ones(len(x), bool)
    for y in (x, x >> SECOND):
        p = y & (len(bits) * 8 - 1)
        out &= (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return out


def filter_bits(members: DataFrame, key: str) -> np.ndarray:
    """A membership filter as an array, with two bits for each member; members are counted first."""
    bits = bits_for(members.count())
    both = members.select(F.explode(F.array(F.col(key), F.shiftright(key, SECOND))).alias("key"))
    out, size = np.zeros(1 << (bits - 3), np.uint8), 1 << (PAGE_BITS - 3)
    for page, bitmap in filter_pages(both, "key", bits).toLocalIterator():
        got = np.frombuffer(bitmap, np.uint8)[: len(out) - page * size]
        out[page * size : page * size + len(got)] = got
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*cols: str):
    """Names a row by its id and text, so rows that share an id are told apart."""
    return F.struct(*[F.col(c) for c in cols])


def with_text_size(docs: DataFrame) -> DataFrame:
    """docs whose n_chars, if they have it, is the length of their text."""
    name = next((c for c in docs.columns if c.lower() == "n_chars"), None)
    return docs if name is None else docs.withColumn(name, F.length("text").cast(docs.schema[name].dataType))


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """keep(df): df written, compressed, to the shared folder and read from there, until the block ends. What leaves the block
    must have been cut before."""
    folder = f"{shared_folder(spark)}/citelab-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    n = itertools.count()

    def keep(df: DataFrame) -> DataFrame:
        at = f"{folder}/{next(n)}"
        schema = df.schema
        df.write.option("compression", "lz4_raw").parquet(at)
        del df
        gc.collect()
        spark._jvm.System.gc()
        return spark.read.schema(schema).parquet(at)

    try:
        yield keep
    finally:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that df has no column of."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
        have.add(name.lower())
    return out


def least_by_hash(rows: DataFrame, key: str, h: str, k: int, few: bool = False) -> DataFrame:
    """The rows with the k least hashes in `h` of each value of `key`, of rows whose hashes are all different.

    A threshold from the count of each value comes first: no more than about 2 k rows of one value meet in a task,
    however many tasks have read it. The threshold lets 1.5 k + 64 pass on average; where fewer than k have passed
    (less likely than one in 10**9), those are it. few: there are so few values that their counts can be broadcast.
    """
    count, = unused(rows, "count")
    share = (F.lit(1.5 * k + 64) / F.col(count)).alias(count)
    limits = rows.groupBy(key).agg(F.count("*").alias(count)).select(key, share)
    place = F.col(h).cast("double") / float(1 << 64) + 0.5
    some = rows.join(F.broadcast(limits) if few else limits, key).where(place <= F.col(count)).drop(count)
    n, = unused(rows, "n")
    return some.withColumn(n, F.row_number().over(W.partitionBy(key).orderBy(h))).where(F.col(n) <= k).drop(n)

"""Helpers shared by the training-data operators: tokenising columns, written tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between the words of the alphanumeric tokenisation.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most text bytes that a Python worker turns into numpy arrays at once.
CHUNK_BYTES = 1 << 19


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null becomes the empty string."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The alphanumeric words of the whole text, A-Z lower-cased; [] for null or none."""
    return F.array_remove(F.split(lower_ascii(text), WORD_BREAK), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = f"file://{tempfile.mkdtemp(prefix='waystone-')}"
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def with_fields(schema: T.StructType, **kinds: str) -> T.StructType:
    """The schema with further fields of these types."""
    return T.StructType([*schema.fields, *[T.StructField(k, T._parse_datatype_string(v)) for k, v in kinds.items()]])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"__{n}"
        while n in taken:
            n = f"_{n}"
        out.append(n)
    return out


def materialize(df: DataFrame, *parts: str) -> DataFrame:
    """df written as Parquet (in folders by parts) into the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote; only for those that no later result reads."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(conf).delete(path, True)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; counts no further than one more."""
    return df.limit(rows + 1).count() <= rows


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (src, dst: long), root the smallest node reachable.

    Alternating large-star and small-star steps as joins and grouped minima; each round's edges are written to
    the shared folder. Self-loops and null ends are ignored; repeated edges count once. No edges: no rows.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = materialize(e.where("u <> v").distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(old)
        new = _mark(e)
        if new == mark:
            break
        mark = new
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(e: DataFrame) -> tuple:
    """Count and order-free hash of a set of edges."""
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def text_chunks(texts: pa.Array | list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts as (first, last + 1, UTF-8 bytes, byte offsets), at most limit bytes or one text each.

    The bytes of an Arrow array are looked at where they are, not copied.
    """
    a = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    a = a.fill_null("") if a.null_count else a
    if not len(a):
        return
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def byte_classes(kept: np.ndarray) -> np.ndarray:
    """A table that maps bytes of words to themselves, A-Z lower-cased, and all others to the space."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return np.where(kept, t, np.uint8(32))


#: The bytes of the words of the alphanumeric tokenisation: digits, letters and all beyond ASCII; and of what is no white space.
ALNUM = byte_classes(np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)]))
NO_SPACE = byte_classes(np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)]))


def split_words(texts: pa.Array, classes: np.ndarray, limit: int) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """Runs of texts as (first, last + 1, words end to end, offsets of the texts' words)."""
    import pyarrow.compute as pc  # large, and most operators do without it

    for lo, hi, buf, off in text_chunks(texts, limit):
        a = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(classes[buf]))
        split = pc.ascii_split_whitespace(a)
        parts = split.flatten()
        some = pc.not_equal(parts, "")
        before = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))
        yield lo, hi, parts.filter(some), before[split.offsets.to_numpy() - split.offsets[0].as_py()]


def numbered_words(texts: pa.Array, classes: np.ndarray, limit: int) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """Runs of texts as (first, last + 1, distinct words, number of each word, offsets of the texts' words)."""
    for lo, hi, words, ends in split_words(texts, classes, limit):
        d = words.dictionary_encode()
        yield lo, hi, d.dictionary, d.indices.to_numpy(), ends


#: Fixed random values of the hashes, from one seed: the same in every process.
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        m = max(n, CHUNK_BYTES + 1)
        for i, b in enumerate((_STEP, _BACK)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS


def word_spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the words of texts laid end to end; inside: by byte, whether it is of a word."""
    w = inside[buf].astype(np.int8)
    edge = np.diff(w, prepend=np.int8(0), append=np.int8(0)) != 0
    edge[off[:-1]] |= w[np.minimum(off[:-1], len(w) - 1)] == 1 if len(w) else False
    starts = np.flatnonzero(edge[:-1] & (w == 1)) if len(w) else np.zeros(0, np.int64)
    stop = np.diff(w, append=np.int8(0)) == -1 if len(w) else np.zeros(0, bool)
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut <= len(w))]
    if len(cut):
        stop[cut - 1] |= w[cut - 1] == 1
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes, equal hash."""
    p, back = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * p[: len(buf)], out=total[1:])
    return mix64((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of k values of h inside one text."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s += h[j : j + n] * _ODD[j % 64]
    one = doc[:n] == doc[k - 1 :]
    return mix64(s[one]), doc[:n][one]

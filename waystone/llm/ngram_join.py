"""Operator 7: n-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, free_names, gram_hashes, materialize, mix64, small_enough, span_hashes, text_chunks, word_spans

#: Words of a shingle and the least similarity, as a fraction, unless a caller asks for others.
WORDS, SIMILAR = 5, (4, 5)
#: Buckets of the frequency sketches: twice so many counts are broadcast whatever the corpus.
BUCKETS, SLICE = 1 << 20, 1 << 14
#: Longest lengthening of a prefix, and what verifying a candidate costs in prefix tokens read.
MOST, VERIFY = 4, 8.0
#: Rows (under 40 bytes each) of the verification's document list that are broadcast; longer lists are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Most ids of dropped copies that are broadcast; more are dropped by a shuffle.
BROADCAST_IDS = 1_000_000
#: A token that more sets than this may hold is dealt out over so many tasks.
HOT, SALTS = 8192, 256
#: Rows of prefix tokens that one block of documents counts shared tokens in.
GATHER = 1 << 16
#: Partners of one document that are verified in one group.
GROUP = 512

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(texts: pa.Array | list[str | None], k: int, counts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, set, rarest) of each whole text: hashes of its words; sorted hashes of its k-word runs, of all words if
    they are fewer; with counts by word bucket, the least count of a run's words."""
    for lo, hi, buf, off in text_chunks(texts):
        buf = _LOWER[buf]
        s, e, doc = word_spans(buf, off, ~_SPACE)
        h = span_hashes(buf, s, e)
        g, at = gram_hashes(h, doc, k)
        w_off, g_off = (np.searchsorted(x, np.arange(hi - lo + 1)) for x in (doc, at))
        c = None if counts is None else counts[_bucket(h)]
        for i in range(hi - lo):
            a, b = w_off[i], w_off[i + 1]
            if b - a >= k:
                one, first = np.unique(g[g_off[i] : g_off[i + 1]], return_index=True)
            else:
                one, first = gram_hashes(h[a:b], doc[a:b], int(b - a))[0] ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64), np.zeros(int(b > a), np.int64)
            least = first
            if c is not None:
                least = np.minimum.reduce([c[a + first + j] for j in range(min(k, int(b - a)))]) if b > a else first
            yield h[a:b], one, least


def shingle_sets(texts: pa.Array | list[str | None], k: int) -> list[np.ndarray]:
    """The set of each whole text."""
    return [s for _, s, _ in shingles(texts, k)]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return tuple(x.view(np.int64).item() for x in (mix64(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s + np.uint64(7)))))


def describe(docs: DataFrame, k: int) -> DataFrame:
    """One pass over docs: rows (doc_id, n, d1, d2), size and digest of each text's set, and rows (slice, counts) of two
    frequency sketches: for each task, how many sets hold a shingle of each bucket of hashes, and how often words of
    each bucket stand in the texts."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n", "d1", "d2", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(2 * BUCKETS, np.int64), None
        for b in batches:
            seen = b.schema.field("doc_id").type
            sets = []
            for words, one, _ in shingles(b.column("text"), k):
                sets.append(one)
                np.add.at(total, _bucket(one), 1)
                np.add.at(total, BUCKETS + _bucket(words), 1)
            d = [_digest(s) for s in sets]
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in d], pa.int64()), pa.array([x for _, x in d], pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        if seen is not None:
            for i in range(2 * BUCKETS // SLICE):
                part = total[i * SLICE : (i + 1) * SLICE]
                if part.any():
                    width = next(w for w in ("u1", "u2", "u4", "u8") if part.max() <= np.iinfo(w).max)
                    none = pa.nulls(1)
                    yield pa.RecordBatch.from_arrays([none.cast(seen), *[none.cast(pa.int64())] * 3, pa.array([i], pa.int32()), pa.array([width.encode() + part.astype(width).tobytes()])], names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n bigint, d1 bigint, d2 bigint, slice int, counts binary")


def frequencies(described: DataFrame) -> np.ndarray:
    """The sketches of all documents: BUCKETS counts of shingles, then as many of words.

    Tasks' counts are added up slice by slice in Spark; a fixed number of counts comes to the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(c, c[:2].decode(), offset=2).astype(np.int64)
                sums[i] = sums[i] + part if i in sums else part
        for i, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([s.tobytes()])], ["slice", "counts"])

    rows = described.where("slice IS NOT NULL").select("slice", "counts").repartition("slice").mapInArrow(add, "slice int, counts binary").collect()
    total = np.zeros(2 * BUCKETS, np.int64)
    for r in rows:
        total[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    return total


def shingle_levels(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """(by shingle bucket, how often its shingles may occur; what chance alone explains)."""
    usual = float(np.median(counts[:BUCKETS]))
    return counts[:BUCKETS], usual + max(8.0, 6 * np.sqrt(max(usual, 1.0)))


def prefix_tokens(s: np.ndarray, rarest: np.ndarray, counts: np.ndarray, chance: float, similar: tuple[int, int]) -> tuple[np.ndarray, int, np.ndarray]:
    """(prefix, matches, counts): the set's first tokens in the global order, rare ones first, how many must be shared,
    and how many sets may hold each beyond what chance puts into its bucket.

    A shingle occurs no more often than its bucket's count or its rarest word; the lesser ranks it. A prefix for m
    matches has m - 1 tokens more than one for a single match. The one of least estimated cost is taken: its tokens'
    frequencies are the postings read, and their sum over m bounds the candidates to verify.
    """
    num, den = similar
    n = len(s)
    c = counts[_bucket(s)]
    level = (4 * np.log2(np.maximum(1, np.minimum(c, rarest)))).astype(np.uint64)
    t = (np.minimum(level, np.uint64(127)) << np.uint64(57)) | (s >> np.uint64(7))
    short = n - -(-num * n // den)
    order = np.argsort(t)[: short + MOST]
    often = np.maximum(1, np.minimum(np.where(c > chance, c, 1), rarest))[order]
    f = np.cumsum(often.astype(np.float64))
    best, cost = 1, np.inf
    for m in range(1, min(MOST, n - short) + 1):
        postings = f[short + m - 1]
        all_in = short + m + postings + VERIFY * postings / m
        if all_in < cost:
            best, cost = m, all_in
    return t[order[: short + best]], best, often[: short + best]


def prefix_rows(docs: DataFrame, k: int, counts: np.ndarray, similar: tuple[int, int]) -> DataFrame:
    """(token, doc_id, meta: n, i, m, hot): the prefix of every text's set, by place; of equal sets that a task meets only
    the first's. hot: so many sets may hold the token that its rows are to be dealt out over tasks."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32))
    names = ["token", "doc_id", "meta", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        grams, chance = shingle_levels(shared.value)
        for b in batches:
            ids = b.column("doc_id")
            rows, tokens, meta, hot = [], [], [], []
            for i, (_, s, rarest) in enumerate(shingles(b.column("text"), k, shared.value[BUCKETS:])):
                key = _digest(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                t, m, often = prefix_tokens(s, rarest, grams, chance, similar)
                rows.append(np.full(len(t), i))
                tokens.append(t.view(np.int64))
                meta.append((np.int64(len(s)) << 32 | m << 28) | np.arange(len(t)))
                hot.append(often > HOT)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), ids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(meta)), pa.array(np.concatenate(hot))], names)

    d = docs.where("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, f"token bigint, doc_id {kind}, meta bigint, hot boolean")


def _n(meta: Column) -> Column:
    return F.shiftright(meta, 32)


def _m(meta: Column) -> Column:
    return F.shiftright(meta, 28).bitwiseAND(15)


def _i(meta: Column) -> Column:
    return meta.bitwiseAND((1 << 28) - 1)


def _may_match(a: Column, b: Column, similar: tuple[int, int]) -> Column:
    """Whether two prefix places of a shared token may be among the first m matches of similar sets."""
    num, den = similar
    rest = F.least(_n(a) - _i(a), _n(b) - _i(b)) + F.least(_m(a), _m(b)) - 1
    return (rest * (num + den) >= num * (_n(a) + _n(b))) & (_n(a) * den >= num * _n(b)) & (_n(b) * den >= num * _n(a))


def shared_pairs(mixed: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(x, y), x < y, of documents in different components that share enough prefix tokens to be similar.

    mixed has token, doc_id, meta, root, most (what a document can share at all) and lead. Prefixes of px and py tokens
    of sets that overlap by t share at least the lesser of px - (nx - t) and py - (ny - t) tokens, as all of one
    prefix's matches lie in the other. Rows are gathered by the document that leads their bucket, whose buckets hold
    much the same documents, and shared tokens are counted there for whole blocks of documents at once; a large
    gathering is cut into blocks of documents by hash, each pair of blocks a task's group, so none grows with the data.
    """
    num, den = similar
    kind = dict(mixed.dtypes)["doc_id"]
    size = mixed.groupBy("lead").agg(F.ceil(F.count("*") / GATHER).cast("int").alias("blocks"))
    d = mixed.join(size, "lead").withColumn("b", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    d = d.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("lead", F.least("b", "o").alias("b0"), F.greatest("b", "o").alias("b1"), "b", "token", "doc_id", "meta", "root", "most")
    d = d.repartition("lead", "b0", "b1").sortWithinPartitions("lead", "b0", "b1")

    def emit(rows: dict[str, np.ndarray], ids: pa.Array) -> pa.RecordBatch | None:
        _, token = np.unique(rows["token"], return_inverse=True)
        _, first, doc = np.unique(np.stack([rows["row"], rows["meta"] >> 28]), axis=1, return_index=True, return_inverse=True)
        doc = doc.ravel()
        n, m, root, most, block = (rows[c][first] for c in ("n", "m", "root", "most", "b"))
        out, side_rows = [], 512
        for i0 in range(0, len(first), side_rows):
            for j0 in range(i0, len(first), side_rows):
                i1, j1 = min(i0 + side_rows, len(first)), min(j0 + side_rows, len(first))
                a, b = ((doc >= lo) & (doc < hi) for lo, hi in ((i0, i1), (j0, j1)))
                both = np.intersect1d(token[a], token[b])
                counts = np.zeros((i1 - i0, j1 - j0), np.float32)
                for t0 in range(0, len(both), 2048):
                    some = both[t0 : t0 + 2048]
                    side = []
                    for at, lo, hi in ((a, i0, i1), (b, j0, j1)):
                        k = np.searchsorted(some, token[at])
                        ok = (k < len(some)) & (some[np.minimum(k, len(some) - 1)] == token[at])
                        x = np.zeros((hi - lo, len(some)), np.float32)
                        x[doc[at][ok] - lo, k[ok]] = 1
                        side.append(x)
                    counts += side[0] @ side[1].T
                apart = root[i0:i1, None] != root[None, j0:j1]
                x, y = np.nonzero((counts > 0) & (np.triu(apart, 1) if i0 == j0 else apart))
                c = counts[x, y].astype(np.int64)
                x, y = x + i0, y + j0
                t = -(-num * (n[x] + n[y]) // (num + den))
                keep = (np.minimum(most[x], most[y]) >= t) & (n[x] * den >= num * n[y]) & (n[y] * den >= num * n[x])
                if rows["b0"][0] != rows["b1"][0]:
                    keep &= block[x] != block[y]
                need = np.minimum(t - (-(-num * n[x] // den)) + m[x], t - (-(-num * n[y] // den)) + m[y])
                out.append((first[x[keep]], first[y[keep]], c[keep], need[keep]))
        x, y, c, need = (np.concatenate([o[i] for o in out]) for i in range(4))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(c), pa.array(need)], ["x", "y", "c", "need"]) if len(x) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(t: pa.Table) -> pa.RecordBatch | None:
            t = t.combine_chunks()
            ids = t["doc_id"].combine_chunks() if isinstance(t["doc_id"], pa.ChunkedArray) else t["doc_id"]
            ids = ids if isinstance(ids, pa.Array) else ids.chunk(0)
            rows = {c: t[c].to_numpy() for c in ("token", "meta", "root", "most", "b", "b0", "b1")}
            rows |= {"row": ids.to_numpy(zero_copy_only=False), "n": rows["meta"] >> 32, "m": (rows["meta"] >> 28) & 15}
            return emit(rows, ids)

        for batch in batches:
            held.append(batch)
            t = pa.Table.from_batches(held)
            key = [t[c].to_numpy() for c in ("lead", "b0", "b1")]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            for lo, hi in zip(np.append(0, cut[:-1]), cut, strict=True) if len(cut) else ():
                if (r := settle(t.slice(int(lo), int(hi - lo)))) is not None:
                    yield r
            held = t.slice(int(cut[-1])).to_batches() if len(cut) else held
        if held and (r := settle(pa.Table.from_batches(held))) is not None:
            yield r

    pairs = d.mapInArrow(run, f"x {kind}, y {kind}, c bigint, need bigint")
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "c", "need").where("x <> y")
    return pairs.groupBy("x", "y").agg(F.sum("c").alias("c"), F.min("need").alias("need")).where("c >= need").select("x", "y")


def verify_pairs(docs: DataFrame, pairs: DataFrame, k: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs (x, y) of doc_ids whose texts' sets are similar enough, compared shingle by shingle.

    Partners of one x are gathered in groups of about GROUP, each with x's text once, and streamed through.
    """
    num, den = similar
    pairs = materialize(pairs.select("x", "y"))
    count = pairs.groupBy("x").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    p = pairs.join(count, "x").withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts"))).select("x", "part", "y")
    need = p.select("x", "part", F.lit(1).alias("role"), F.col("y").alias("doc")).unionByName(p.select("x", "part", F.lit(0).alias("role"), F.col("x").alias("doc")).distinct())
    need = materialize(need)
    text = docs.select(F.col("doc_id").alias("doc"), F.col("text").cast("string").alias("text"))
    need = F.broadcast(need) if small_enough(need, BROADCAST_ROWS) else need
    rows = text.join(need, "doc").select("x", "part", "role", "doc", "text").repartition("x", "part").sortWithinPartitions("x", "part", "role", "doc")
    kind = dict(pairs.dtypes)["x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads = None, []
        for b in batches:
            xs, parts, roles, ids = (b.column(c).to_pylist() for c in ("x", "part", "role", "doc"))
            found = []
            for j, s in enumerate(shingle_sets(b.column("text"), k)):
                if (xs[j], parts[j]) != group:
                    group, heads = (xs[j], parts[j]), []
                if roles[j] == 0:
                    heads.append(s)
                    continue
                for h in heads:
                    a, c = (h, s) if len(h) >= len(s) else (s, h)
                    at = np.searchsorted(a, c)
                    both = int((a[np.minimum(at, len(a) - 1)] == c).sum()) if len(a) else 0
                    if both and den * both >= num * (len(a) + len(c) - both):
                        found.append((xs[j], ids[j]))
            if found:
                t = b.schema.field("x").type
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], t), pa.array([f[1] for f in found], t)], ["x", "y"])

    return materialize(rows.mapInArrow(run, f"x {kind}, y {kind}"))


def led_tokens(tokens: DataFrame) -> DataFrame:
    """(token, doc_id, meta, lead, lead_meta, hot): rows of tokens that several documents hold, with the one whose prefix
    has the token first. Rows of a hot token meet salt by salt, and then as one row a salt."""
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    w = Window.partitionBy("token", "salt")
    t = tokens.withColumn("salt", salt).withColumn("c", F.count("*").over(w)).withColumn("lead", F.min(F.struct(_i(F.col("meta")).alias("i"), "doc_id", "meta")).over(w))
    t = materialize(t.where("hot OR c > 1").select("token", "doc_id", "meta", F.col("lead.doc_id").alias("lead"), F.col("lead.meta").alias("lead_meta"), "hot"), "hot")
    hot = t.where("hot")
    if hot.isEmpty():
        return t
    first = hot.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct(_i(F.col("lead_meta")).alias("i"), "lead", "lead_meta")).alias("first")).where("c > 1")
    hot = hot.select("token", "doc_id", "meta").join(first, "token").select("token", "doc_id", "meta", F.col("first.lead").alias("lead"), F.col("first.lead_meta").alias("lead_meta"), F.lit(True).alias("hot"))
    return t.where("NOT hot").unionByName(materialize(hot))


def apart_tokens(own: DataFrame) -> DataFrame:
    """The rows of own (token, root, hot and others) whose token several components hold."""
    w = Window.partitionBy("token")
    cold = own.where("NOT hot").withColumn("low", F.min("root").over(w)).withColumn("high", F.max("root").over(w)).where("low < high")
    hot = own.where("hot").groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    return cold.drop("low", "high").unionByName(own.where("hot").join(hot, "token").select(*own.columns))


def jaccard_components(docs: DataFrame, k: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text): components of similar documents.

    Two documents are linked when the Jaccard similarity of their sets of k-word shingles is at least similar.
    Documents of equal sets are linked without comparison. Of the rest, each links first with the document that
    leads a prefix token's bucket; only what then stands in different components of a bucket is paired, needs as
    many shared prefix tokens as its prefixes were lengthened for, and is verified. No partner is dropped.

    Words are runs without white space, A-Z lower-cased. Null and empty texts have an empty set and link with
    nothing; a doc_id that repeats is one document whose texts all count, each row keeping its own n_shingles; rows
    of null doc_id link with nothing and have no component; an empty table gives no rows. doc_id is a whole number.
    """
    d = materialize(describe(docs, k))
    counts = frequencies(d)
    rows = d.where("slice IS NULL").select("doc_id", "n", "d1", "d2")
    usable = rows.where("n > 0 AND doc_id IS NOT NULL")
    first = usable.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("dst"), F.count("*").alias("c")).where("c > 1").drop("c")
    equal = materialize(usable.join(first, ["n", "d1", "d2"]).select(F.col("doc_id").alias("src"), "dst").where("src <> dst").distinct())

    tokens = led_tokens(prefix_rows(docs, k, counts, similar))
    star = tokens.where(F.col("doc_id") != F.col("lead")).where(_may_match(F.col("meta"), F.col("lead_meta"), similar))
    star = star.groupBy(F.col("lead").alias("x"), F.col("doc_id").alias("y")).agg(F.count("*").alias("c"), F.max(F.least(_m(F.col("meta")), _m(F.col("lead_meta")))).alias("m")).where("c >= m").select("x", "y")
    tried = materialize(star)
    links = verify_pairs(docs, tried, k, similar)
    edges = equal.unionByName(links.select(F.col("x").alias("src"), F.col("y").alias("dst")))
    roots = connected_components(edges)

    own = tokens.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("token", "doc_id", "meta", F.coalesce("root", "doc_id").alias("root"), "lead", "hot")
    mixed = apart_tokens(own).drop("hot")
    # a document's prefix tokens outside these buckets are shared with no other component: they bound every overlap
    num, den = similar
    n = _n(F.col("meta"))
    length = n + _m(F.col("meta")) - F.ceil(num * n / den)
    mixed = mixed.withColumn("most", n - length + F.count("*").over(Window.partitionBy("doc_id", n)))
    mixed = materialize(mixed.where(F.col("most") * den >= num * n))
    more = shared_pairs(mixed, similar)
    both = tried.unionByName(tried.select(F.col("y").alias("x"), F.col("x").alias("y")))
    more = more.join(both, ["x", "y"], "left_anti")
    links = verify_pairs(docs, more, k, similar)
    edges = roots.select(F.col("node").alias("src"), F.col("root").alias("dst")).unionByName(links.select(F.col("x").alias("src"), F.col("y").alias("dst")))
    roots = connected_components(edges)
    out = rows.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component, with their own columns; null doc_ids stay."""
    (name,) = free_names(docs, "gone")
    gone = materialize(jaccard_components(docs, k, similar).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    gone = F.broadcast(gone) if small_enough(gone, BROADCAST_IDS) else gone
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def op7_ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """The digest of jaccard_components on four words and a similarity of 0.85: one row per document."""
    return jaccard_components(docs, 4, (85, 100)).select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")

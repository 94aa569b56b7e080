"""Operator 9: embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, small_enough

#: Vectors are linked from this cosine on.
COSINE = 0.98
#: Leading principal dimensions of the grid, and of the bounds by which intervals are told apart.
DIMS, BOUNDS = 6, 16
#: Most vectors, and components of them, that the principal dimensions are learnt from, those of least hash; they only
#: steer the pruning.
SAMPLE_ROWS, SAMPLE_VALUES = 10_000, 1 << 21
#: Vectors of a block, the shortest sequence interval; as many fewer as keep it at so many components.
BLOCK_ROWS, BLOCK_VALUES = 256, 1 << 18
#: Intervals that an interval of the next level joins.
FAN = 16
#: Most partitions' block numbers that are broadcast.
BROADCAST_PARTS = 1_000_000
#: What distances in the grid may be off by rounding.
SLACK = 1e-6


def _usable(v: Column) -> Column:
    """Neither null nor empty nor zero, all components finite."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrices(vecs: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit rows in double precision) of the vectors of each length."""
    size = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        x = vecs.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
        yield at, x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_dimensions(classes: DataFrame, dims: int = BOUNDS, sample_rows: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """By vector length, the leading principal dimensions (orthonormal columns) of a bounded sample of unit vectors."""
    longest = classes.agg(F.max(F.size("vec"))).first()[0] or 1
    rows = classes.select("vec", F.xxhash64("k1").alias("h")).orderBy("h").limit(min(sample_rows, max(64, SAMPLE_VALUES // longest))).select("vec").toArrow()
    out = {}
    for _, x in _matrices(rows["vec"].combine_chunks()) if rows.num_rows else ():
        x = x - x.mean(axis=0)
        out[x.shape[1]] = np.ascontiguousarray(np.linalg.svd(x.T @ x)[0][:, :dims])
    return out


def _project(vecs: pa.ListArray, basis: dict[int, np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(vecs), dims))
    for at, x in _matrices(vecs):
        q = x @ basis[x.shape[1]] if x.shape[1] in basis else x[:, :dims]
        out[at, : q.shape[1]] = q
    return out


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members vec_id, k1, k2, label of usable vectors; a row per distinct vector and label: cid, rep, copies, vec, keys).

    Equal vectors of a label share a 128-bit hash; each class goes on as one row under a number of its own, so copies
    cost nothing later on. The classes are written, so their numbers stay.
    """
    d = vectors.select("vec_id", F.col("embedding").alias("vec"), "label").where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    d = d.withColumns({"k1": F.xxhash64(F.lit(1), "vec"), "k2": F.xxhash64(F.lit(2), "vec")})
    one = d.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    return d.select("vec_id", "k1", "k2", "label"), materialize(one.withColumn("cid", F.monotonically_increasing_id()))


def grid_blocks(classes: DataFrame, epsilon: float, dims: int = DIMS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of consecutive vectors in epsilon grid order: grp, part, seq, lo and hi (of coordinates), cids, copies, vecs.

    Vectors of a group (label and length) are range-sorted by their grid cells over the leading dimensions.
    """
    width = max(dims, BOUNDS)
    shared = classes.sparkSession.sparkContext.broadcast(principal_dimensions(classes, width))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _project(b.column("vec"), shared.value, width)
            cells = np.floor(q[:, :dims] / epsilon).astype(np.int64)
            q = pa.ListArray.from_arrays(np.arange(len(q) + 1, dtype=np.int32) * width, q.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, q, *[pa.array(c) for c in cells.T]], [*b.schema.names, "q", *[f"c{i}" for i in range(dims)]])

    d = classes.select(F.concat_ws("/", F.col("label").cast("string"), F.size("vec")).alias("grp"), "cid", "copies", "vec")
    cells, kind = [f"c{i}" for i in range(dims)], dict(d.dtypes)["vec"]
    d = d.mapInArrow(place, f"grp string, cid bigint, copies bigint, vec {kind}, q array<double>, " + ", ".join(f"{c} bigint" for c in cells))
    d = d.repartitionByRange("grp", *cells, "cid").sortWithinPartitions("grp", *cells, "cid").drop(*cells).withColumn("part", F.spark_partition_id())
    names = ["grp", "part", "seq", "lo", "hi", "cids", "copies", "vecs"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seq = None, 0
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            *out, held = _cuts(t, block_rows)
            for x in out:
                yield _block(x, seq, names)
                seq += 1
        if held is not None and held.num_rows:
            yield _block(held, seq, names)

    return d.mapInArrow(cut, f"grp string, part int, seq bigint, lo array<double>, hi array<double>, cids array<bigint>, copies array<bigint>, vecs {kind}")


def _cuts(t: pa.Table, rows: int) -> list[pa.Table]:
    """t in runs of one group and a block's rows at most; the last may go on."""
    g = t["grp"].to_numpy()
    change = np.flatnonzero(g[1:] != g[:-1]) + 1
    out = []
    for a, b in zip(np.append(0, change), np.append(change, len(g)), strict=True):
        size = len(t["vec"][int(a)]) if b > a else 1
        step = max(4, min(rows, BLOCK_VALUES // max(1, size)))
        out += [t.slice(i, min(step, b - i)) for i in range(int(a), int(b), step)]
    return out or [t]


def _block(t: pa.Table, seq: int, names: list[str]) -> pa.RecordBatch:
    t = t.combine_chunks()
    q = t["q"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = [pa.array(q.min(axis=0)), pa.array(q.max(axis=0)), *[t[c].combine_chunks() for c in ("cid", "copies")], t["vec"].combine_chunks().flatten()]
    return pa.RecordBatch.from_arrays([t["grp"].combine_chunks().slice(0, 1), t["part"].combine_chunks().slice(0, 1), pa.array([seq]), *map(one, columns)], names)


def near_intervals(blocks: DataFrame, epsilon: float, fan: int = FAN) -> DataFrame:
    """(grp, a, b: block numbers, a <= b) of the blocks that are not provably more than epsilon apart.

    Intervals of fan blocks, fan of those and so on carry the bounds of all they hold; pairs of intervals of the
    top level are split level by level, and pairs whose bounds are too far apart go no further, so the work follows
    what is near and not the square of the blocks.
    """
    b = materialize(blocks.select("grp", "no", "lo", "hi"))
    most = b.agg(F.max("no")).first()[0]
    levels = 0
    while most is not None and fan ** (levels + 1) <= most:
        levels += 1
    dims = F.sequence(F.lit(0), F.size("lo_a") - 1)
    gap = F.aggregate(F.transform(dims, lambda i: F.pow(F.greatest(F.lit(0.0), F.get("lo_a", i) - F.get("hi_b", i), F.get("lo_b", i) - F.get("hi_a", i)), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    near = (F.col("a") <= F.col("b")) & (gap <= epsilon * epsilon)

    def level(k: int) -> DataFrame:
        """Intervals of fan ** k blocks and their bounds."""
        if k == 0:
            return b
        e = b.select("grp", F.floor(F.col("no") / fan**k).cast("long").alias("no"), F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "x"))
        e = e.groupBy("grp", "no", "i").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
        e = e.groupBy("grp", "no").agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("x"))
        return e.select("grp", "no", F.transform("x", lambda x: x["lo"]).alias("lo"), F.transform("x", lambda x: x["hi"]).alias("hi"))

    pairs = None
    for k in range(levels, -1, -1):
        n = level(k)
        left = n.select("grp", F.col("no").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.floor(F.col("no") / fan).cast("long").alias("up_a"))
        right = n.select("grp", F.col("no").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.floor(F.col("no") / fan).cast("long").alias("up_b"))
        if pairs is None:  # one interval at most is above the top level's
            pairs = left.join(right, "grp")
        else:
            pairs = pairs.select("grp", F.col("a").alias("up_a"), F.col("b").alias("up_b")).join(left, ["grp", "up_a"]).join(right, ["grp", "up_b"])
        pairs = pairs.where(near).select("grp", "a", "b")
        if k:
            pairs = materialize(pairs)
    return pairs


def _forest(near: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the links near[u, v] join: each linked end with the least end it reaches."""
    a, b = np.where(near.any(axis=1), u, np.iinfo(np.int64).max), np.where(near.any(axis=0), v, np.iinfo(np.int64).max)
    top = np.iinfo(np.int64).max
    while True:
        a2 = np.minimum(a, np.where(near, b[None, :], top).min(axis=1))
        b2 = np.minimum(b, np.where(near, a2[:, None], top).min(axis=0))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    ends, low = np.concatenate([u, v]), np.concatenate([a, b])
    keep = (low != top) & (low != ends)
    return ends[keep], low[keep]


def near_blocks(blocks: DataFrame, pairs: DataFrame, fan: int = FAN) -> DataFrame:
    """grp, ia, ib, no, cids, copies, vecs and near: for each pair of intervals of fan blocks, its near block pairs as
    one row (no -1), then the blocks that occur in them, each once however many pairs it is in."""
    p = pairs.select("grp", F.floor(F.col("a") / fan).alias("ia"), F.floor(F.col("b") / fan).alias("ib"), "a", "b")
    near = p.groupBy("grp", "ia", "ib").agg(F.collect_list(F.struct("a", "b")).alias("near")).withColumn("no", F.lit(-1).cast("long"))
    need = p.select("grp", "ia", "ib", F.explode(F.array("a", "b")).alias("no")).distinct()
    rows = need.join(blocks.select("grp", "no", "cids", "copies", "vecs"), ["grp", "no"])
    rows = rows.unionByName(near, allowMissingColumns=True).select("grp", "ia", "ib", "no", "cids", "copies", "vecs", "near")
    return rows.repartition("grp", "ia", "ib").sortWithinPartitions("grp", "ia", "ib", "no")


def epsilon_join(vectors: DataFrame, cosine: float = COSINE, dims: int = DIMS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each row of vectors (vec_id, embedding, label): n_links and component_id over links of cosine or more.

    Only vectors of equal label and length are compared, in double precision. Null, zero and non-finite vectors, and
    those with null label or vec_id, link with nothing. Equal vectors of a label are joined as one class with its
    number of copies. Repeated rows, and different vectors under one vec_id, count as vectors of their own: each has
    its own links, and its component_id is the least vec_id among the vectors that it reaches. Links between classes
    are counted block against block and never listed; components come from the edges that span each block pair's
    links. Empty tables give no rows.
    """
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    members, classes = vector_classes(vectors)
    cut = materialize(grid_blocks(classes, epsilon, dims, block_rows))
    # numbers in order: blocks of earlier partitions come first
    parts = cut.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("seq").alias("s0"))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("grp", "part", "s0", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    blocks = cut.join(F.broadcast(base) if small_enough(base, BROADCAST_PARTS) else base, ["grp", "part"]).withColumn("no", F.col("base") + F.col("seq") - F.col("s0"))
    rows = near_blocks(blocks, near_intervals(blocks, epsilon))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: list[dict] = []
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def links() -> Iterator[pa.RecordBatch]:
            for pair in near:
                (u, m, x), (v, n, y) = held[pair["a"]], held[pair["b"]]
                same = pair["a"] == pair["b"]
                hit = x @ y.T >= cosine
                if same:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                count = [(u, hit @ n)] + ([] if same else [(v, m @ hit)])
                ids, found = np.concatenate([c[0] for c in count]), np.concatenate([c[1] for c in count])
                ids, found = ids[found > 0], found[found > 0]
                src, dst = _forest(hit, u, v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, src])), pa.array(np.concatenate([np.zeros(len(ids), np.int64), dst]), mask=np.arange(len(ids) + len(src)) < len(ids)), pa.array(np.concatenate([found, np.zeros(len(src), np.int64)]))], ["u", "v", "links"])

        for batch in batches:
            for i in range(batch.num_rows):
                no = batch.column("no")[i].as_py()
                if no < 0:  # the next pair of intervals
                    yield from links()
                    near, held = batch.column("near")[i].as_py(), {}
                    continue
                cids, copies, vecs = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("cids", "copies", "vecs"))
                x = vecs.astype(np.float64).reshape(len(cids), -1)
                held[no] = cids, copies, x / np.linalg.norm(x, axis=1, keepdims=True)
        yield from links()

    found = materialize(rows.mapInArrow(verify, "u bigint, v bigint, links bigint"))
    discard(cut)
    links = found.where("v IS NULL").groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("v IS NOT NULL").select(F.col("u").alias("src"), F.col("v").alias("dst")))
    per = classes.select("label", "k1", "k2", "cid", "rep", "copies").join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    per = per.withColumn("root", F.coalesce("root", "cid"))
    least = per.groupBy("root").agg(F.min("rep").alias("component_id"))
    per = per.join(least, "root").select("label", "k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    done = members.join(per, ["label", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = vectors.where(~(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _usable(F.col("embedding"))))
    return done.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op9_embedding_near_dedup(vectors: DataFrame) -> DataFrame:
    """The digest of epsilon_join: one row per vector, kept where it stands for its component."""
    d = epsilon_join(vectors)
    return d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))

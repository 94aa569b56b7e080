"""Operator 4: mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, small_enough

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Most times that a source, and so a document, is repeated.
REPEATS = 3
#: Documents that one sorted bucket holds on average.
BUCKET_ROWS = 4096
#: Rows of equal id and text that are numbered at once; longer runs of them are dealt out over tasks.
RUN_ROWS = 1 << 16
#: Most sources whose cuts are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
TOKEN = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target, rank) of sizes (source, size): shares by weight, none above repeats times its source.

    Sources are ranked by code point, null last. What a capped source can't take is shared out again by weight,
    until none is above: all sources whose cap over weight lies below a common level are capped. One row per source
    is ordered in one place; documents aren't.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    s = s.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") - 1) % len(weights))).withColumn("cap", F.lit(float(repeats)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    left = F.col("total") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0.0))
    s = s.withColumn("level", left / weight)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(everything)
    return s.withColumn("rank", F.row_number().over(order)).withColumn("level", first["level"]).select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"), F.col("place").alias("rank"))


def _place(doc_id: Column, text: Column, seed: int) -> tuple[Column, Column]:
    """(h, length): 60 bits that shuffle the documents, and what tells texts of equal ones apart."""
    t, i = F.coalesce(text.cast("string"), F.lit("")), F.coalesce(doc_id.cast("string"), F.lit(""))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), i, t).cast("binary")), 1, 15), 16, 10).cast("long")
    return h, F.octet_length(t).cast("long")


def _virtual_times(docs: DataFrame, weights, repeats: int, seed: int) -> tuple[DataFrame, int, int]:
    """(documents, buckets, budget): equal ids with equal texts as one row of n, with their source's tokens before
    them (cum0), its size, target and rank. Prefix sums are two-level, so that no task holds a source."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(TOKEN)).cast("long")
    h, length = _place(F.col("doc_id"), F.col("text"), seed)
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), h.alias("h"), length.alias("length"))
    d = materialize(d.groupBy("doc_id", "source", "size", "h", "length").agg(F.count("*").alias("n")).withColumn("mass", F.col("size") * F.col("n")))
    rows, budget = d.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("mass"), F.lit(0))).first()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    d = d.withColumn("part", F.floor(F.col("h") / F.lit(float(1 << 60)) * buckets).cast("int"))
    targets = source_targets(d.select("source", F.col("mass").alias("size")), weights, repeats).withColumnRenamed("source", "t_source")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy("source", "part").agg(F.sum("mass").alias("sum")).withColumn("offset", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    parts = parts.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), "offset", "source_size", "target", "rank")
    inside = Window.partitionBy("source", "part").orderBy("h", "doc_id", "length").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("inside", F.sum("mass").over(inside) - F.col("mass"))
    d = d.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    return materialize(d.withColumn("cum0", F.col("offset") + F.col("inside")).drop("part", "inside", "offset", "p_source", "p_part", "mass")), buckets, budget


def _numbered(d: DataFrame) -> DataFrame:
    """Each of a row's n documents as a row with its number j."""
    short = d.where(F.col("n") <= RUN_ROWS).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("j", F.col("j").cast("long"))
    long = d.where(F.col("n") > RUN_ROWS).withColumn("lo", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(RUN_ROWS).cast("long")))).repartition("h", "lo")
    long = long.withColumn("j", F.explode(F.sequence("lo", F.least(F.col("n"), F.col("lo") + (RUN_ROWS - 1))))).drop("lo")
    return short.unionByName(long)


def _finish(e: Column) -> Column:
    """Virtual finish time of copy e: tokens of the source up to and with it, e whole rounds included, over the target."""
    return (e * F.col("source_size") + F.col("cum0") + F.col("j") * F.col("size")) / F.col("target")


def _cuts(d: DataFrame, buckets: int, budget: int, repeats: int) -> DataFrame:
    """(c_source, top: the source's last copy that the budget takes, as e, h, doc_id, length, j, n).

    Copies are dealt by finish time into even ranges; the ranges' tokens are added up in order, and the one range in
    which the budget runs out is sorted. A source's copies are taken in the order of e, h, doc_id, length, j.
    """
    rounds = F.least(F.lit(repeats), F.ceil(F.col("target") / F.col("source_size"))).cast("int") - 1
    c = _numbered(d.where((F.col("size") > 0) & (F.col("target") > 0))).withColumn("e", F.explode(F.sequence(F.lit(0), rounds)))
    c = c.withColumn("finish", _finish(F.col("e"))).withColumn("bucket", F.floor(F.col("finish") * buckets))
    mass = c.groupBy("bucket").agg(F.sum("size").alias("mass"))
    upto = F.sum("mass").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    over = mass.withColumn("upto", upto).where(F.col("upto") > budget).orderBy("bucket").select("bucket", (F.col("upto") - F.col("mass")).alias("before")).first()
    if over is not None:
        order = Window.orderBy("finish", "rank", "h", "doc_id", "length", "j").rowsBetween(Window.unboundedPreceding, 0)
        edge = c.where(F.col("bucket") == over["bucket"]).withColumn("run", F.sum("size").over(order)).where(F.col("run") <= budget - over["before"])
        c = c.where(F.col("bucket") < over["bucket"]).unionByName(edge.drop("run"))
    return materialize(c.groupBy(F.col("source").alias("c_source")).agg(F.max(F.struct("e", "h", "doc_id", "length", "j", "n")).alias("top")))


def _copies(key: Column, j: Column) -> Column:
    """How often a document is taken, from its source's last taken copy."""
    top = F.struct(F.col("top.h").alias("h"), F.col("top.doc_id").alias("doc_id"), F.col("top.length").alias("length"))
    within = (key < top) | ((key == top) & (j <= F.col("top.j")))
    return F.coalesce(F.col("top.e") + F.when(within, 1).otherwise(0), F.lit(0))


def _with_cuts(d: DataFrame, cuts: DataFrame, source: Column) -> DataFrame:
    small = F.broadcast(cuts) if small_enough(cuts, BROADCAST_SOURCES) else cuts
    return d.join(small, source.eqNullSafe(F.col("c_source")), "left")


def fair_queue(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """The mix of docs (doc_id, text, source) as copies of documents with their virtual finish times.

    Documents of a source are shuffled by a seeded hash of id and text; copy e of a document finishes at (tokens of
    the source before and in it, e whole rounds of the source included) / target. Copies are taken in the order of
    their finish times while the running total of tokens stays within the budget, the sum of all tokens. Rows of
    equal id and text are interchangeable and told apart by a number; reruns agree. Null texts have size 0, null
    source is a source, empty tables give no rows.

    Returns per document doc_id, size, source, source_size, target, copies (taken copies' finish times, in order).
    """
    d, buckets, budget = _virtual_times(docs, weights, repeats, seed)
    d = _with_cuts(_numbered(d), _cuts(d, buckets, budget, repeats), F.col("source"))
    n = F.when(F.col("size") > 0, _copies(F.struct("h", "doc_id", "length"), F.col("j"))).otherwise(0)
    times = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), _finish)).otherwise(F.array().cast("array<double>"))
    return d.select("doc_id", "size", "source", "source_size", "target", times.alias("copies"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """The mixed corpus: a row per taken copy of a row of docs, its own columns and copy_no, in no particular order.

    See fair_queue. A source's last taken copy says how often each of its rows is taken, so texts are not shuffled;
    only where that copy is one of several rows of equal id and text are those rows numbered. No more words than docs
    has are taken, repeated and null ids or not. A column named copy_no is replaced; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c != "copy_no"]
    d, buckets, budget = _virtual_times(docs, weights, repeats, seed)
    cuts = _cuts(d, buckets, budget, repeats)
    discard(d)
    h, length = _place(F.col("doc_id"), F.col("text"), seed)
    some = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(TOKEN)
    rows = docs.where(some).select(F.struct(*keep).alias("row"), F.struct(h.alias("h"), F.col("doc_id"), length.alias("length")).alias("key"))
    rows = _with_cuts(rows, cuts, F.col("row.source").cast("string"))
    top = F.struct(F.col("top.h").alias("h"), F.col("top.doc_id").alias("doc_id"), F.col("top.length").alias("length"))
    torn = F.coalesce((F.col("key") == top) & (F.col("top.n") > F.col("top.j")), F.lit(False))
    taken = rows.select("row", _copies(F.col("key"), F.lit(1)).alias("copies"))
    if not cuts.where("top.n > top.j").isEmpty():
        edge = materialize(rows.where(torn).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024))))
        per = edge.groupBy(F.col("c_source").alias("p_source"), F.col("salt").alias("p_salt")).agg(F.count("*").alias("m"))
        earlier = Window.partitionBy("p_source").orderBy("p_salt").rowsBetween(Window.unboundedPreceding, -1)
        per = per.withColumn("before", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
        edge = edge.join(per, F.col("c_source").eqNullSafe(F.col("p_source")) & (F.col("salt") == F.col("p_salt")))
        edge = edge.withColumn("j", F.col("before") + F.row_number().over(Window.partitionBy("c_source", "salt").orderBy("key")))
        taken = rows.where(~torn).select("row", _copies(F.col("key"), F.lit(1)).alias("copies")).unionByName(edge.select("row", _copies(F.col("key"), F.col("j")).alias("copies")))
    return taken.where("copies > 0").select("row.*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"))


def op4_mix_sources(docs: DataFrame) -> DataFrame:
    """The digest of fair_queue: one row per document with the words that the mix takes of it, repeats counted."""
    q = fair_queue(docs)
    return q.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.size("copies")).cast("long").alias("taken"), "source", F.get("copies", F.lit(0)).alias("finish"))

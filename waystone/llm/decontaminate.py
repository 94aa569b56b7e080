"""Operator 2: benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waystone.functions.geo import held

from .common import free_names, materialize, small_enough, words

#: Shared spans of WINDOW words are found without exception: GRAM + SPAN - 1.
GRAM, SPAN = 5, 6
WINDOW = GRAM + SPAN - 1
#: Most benchmark windows that are broadcast (under 200 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
#: Most contaminated ids that are broadcast to be dropped; more are dropped by a shuffle.
BROADCAST_IDS = 1_000_000


def _shift(a: Column, n: int) -> Column:
    return F.slice(a, n + 1, F.size(a))


def _minima(d: DataFrame) -> DataFrame:
    """Adds grams (hash of the GRAM words at each place, its low 3 bits the place mod 8) and mins (least of SPAN).

    g stands behind a generator: named inside a lambda, it would be worked out again for every place.
    """
    two = lambda a, b: F.xxhash64(a, b)
    least = lambda a, b: F.least(a, b)
    d = d.withColumn("h1", F.transform("w", lambda x: F.xxhash64(x)))
    d = d.withColumn("h2", F.zip_with("h1", _shift(F.col("h1"), 1), two))
    d = d.withColumn("h4", F.zip_with("h2", _shift(F.col("h2"), 2), two))
    d = d.withColumn("h5", F.slice(F.zip_with("h4", _shift(F.col("h1"), 4), two), 1, F.greatest(F.size("w") - (GRAM - 1), F.lit(0))))
    d = held(d, g=F.transform("h5", lambda x, i: x.bitwiseAND(-8) + F.pmod(i, F.lit(8))))
    d = d.withColumn("m2", F.zip_with("g", _shift(F.col("g"), 1), least))
    d = d.withColumn("m4", F.zip_with("m2", _shift(F.col("m2"), 2), least))
    return d.withColumn("mins", F.slice(F.zip_with("m4", _shift(F.col("m2"), 4), least), 1, F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(fp, off, len, text, item_id): each window of each item under the fingerprint that stands for it.

    The fingerprint is the least gram of the window; where equal grams tie, the window stands under each place. An
    item of fewer than WINDOW words is one window under the hash of all of its words.
    """
    b = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    long = _minima(b.where(F.size("w") >= WINDOW)).select("item_id", "w", "g", F.posexplode("mins").alias("p", "m"))
    text = F.array_join(F.slice("w", F.col("p") + 1, WINDOW), " ")
    long = long.select("item_id", F.col("m").bitwiseAND(-8).alias("fp"), text.alias("text"), F.posexplode(F.slice("g", F.col("p") + 1, SPAN)).alias("off", "at"))
    long = long.where(F.col("at").bitwiseAND(-8) == F.col("fp")).select("fp", "off", F.lit(WINDOW).alias("len"), "text", "item_id")
    short = b.where(F.size("w") < WINDOW).withColumn("text", F.array_join("w", " "))
    short = short.select(F.xxhash64("text").alias("fp"), F.lit(0).alias("off"), F.size("w").alias("len"), "text", "item_id")
    return long.unionByName(short).distinct()


def _whole_probes(n: int) -> Column:
    """Probes of every run of n words, for items of n words."""
    run = lambda p: F.array(*[F.get("w", p + k) for k in range(n)])  # noqa: E731  item by item: a slice in a lambda would read the whole array
    places = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda p: F.struct(F.xxhash64(F.array_join(run(p), " ")).alias("fp"), p.alias("pos"), F.lit(n).alias("n"), run(p).alias("near")))


def contaminated_places(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, item_id, start, len) of every benchmark window in documents; null item_id: the row itself.

    Both sides keep the least gram hash of every SPAN neighbouring grams, so equal windows keep an equal gram at an
    equal place; fingerprints are joined and each hit extended to its window, compared word by word.
    """
    tests = benchmark_windows(benchmark)
    lengths = [r[0] for r in tests.where(F.col("len") < WINDOW).select("len").distinct().collect()]  # nine at most
    d = held(docs.select("doc_id", "text"), row=F.monotonically_increasing_id(), w=words(F.col("text"))).select("row", "doc_id", "w")
    d = _minima(d).select("row", "doc_id", "w", "g", "mins")
    d = held(d, n_words=F.size("w"), keep=F.array_distinct(F.transform("mins", lambda m, j: j + F.pmod(m.bitwiseAND(7).cast("int") - j, F.lit(8)))))
    near = lambda p: F.array(*[F.get("w", p + k) for k in range(1 - SPAN, WINDOW)])
    probes = F.transform("keep", lambda p: F.struct(F.get("g", p).bitwiseAND(-8).alias("fp"), p.alias("pos"), F.lit(WINDOW).alias("n"), near(p).alias("near")))
    for n in sorted(lengths):
        probes = F.concat(probes, _whole_probes(n))
    d = d.select("row", "doc_id", "n_words", F.posexplode_outer(probes).alias("i", "probe"))  # no array of the text goes beside its probes
    d = d.select("row", "doc_id", "n_words", "i", F.col("probe.fp").alias("p_fp"), F.col("probe.pos").alias("pos"), F.col("probe.n").alias("n"), F.col("probe.near").alias("near"))
    wide = not small_enough(tests, BROADCAST_WINDOWS)
    itself = F.coalesce("i", F.lit(0)) == 0
    base = F.when(F.col("n") == WINDOW, F.col("pos") - (SPAN - 1)).otherwise(F.col("pos"))
    start = F.col("pos") - F.col("off")
    same = (F.col("p_fp") == F.col("fp")) & (F.col("n") == F.col("len")) & (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    same = same & (F.array_join(F.slice("near", F.greatest(start - base, F.lit(0)) + 1, F.col("len")), " ") == F.col("text"))
    out = ["row", "doc_id", "n_words", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), start.alias("start"), "len"]
    if wide:
        hits = d.join(tests, same).select(*out)
        rows = d.where(itself).select("row", "doc_id", "n_words", F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("len"))
        return hits.unionByName(rows).repartition("row")
    return d.join(F.broadcast(tests), same, "left").where(F.col("len").isNotNull() | itself).select(*out).repartition("row")


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contamination of documents (doc_id, text) by benchmark (item_id, text): one row per input row of docs.

    A window is WINDOW consecutive words of an item (all words of a shorter one). Returns doc_id, n_words, n_hit
    (words inside any window's occurrence), spans (merged [start, end) of hit words) and items (their sorted ids as
    strings). Null and empty texts have no words, hit nothing and are hit by nothing; repeated rows are judged each
    on its own, repeated items count once per id, a null item_id is the id ""; empty tables give no rows or no hits.
    """
    hit = contaminated_places(docs, benchmark)
    row = ["row", "doc_id", "n_words"]
    hit = hit.groupBy(*row, "start", (F.col("start") + F.col("len")).alias("end")).agg(F.collect_set(F.when(F.col("start").isNotNull(), F.col("item_id"))).alias("items"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    hit = hit.withColumn("before", before).withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("before", F.lit(0)))))
    hit = hit.withColumn("span", F.sum(F.when(F.col("before") >= F.col("start"), 0).otherwise(1)).over(Window.partitionBy("row").orderBy("start", "end")))
    span = hit.groupBy(*row, "span").agg(F.sum(F.when(F.col("start").isNotNull(), F.col("fresh"))).alias("fresh"), F.min("start").alias("start"), F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    span = span.groupBy(*row).agg(
        F.coalesce(F.sum("fresh"), F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return span.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", "spans", "items", "row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any word inside a benchmark window, with their own columns; see find_contamination.

    Rows are told apart by doc_id: where several rows share one, all go if any of them is contaminated. A row with
    null doc_id is judged together with the other rows of null doc_id. The texts aren't shuffled where the bad ids can
    be broadcast; an empty table stays empty.
    """
    (name,) = free_names(docs, "bad")
    bad = materialize(find_contamination(docs, benchmark).where("n_hit > 0").select(F.col("doc_id").alias(name)).distinct())
    bad = F.broadcast(bad) if small_enough(bad, BROADCAST_IDS) else bad
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def op2_benchmark_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of find_contamination: one row per document."""
    return find_contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )

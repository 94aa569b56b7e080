"""Operator 11: importance resampling towards a target distribution over hashed word n-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, free_names, materialize, numbered_words, with_fields

#: Words of the longest feature, and buckets of features: what is gathered and broadcast is a number a bucket.
GRAM, BUCKETS = 2, 10_000
#: Documents of fewer words aren't drawn; percent of the others that are; seed of the noise.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Most text bytes whose words are sorted at once.
RUN_BYTES = 4 << 20


def _zeros_after() -> np.ndarray:
    """[n, k, byte]: what byte k of a CRC-32 turns into when n zero bytes follow, for n < 256."""
    poly, step = np.uint32(0xEDB88320), np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ poly, step >> np.uint32(1))
    t = np.empty((256, 4, 256), np.uint32)
    t[0] = np.arange(256, dtype=np.uint32)[None] << np.uint32([0, 8, 16, 24])[:, None]
    for n in range(1, 256):
        t[n] = step[t[n - 1] & 255] ^ (t[n - 1] >> np.uint32(8))
    return t


_ZEROS = _zeros_after()


def join_crc(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of left's bytes followed by right's, size bytes, from the two alone."""
    out, rest = left.astype(np.uint32), size.astype(np.int64)
    while len(rest) and rest.max() > 0:
        n = np.minimum(rest, 255)
        out = _ZEROS[n, 0, out & 255] ^ _ZEROS[n, 1, (out >> 8) & 255] ^ _ZEROS[n, 2, (out >> 16) & 255] ^ _ZEROS[n, 3, out >> 24]
        rest = rest - n
    return out ^ right


def suffix_array(ids: np.ndarray, text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of words ordered by the depth words from there on, words that each shares with the one before it).

    ids: number of each word; text: number of its text. What follows a text's end sorts first and is shared with none.
    """
    n = len(ids)
    keys = []
    for k in range(depth):
        key = np.zeros(n, np.int64)
        inside = text[k:] == text[: n - k]
        key[: n - k][inside] = ids[k:][inside].astype(np.int64) + 1
        keys.append(key)
    wide = int(ids.max(initial=0)) + 2
    if wide**depth < 1 << 62:
        whole = keys[0]
        for key in keys[1:]:
            whole = whole * wide + key
        order = np.argsort(whole)
    else:
        order = np.lexsort(keys[::-1])
    shared, same = np.zeros(n, np.int8), np.ones(max(0, n - 1), bool)
    for key in keys:
        v = key[order]
        same &= (v[1:] == v[:-1]) & (v[1:] > 0)
        shared[1:][same] += 1
    return order, shared


def feature_runs(texts: pa.Array, grams: int = GRAM, buckets: int = BUCKETS, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Runs of texts as (first, last + 1, words of each text, text of each word, features by length).

    Features of a length are (bucket of each distinct one, its run in the suffix array's order as a number a place,
    the places), so each distinct n-gram of a run of texts is hashed once and its bucket scattered to its places.
    """
    for lo, hi, words, ids, ends in numbered_words(texts, ALNUM, run_bytes):
        raw = words.cast(pa.binary()).to_pylist()
        alone = np.fromiter((zlib.crc32(w) for w in raw), np.uint32, len(raw))
        space = zlib.crc32(b" ")
        spaced = np.fromiter((zlib.crc32(w, space) for w in raw), np.uint32, len(raw))
        size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        text = np.repeat(np.arange(hi - lo), np.diff(ends))
        order, shared = suffix_array(ids, text, grams)
        last, out = ends[1:][text] if len(text) else np.zeros(0, np.int64), []
        for k in range(1, grams + 1):
            whole = order + k <= last[order]  # k words are left in the text
            at, new = order[whole], (shared < k)[whole]
            if len(new):
                new[0] = True
            first = at[new]
            crc = alone[ids[first]]
            for j in range(1, k):
                crc = join_crc(crc, spaced[ids[first + j]], size[ids[first + j]])
            out.append((crc % np.uint32(buckets), np.cumsum(new) - 1, at))
        yield lo, hi, np.diff(ends), text, out


def bucket_counts(texts: DataFrame, grams: int = GRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (text) are in each bucket; a row a bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for *_, runs in feature_runs(b.column("text"), grams, buckets, RUN_BYTES):
                for bucket, of, _ in runs:
                    total += np.bincount(bucket, np.bincount(of, minlength=len(bucket)), buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    t = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in t.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # buckets rows at most
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share of the target to that of the source, floored."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(y) + 1) * (s + n) / ((int(x) + 1) * (t + n)))) for x, y in zip(source, target, strict=True)], np.int64)


def importance_weights(docs: DataFrame, gains: np.ndarray, grams: int = GRAM) -> DataFrame:
    """docs with n_words, n_features and weight, the floored mean gain of a text's features (none: 0); no shuffle.

    Null and empty texts have no words; repeated rows are weighed each on its own; columns of these names are replaced.
    """
    new = ["n_words", "n_features", "weight"]
    keep = [c for c in docs.columns if c not in new]
    (name,) = free_names(docs.select(*keep), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, words, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for lo, hi, count, text, runs in feature_runs(b.column(name), grams, len(gains), RUN_BYTES):
                words[lo:hi] = count
                for bucket, of, at in runs:
                    n[lo:hi] += np.bincount(text[at], minlength=hi - lo)
                    score = np.zeros(len(text), np.int64)
                    score[at] = gains[bucket][of]
                    sums = np.append(0, np.cumsum(score))
                    ends = np.append(0, np.cumsum(count))
                    total[lo:hi] += sums[ends[1:]] - sums[ends[:-1]]
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(words), pa.array(n), pa.array(weight)], [*keep, *new])

    schema = with_fields(docs.select(*keep).schema, n_words="long", n_features="long", weight="long")
    return docs.select(*keep, F.col("text").cast("string").alias(name)).mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from seed and id alone; a null id counts as the empty string."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, grams: int = GRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, …) with n_words, n_features, weight, score and rank towards the texts of target (text).

    A text's features are all its runs of 1 to grams words; the share of each feature's bucket in target against that
    in docs gives the weight, Gumbel noise of the id makes the score: taking the highest scores draws without
    replacement in proportion to exp(weight / 1000). percent of the documents of at least least_words words are
    drawn, the highest scores first, ties by id (null first), rank 1, 2, 3 …; others have a null rank. Null and empty
    texts have no features and weigh 0; repeated rows count and are drawn each on its own; an empty target gives all
    buckets but their own counts; empty docs give no rows. Columns of these names are replaced.

    Ranks come from counts: documents per score, whose number is bounded by the range of a logarithm, are summed from
    above, and only rows of one score are put in order among themselves. The noise spreads even equal weights over
    thousands of scores, so no such group holds a fixed share of the rows.
    """
    new = ["n_words", "n_features", "weight", "score", "rank"]
    keep = [c for c in docs.columns if c not in new]
    gains = bucket_gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    text, fit, above, here, drawn = free_names(docs.select(*keep), "t", "fit", "above", "here", "drawn")
    d = importance_weights(docs.select(*keep), gains, grams)
    d = materialize(d.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long")))
    per = d.where(F.col("n_words") >= least_words).groupBy(F.col("score").alias(fit)).agg(F.count("*").alias(here))
    before = F.coalesce(F.sum(here).over(Window.orderBy(F.desc(fit)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(fit, before.alias(above), F.floor(F.sum(here).over(Window.partitionBy()) * percent / 100).alias(drawn))
    per = F.broadcast(per.where(F.col(above) < F.col(drawn)))  # a row a score, at most some hundred thousand
    able = F.when(F.col("n_words") >= least_words, F.col("score"))
    d = d.join(per, able == F.col(fit), "left")
    taken = d.where(F.col(fit).isNotNull())
    order = Window.partitionBy(fit).orderBy(F.asc_nulls_first("doc_id"))
    taken = taken.withColumn("rank", (F.col(above) + F.row_number().over(order)).cast("long"))
    taken = taken.withColumn("rank", F.when(F.col("rank") <= F.col(drawn), F.col("rank")))
    rest = d.where(F.col(fit).isNull()).withColumn("rank", F.lit(None).cast("long"))
    return taken.unionByName(rest).select(*keep, *new)


def op11_importance_resampling(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of resample: one row per document."""
    slim = docs.select("doc_id", "text")
    return resample(slim, benchmark).select("doc_id", "n_features", "weight", "score", "rank")

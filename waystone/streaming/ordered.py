"""Folds over streams whose rows come out of order: a buffer in state, let go in order of time by the watermark."""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.feather as feather
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waystone.operators.folds import Fold

_STATE = "stages array<binary>, waiting binary"
#: Spark's watermark starts at 1970: times are moved by a century, so that earlier ones aren't late. Those before 1870 or
#: after 2160 are no times of a stream (pandas' own range of times ends in 2262).
SHIFT_MS = 36_524 * 86_400_000
LAST_MS = 69_396 * 86_400_000
#: States that keys are dealt to; a stream that goes on from a checkpoint needs the same number.
BUCKETS = 64


def pack(rows: pd.DataFrame) -> bytes:
    """A frame as bytes for state, types kept."""
    out = io.BytesIO()
    feather.write_feather(rows.reset_index(drop=True), out, compression="uncompressed")
    return out.getvalue()


def unpack(held: bytes) -> pd.DataFrame:
    return feather.read_feather(io.BytesIO(bytes(held)))


def _by_key(parts: list[pd.DataFrame], key: str) -> tuple[pd.DataFrame, np.ndarray]:
    """(rows of all parts, a key's rows beside each other in the order they came, where keys begin)."""
    d = pd.concat(parts, ignore_index=True)
    codes = pd.factorize(d[key])[0]
    at = np.argsort(codes, kind="stable")
    return d.take(at), _starts(codes[at])


def _starts(codes: np.ndarray) -> np.ndarray:
    return np.append(np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])


def stream_fold(rows: DataFrame, stages: list[type[Fold]], key: str, order: list[str], late: str, ms: str = "t_ms") -> DataFrame:
    """What the folds, each over what the one before gives, would give over all of a stream's rows in order.

    A row waits in state until the watermark (the latest time seen, less late) passes it; then nothing earlier can come,
    and the folds take it. Rows that come once the batch before theirs has passed their time are dropped and
    counted by Spark (numRowsDroppedByWatermark of the query's progress). When the watermark is a fold's reach past its
    last rows of a key, they are settled and the key's state goes: it holds the rows of the last `late` and a few more. Rows
    without a time or outside 1870 to 2160 are left out, rows without a key only move the watermark. Keys are dealt to
    BUCKETS states, and the folds take all keys of one at once, so a micro-batch costs by its rows, not by its keys. A
    micro-batch's rows of a bucket are in one task: maxFilesPerTrigger or its like bounds them.
    """
    names, schema = rows.columns, rows.schema
    at, part, given = "__at", "__bucket", "__given"
    d = rows.where(F.col(ms).between(-SHIFT_MS, LAST_MS)).withColumn(at, F.timestamp_millis(F.col(ms) + SHIFT_MS)).withWatermark(at, late)
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))

    def run(k: tuple, batches: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        if k[0] < 0:
            for _ in batches:
                pass
            return
        mark = s.getCurrentWatermarkMs() - SHIFT_MS
        held, waiting = s.get if s.exists else ([None] * len(stages), None)
        new = [] if waiting is None else [unpack(waiting)]
        new += [] if s.hasTimedOut else [b[names] for b in batches]
        flow, waiting = [], None
        if new:
            new = pd.concat(new, ignore_index=True)
            due = (new[ms] <= mark).to_numpy()
            flow, waiting = [new[due].sort_values(order, kind="stable").assign(**{given: False})], new[~due]
            new = None
        timers = [int(waiting[ms].min())] if waiting is not None and len(waiting) else []
        open_before, states = set(), []
        for fold, h in zip(stages, held, strict=True):
            parts = [x for x in (*([] if h is None else [unpack(h)]), *flow) if len(x)]
            flow, state = [], None
            if parts:
                d, first = _by_key(parts, key)
                kept, hold = fold.settle(d, first)
                was = d[given].to_numpy(bool)
                flow = [d[kept & ~was].assign(**{given: False})]
                state = d[hold].assign(**{given: (kept | was)[hold]})
                first = _starts((np.cumsum(first) - 1)[hold])
                last = state[ms].to_numpy()[np.append(first[1:], True)].astype(np.int64) + fold.reach
                done = (last <= mark)[np.cumsum(first) - 1] & ~state[key].isin(open_before).to_numpy()
                if done.any():
                    e = state[done]
                    flow.append(e[fold.finish(e, first[done]) & ~e[given].to_numpy(bool)].assign(**{given: False}))
                    state, last = state[~done], last[~done[first]]
                open_before |= set(state[key])
                timers += [int(last.min())] if len(last) else []
            states.append(pack(state) if state is not None and len(state) else None)
        yield from (x[names] for x in flow if len(x))
        if timers:
            s.update((states, pack(waiting) if waiting is not None and len(waiting) else None))
            s.setTimeoutTimestamp(max(mark, min(timers)) + SHIFT_MS)
        elif s.exists:
            s.remove()

    return d.withColumn(part, bucket).groupBy(part).applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replay(rows: DataFrame, folder: str, reach: int, ms: str = "t_ms", part_rows: int = 500_000) -> tuple[DataFrame, str]:
    """rows as a stream and how late its rows may be: a table written into a folder part by part, in order of time.

    The parts are equal spans of time, at least two, of about part_rows rows where times are even; each comes as micro-
    batches of a file. A row without a key, more than the folds' reach and the lateness after all others, ends it.
    """
    low, high, n = rows.agg(F.min(ms), F.max(ms), F.count("*")).first()
    low, high = (0, 0) if low is None else (low, high)
    parts = max(2, math.ceil(n / part_rows))
    span = (high - low) // parts + 1
    whole = f"{folder.rstrip('/')}/replay-{uuid.uuid4().hex}"
    no = F.floor((F.col(ms) - low) / span).cast("int")
    rows.withColumn("__part", no).repartition(no).write.partitionBy("__part").parquet(f"{whole}/all")
    spark = rows.sparkSession
    schema = T.StructType([*rows.schema.fields, T.StructField("__part", T.IntegerType())])
    for k in range(parts):
        part = spark.read.schema(schema).parquet(f"{whole}/all").where(F.col("__part") == k)
        part.drop("__part").write.mode("append").parquet(f"{whole}/in")
    last = spark.range(1).select(*[F.lit(high + 2 * span + reach + 1 if c == ms else None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    last.write.mode("append").parquet(f"{whole}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{whole}/in"), f"{2 * span} milliseconds"


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All that a finite stream gives, written to the shared folder and reread."""
    out = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start(f"{out}/rows")
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")

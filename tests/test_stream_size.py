"""Streams cost by their rows: not by their keys, and not by all that a table holds."""

import inspect
import random

import numpy as np
import pandas as pd
import pytest

from tests.test_streams import HOUR, RAW, files, noisy
from waystone.operators.clean import _Excursions, _Spikes, _Stationary
from waystone.sources import exports
from waystone.streaming import ordered, reconciled, sessions


@pytest.mark.parametrize(("fold", "step", "jump"), [(_Spikes, 240_000, 1.0), (_Stationary, 120_000, 1.0), (_Excursions, HOUR, 30.0)])
def test_folds_settle_many_keys_at_once(fold, step, jump):
    """Pieces of many keys' rows, what is held going before the next piece, give what a key's rows give in one piece."""
    rng = random.Random(3)
    rows = pd.DataFrame([(20 * j + r[0], *r[1:]) for j in range(30) for r in noisy(rng, rng.randint(1, 60), step, jump)], columns=[c.split()[0] for c in RAW.split(", ")])

    def walk(pieces):
        out, held = [], rows[:0].assign(was=False)
        for p in pieces:
            d, first = ordered._by_key([held, p.assign(was=False)], "traveler_id")
            kept, hold = fold.settle(d, first)
            out.append(d[kept & ~d["was"].to_numpy(bool)])
            held = d[hold].assign(was=(kept | d["was"].to_numpy(bool))[hold])
        e = held[fold.finish(held, ordered._starts(held["traveler_id"].to_numpy())) & ~held["was"].to_numpy(bool)]
        return sorted(zip(*(pd.concat([*out, e])[c] for c in ("traveler_id", "seq")), strict=True))

    at = rows.groupby("traveler_id").cumcount()
    want = [walk([g]) for _, g in rows.groupby("traveler_id")]
    got = walk([rows[at < 7], rows[(at >= 7) & (at < 8)], rows[(at >= 8) & (at < 30)], rows[at >= 30]])
    assert got == sorted(x for w in want for x in w) and len(got) < len(rows)


def test_spikes_and_stationary_settle_as_they_feed():
    rng = random.Random(4)
    for fold, step in ((_Spikes, 240_000), (_Stationary, 120_000)):
        rows = pd.DataFrame([r for r in noisy(rng, 400, step, 1.0) if r[0] == 1], columns=[c.split()[0] for c in RAW.split(", ")])
        one = fold()
        want = pd.concat([*one.feed(rows), *one.end()])["seq"].tolist()
        first = np.arange(len(rows)) == 0
        kept, hold = fold.settle(rows, first)
        e = rows[hold]
        last = e[fold.finish(e, np.arange(len(e)) == 0) & ~kept[hold]]
        assert rows[kept]["seq"].tolist() + last["seq"].tolist() == want


def test_many_keys_share_few_states(spark, tmp_path):
    rows = [(k, i, HOUR + i * 1000, 37.0 + i, 127.0, 5.0) for k in range(300) for i in range(2)]
    stream = files(spark, str(tmp_path / "in"), [rows, [(None, 0, 2 * HOUR, 0.0, 0.0, 0.0)]], RAW)
    q = sessions.stream_clean_raw(stream).writeStream.format("memory").queryName("few_states").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    assert 0 < max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) <= ordered.BUCKETS


def test_a_replayed_batch_is_bounded():
    assert inspect.signature(ordered.replay).parameters["part_rows"].default <= 500_000


def test_many_histories_share_few_states(spark, tmp_path):
    seg = '{"startTime":"2024-01-0%dT00:00:00Z","endTime":"2024-01-0%dT00:10:00Z","visit":{"topCandidate":{"placeLocation":"3,%d"}}}'
    batches = [[(f"h{k}", i, seg % (i + 1, i + 1, k % 90)) for k in range(reconciled.GROUPS * 3)] for i in range(2)]
    stream = files(spark, str(tmp_path / "in"), batches, "source string, idx long, text string")
    changes = reconciled.stream_reconciled(exports.flatten_segments(exports.parse_elements(stream)))
    q = changes.writeStream.format("memory").queryName("few_histories").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    assert 0 < max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) <= reconciled.GROUPS
    assert reconciled.settled(spark.table("few_histories")).select("source").distinct().count() == reconciled.GROUPS * 3
    assert spark.table("few_histories").count() == reconciled.GROUPS * 6

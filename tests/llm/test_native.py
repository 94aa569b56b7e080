"""Operators 1, 2 and 4 against plain Python."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from brute import op1, op2, op4_targets
from pyspark.sql import functions as F

from waystone.llm import decontaminate
from waystone.llm.decontaminate import drop_contaminated, op2_benchmark_decontamination
from waystone.llm.licenses import op1_license_scans
from waystone.llm.mixing import fair_queue, mix_sources, op4_mix_sources

DOC = "doc_id long, text string, lang string, source string, n_chars long, row int, score string, w int"
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "MIT License, mit  license! General Public Public License", "en", "a"),
    (3, "MIT License, mit  license! General Public Public License", "en", "a"), (4, "License", "en", "b"), (5, "É É é" * 9, "fr", None),
    (6, "this work is licensed under the gnu general public license version 3 and so on", "en", "b"), (None, "x mit license", "en", "c"),
    (7, "word " * 30000 + "Apache-License", "en", "c"),
]


def odd(spark):
    return spark.createDataFrame([(i, t, l, s, 0, 1, "x", 2) for i, t, l, s in ODD], DOC)


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.mark.parametrize("which", ["odd", "table"])
def test_op1_matches_plain_search(spark, sf_dir, which):
    docs = odd(spark) if which == "odd" else read(spark, sf_dir, "documents")
    want = Counter((r.doc_id, *op1(r.text)) for r in docs.collect())
    rows = op1_license_scans(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)


def test_op1_adds_labels_by_diagonals(spark):
    text = "foo permission is hereby granted free of charge to any other person obtaining a copy of this software and its documentation files the software to deal in the software without restriction bar"
    row = op1_license_scans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == "mit-text" and row.base_labels == "" and 0.6 <= row.score < 1


def test_op1_empty_table(spark):
    assert op1_license_scans(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_op2_matches_plain_windows(spark, sf_dir, wide, monkeypatch):
    if wide:
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    texts = [r.text for r in items.orderBy("item_id").limit(3).collect()]
    more = [(10**6, texts[0].upper()), (10**6 + 1, " ".join(texts[1].split()[2:12])), (10**6 + 2, " ".join(texts[1].split()[2:11])), (10**6 + 3, None), (10**6 + 4, "a b a b a b a b a b a b a b")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    items = items.select("item_id", "text").union(spark.createDataFrame([(900, "short item"), (901, ""), (902, None), (903, "a b a b a b a b a b a b"), (904, "of")], "item_id long, text string"))
    want = Counter(op2([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()]))
    rows = op2_benchmark_decontamination(docs, items).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in rows) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in rows)


def test_op2_edges(spark):
    docs, none = odd(spark), spark.createDataFrame([], "item_id long, text string")
    assert not any(r.n_hit for r in op2_benchmark_decontamination(docs, none).collect())
    assert op2_benchmark_decontamination(docs.limit(0), none).count() == 0
    item = spark.createDataFrame([(1, "word " * 12)], "item_id long, text string")
    kept = drop_contaminated(docs, item)
    assert kept.columns == docs.columns and kept.count() == len(ODD) - 1


def test_op2_takes_time_in_proportion_to_a_text(spark):
    import random
    import time

    r = random.Random(5)
    item = " ".join(str(r.randrange(10**6)) for _ in range(30))
    items, took = spark.createDataFrame([(1, item), (2, "three words only")], "item_id long, text string"), []
    for n in (10, 150_000, 600_000):
        text = " ".join([str(r.randrange(10**6)) for _ in range(n)] + [item, "three words only"])
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        (row,) = op2_benchmark_decontamination(docs, items).collect()
        took.append(time.time() - began)
        assert (row.n_words, row.n_hit, row.n_items) == (n + 33, 33, 2)
    assert took[2] < 8 * took[1] + 10  # sixteen times as long, were it to grow with the square


@pytest.mark.parametrize("which", ["odd", "table"])
def test_op4_targets_and_taken(spark, sf_dir, which):
    docs = odd(spark) if which == "odd" else read(spark, sf_dir, "documents")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, by = Counter(), Counter()
    for r in docs.collect():
        want[r.doc_id, size(r.text)] += 1
        by[r.source] += size(r.text)
    rows = op4_mix_sources(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == want
    targets, taken, most = op4_targets(dict(by)), Counter(), Counter()
    for r in rows:
        assert r.source_size == by[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
    for s, t in targets.items():
        assert t - 2 * max(most.values()) <= taken[s] <= t + most[s]
    assert sum(taken.values()) <= sum(by.values())
    assert sorted(map(str, rows)) == sorted(map(str, op4_mix_sources(docs.repartition(3)).collect()))


def test_op4_edges(spark):
    docs = odd(spark)
    assert op4_mix_sources(docs.limit(0)).count() == 0
    assert all(r.taken == 0 for r in op4_mix_sources(docs.where(F.col("text").isNull())).collect())
    assert mix_sources(docs).columns == [*docs.columns, "copy_no"]


MIXED = st.lists(st.tuples(st.sampled_from([None, 1, 2, 3]), st.sampled_from([None, "", "a", "a b", "a b c d e", "c " * 9]), st.sampled_from([None, "x", "y"])), max_size=40)


@settings(max_examples=5, deadline=None)
@given(MIXED)
def test_op4_repeated_ids_stay_within_the_budget(spark, rows):
    docs = spark.createDataFrame([(i, t, s, "z", 7, "r", 1, 2) for i, t, s in rows], "doc_id long, text string, source string, copy_no string, c_source int, row string, key int, top int")
    queue, taken = Counter(), Counter()
    for r in fair_queue(docs).collect():
        queue[r.doc_id, r.source, r["size"]] += len(r.copies)
    mixed = mix_sources(docs)
    assert dict(mixed.dtypes) == dict(docs.dtypes) | {"copy_no": "int"} and mixed.columns[-1] == "copy_no"
    for r in mixed.collect():
        taken[r.doc_id, r.source, len(r.text.split())] += 1
    assert +taken == +queue and sum(k[2] * n for k, n in taken.items()) <= sum(len((t or "").split()) for _, t, _ in rows)

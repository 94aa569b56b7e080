"""Operators 11 and 13 against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waystone.llm import fim, resample as rs
from waystone.llm.fim import Rewrite, fill_in_middle, op13_fill_in_middle, restored
from waystone.llm.resample import feature_runs, join_crc, op11_importance_resampling, resample, suffix_array

ODD = [
    (1, None, "a"), (2, "", "a"), (3, "Ab ab AB\nab, É é ab", "b"), (3, "Ab ab AB\nab, É é ab", "b"), (4, "one", None), (None, "x y\n" * 30, "c"),
    (5, "word word\n\n" * 30_000, "c"), (6, "a <P> b\nc", "c"), (7, "\n", "c"), (8, "no end\nof line", "c"), (9, "k" * 300 + " " + "m" * 700 + " end " * 20, "c"), (10, "ß€😀\n" * 9, "c"),
]


def odd(spark):
    return spark.createDataFrame([(i, t, s, 7, "r", 0.5) for i, t, s in ODD], "doc_id long, text string, source string, rank int, fim_text string, __text double")


def draws(i, seed=7):
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2) for i in range(len(w) - k + 1)]


def plain_resample(docs, items):
    of = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in of for b in f), Counter(b for x in items for b in plain_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    rows = []
    for i, w, f in of:
        weight = sum(map(gain, f)) // len(f) if f else 0
        rows.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((draws(i)[0] + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: 25 * len(fit) // 100])}
    return Counter((r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in rows)


@pytest.mark.parametrize("run_bytes", [1, 4 << 20])
def test_op11_matches_plain_resampling(spark, sf_dir, run_bytes, monkeypatch):
    monkeypatch.setattr(rs, "RUN_BYTES", run_bytes)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = plain_resample([tuple(r) for r in docs.collect()], [r.text for r in items.collect()])
    assert Counter(map(tuple, op11_importance_resampling(docs, items).collect())) == want
    assert any(r[4] for r in want) and sum(r[4] is None for r in want) > 1


def test_op11_edges(spark):
    docs, none = odd(spark), spark.createDataFrame([], "item_id long, text string")
    assert resample(docs.limit(0), none).count() == 0
    out = resample(docs, none, percent=100, least_words=0)
    assert [c for c in out.columns if c not in ("n_words", "n_features", "weight", "score", "rank")] == [c for c in docs.columns if c != "rank"]
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, len(ODD) + 1))
    assert all(r["rank"] is None for r in resample(docs, none, percent=0).collect())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=5), st.binary(max_size=30))
def test_crcs_join(parts, tail):
    left = np.array([zlib.crc32(p) for p in parts], np.uint32)
    got = join_crc(left, np.full(len(parts), zlib.crc32(tail), np.uint32), np.full(len(parts), len(tail)))
    assert got.tolist() == [zlib.crc32(p + tail) for p in parts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=9), min_size=1, max_size=6), st.integers(1, 4))
def test_suffix_arrays_give_shared_words(texts, depth):
    ids, text = np.array(sum(texts, []), np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    order, shared = suffix_array(ids, text, depth)
    after = [t[i : i + depth] for t in texts for i in range(len(t))]
    inside = [after[p] for p in order]
    assert inside == sorted(after)
    for k in range(1, len(inside)):
        a, b = inside[k - 1], inside[k]
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[k] == same


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab É.\n", max_size=20)), max_size=6), st.integers(1, 3))
def test_features_are_all_runs_of_words(texts, grams):
    got = Counter()
    for lo, _, _, text, runs in feature_runs(pa.array(texts, pa.string()), grams, 97):
        for bucket, of, at in runs:
            got.update((int(lo + text[p]), int(bucket[r])) for p, r in zip(at, of, strict=True))
    want = Counter()
    for i, t in enumerate(texts):
        w = plain_features(t)[0]
        want.update((i, zlib.crc32(" ".join(w[p : p + k]).encode()) % 97) for k in range(1, grams + 1) for p in range(len(w) - k + 1))
    assert got == want


def plain_fim(i, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b, _, d = draws(i)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    return n, *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < 50 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def test_op13_matches_lists_of_lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for i, t in docs.collect():
        n, form, p, m, out = plain_fim(i, t or "")
        want[i, n, form, p, m, sha(out), sha(t or "")] += 1
    rows = op13_fill_in_middle(docs).collect()
    assert Counter(map(tuple, rows)) == want and {r.form for r in rows} == {"plain", "psm", "spm"}


@settings(max_examples=80, deadline=None)
@given(st.integers(), st.text("ab <P>SM\n\r", max_size=40), st.sampled_from([r"[^\n]*\n|[^\n]+", r"(?s:.)", r"\s*\S+|\s+"]), st.integers(0, 100))
def test_texts_come_back(i, text, unit, rate):
    how = Rewrite(unit=unit, rate=rate)
    n, form, p, m, s, out = how.apply(i, text)
    assert n == len(re.findall(unit, text))
    if form == "plain":
        assert out == text
    else:
        assert p + m + s == text and re.split("<P>|<S>|<M>", out) == (["", p, s, m] if form == "psm" else ["", s, p, m])


def test_fim_keeps_columns_and_gives_texts_back(spark):
    docs = odd(spark)
    out = fill_in_middle(docs, Rewrite(unit=r"\s*\S+|\s+", marks=("⟨p⟩", "⟨s⟩", "⟨m⟩"), seed=3)).withColumn("again", restored(fim.F.col("fim_text"), fim.F.col("fim_form"), ("⟨p⟩", "⟨s⟩", "⟨m⟩")))
    assert out.columns[:5] == ["doc_id", "text", "source", "rank", "__text"]
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r.again == (r.text or "") for r in rows)
    assert all(r.prefix_chars + r.middle_chars + r.suffix_chars == len(r.text) for r in rows if r.fim_form != "plain")
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_marks_that_could_run_into_each_other_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "P", "<M>"), ("ab", "bc", "x")):
        with pytest.raises(ValueError):
            Rewrite(marks=marks)


def test_matcher_holds_no_units():
    import tracemalloc

    text = "ab\n" * 400_000
    tracemalloc.start()
    Rewrite().apply(5, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(text)  # the output and its parts; a list of 400,000 lines would take over 20 MB

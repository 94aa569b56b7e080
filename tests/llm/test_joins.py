"""Operators 6, 7 and 9 and the pipeline against plain Python."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import jaccard_components as plain_components
from pyspark.sql import functions as F

import corpus_pipeline
from waystone.llm import chat, embeddings, ngram_join
from waystone.llm.common import connected_components
from waystone.llm.embeddings import epsilon_join, op9_embedding_near_dedup
from waystone.llm.ngram_join import jaccard_components, keep_one_of_each, op7_ngram_jaccard_join


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


TURNS = [
    (10**6, 0, "us<|er", "a <| b <\\| c <\\\\|end|>\n <|end|>\n"), (10**6, 1, "assistant", "<|turn|>x<|"), (10**6, 2, None, None), (10**6, 2, None, None),
    (None, 0, "assistant", "é" * 70000), (None, None, "user", "<"), (10**6 + 1, 1, "assistant", ""), (10**6 + 1, 0, "system", "|><|body|>"),
]


@pytest.mark.parametrize("piece", [1 << 20, 300])
def test_op6_reads_back_what_it_wrote(spark, sf_dir, piece, monkeypatch):
    monkeypatch.setattr(chat.format_chat, "__defaults__", (piece,))
    c = read(spark, sf_dir, "conversations").unionByName(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))
    want = defaultdict(list)
    extra = [(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))]
    for k, _, r, t in sorted([*map(tuple, c.collect()), *extra], key=lambda r: (r[0] is None, r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[k].append((r or "", t or ""))
    got = {r.conv_id: r for r in chat.op6_chat_formatting(c).collect()}
    assert set(got) == set(want)
    for k, turns in want.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said))
    sizes = chat.format_chat(c).groupBy("conv_id").agg(F.sum(F.char_length("formatted")).alias("n"), F.count("*").alias("pieces")).collect()
    assert all(got[r.conv_id].formatted_chars == r.n for r in sizes) and (piece > 300 or max(r.pieces for r in sizes) > 1)


def test_op6_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, piece int, formatted int, loss string")
    assert chat.format_chat(none).columns == ["conv_id", "piece", "formatted", "loss"]
    assert [r.conv_id for r in chat.op6_chat_formatting(none).collect()] == [-7] and chat.format_chat(none).count() == 0


def variants(spark):
    """Texts around the threshold: chains of edits, copies, a hot group, short and empty texts, repeated ids."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    rows, text = [], base
    for i in range(60):
        text = list(text if i % 2 else base)
        for j in rng.integers(0, 120, int(rng.integers(0, 7))):
            text[j] = f"x{i}{j}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(base)) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "one two"), (203, "ONE  two"), (204, "one two three"), (205, "a b c d"), (206, "a b c d e"), (207, " \n "), (208, "a b c d")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize(("k", "similar"), [(4, (85, 100)), (5, (4, 5)), (1, (1, 2))])
def test_op7_matches_all_pairs(spark, sf_dir, k, similar):
    docs, rows = variants(spark)
    table = read(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text")
    docs = docs.union(table)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, k, similar).collect()}
    assert got == plain_components([*rows, *map(tuple, table.collect())], k, *similar)


@pytest.mark.parametrize("rows", [0, 500_000])
def test_op7_common_shingles_groups_and_shuffled_texts(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(ngram_join, "GROUP", 7)
    monkeypatch.setattr(ngram_join, "HOT", 20 if rows else 8192)
    monkeypatch.setattr(ngram_join, "GATHER", 500 if rows else 1 << 16)
    rng = np.random.default_rng(5)
    common = " ".join(f"c{i}" for i in range(40))
    texts = [(i, common + " " + " ".join(f"u{x}" for x in rng.integers(0, 10**6, int(rng.integers(0, 60))))) for i in range(150)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op7_ngram_jaccard_join(docs).collect()}
    assert got == plain_components(texts, 4, 85, 100)


def test_op7_edges(spark):
    t = "a b c d e f g h"
    docs = spark.createDataFrame([(1, t, 0), (1, t, 0), (None, t, 0), (3, t, 0), (4, None, 0)], "doc_id long, text string, n int")
    assert Counter(map(tuple, op7_ngram_jaccard_join(docs).collect())) == Counter([(1, 5, 1), (1, 5, 1), (None, 5, None), (3, 5, 1), (4, 0, 4)])
    assert op7_ngram_jaccard_join(docs.limit(0)).count() == 0
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 1, None, 4])


def plain_links(rows, cosine=0.98):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    parent, n, groups = {r[0]: r[0] for r in rows}, Counter(), defaultdict(list)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for r in ok:
        groups[r[2], len(r[1])].append(r)
    for g in groups.values():
        x = np.array([r[1] for r in g], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for i, j in zip(*np.nonzero(x @ x.T >= cosine), strict=True):
            if i != j:
                n[g[i][0]] += 1
                a, b = find(g[i][0]), find(g[j][0])
                parent[max(a, b)] = min(a, b)
    return {r[0]: (n[r[0]], find(r[0]), find(r[0]) == r[0]) for r in rows}


def vectors(spark, sf_dir):
    inf = float("inf")
    odd = [[0.0] * 64, None, [inf] * 64, [1.0, None], [1.0, 2.0], [2.0, 4.0], [], [float("nan")] * 64]
    rng = np.random.default_rng(2)
    c = rng.normal(size=64)
    near = [(c + rng.normal(size=64) * s).tolist() for s in rng.uniform(0.05, 0.3, 80)]
    more = [(10**6 + i, v, 1) for i, v in enumerate([*odd, *near, *near[:30], *[near[0]] * 40])] + [(2 * 10**6, near[0], None)]
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return e.unionByName(spark.createDataFrame(more, "vec_id long, embedding array<float>, label int"))


@pytest.mark.parametrize(("rows", "fan"), [(256, 16), (6, 2)])
def test_op9_matches_all_pairs(spark, sf_dir, rows, fan, monkeypatch):
    e = vectors(spark, sf_dir)
    monkeypatch.setattr(embeddings.near_intervals, "__defaults__", (fan,))
    monkeypatch.setattr(embeddings.near_blocks, "__defaults__", (fan,))
    got = {r.vec_id: (r.n_links, r.component_id, r.vec_id == r.component_id) for r in epsilon_join(e, block_rows=rows).collect()}
    assert got == plain_links([tuple(r) for r in e.collect()])


def test_op9_edges(spark):
    kind = "vec_id long, embedding array<float>, label int, k1 int, grp string"
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1)]
    e = spark.createDataFrame([(*r, 1, "g") for r in rows], kind)
    got = Counter(map(tuple, op9_embedding_near_dedup(e).collect()))
    assert got == Counter([(1, 2, 1, True), (1, 2, 1, True), (None, 0, None, False), (2, 2, 1, False), (3, 0, 3, True)])
    assert op9_embedding_near_dedup(e.limit(0)).count() == 0
    assert op9_embedding_near_dedup(e.where("vec_id IS NULL")).count() == 1


def test_op9_one_id_under_two_labels_and_long_vectors(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (1, [1.0, 0.0], 2), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], 2), (1, [0.0, 1.0], 2)], "vec_id long, embedding array<float>, label int")
    got = Counter(map(tuple, op9_embedding_near_dedup(e).collect()))
    assert got == Counter([(1, 1, 1, True), (2, 1, 1, False), (1, 2, 1, True), (3, 2, 1, False), (4, 2, 1, False), (1, 0, 1, True)])
    rng = np.random.default_rng(9)
    base = rng.normal(size=5000)
    rows = [(i, (base + rng.normal(size=5000) * (0.1 if i % 2 else 9)).tolist(), 1) for i in range(40)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {r.vec_id: (r.n_links, r.component_id, r.vec_id == r.component_id) for r in epsilon_join(e).collect()} == plain_links([tuple(r) for r in e.collect()])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 100), (7, 7), (None, 3), (60, 61), (61, 62)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, 60: 60, 61: 60, 62: 60}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pipeline(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources"]
    step = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, step, sf_dir)
        assert out.dtypes == docs.dtypes, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in step.select("doc_id").collect()}
        step = corpus_pipeline.materialize(out)
    kept = {r.doc_id: r.text for r in step.collect()}
    labels = {r.doc_id: r.quality for r in read(spark, sf_dir, "labels").collect()}
    bad = [i for i in kept if labels.get(i) == 0]
    assert len(bad) <= 2 and 0 < len(kept) < docs.count()
    mixed = corpus_pipeline.run(spark, sf_dir).collect()
    assert mixed and {r.doc_id for r in mixed} <= set(kept) and all(r.text == kept[r.doc_id] for r in mixed)
    assert Counter((r.doc_id, r.copy_no) for r in mixed).most_common(1)[0][1] == 1


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "some text of its own", "en", "b", 3), (3, "token=abcdefgh " + "word " * 40000, None, None, 5)]
    docs = spark.createDataFrame(rows, kind)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), sf_dir).count() == 0, name
        assert f(spark, docs, sf_dir).count() <= 3 * len(rows), name

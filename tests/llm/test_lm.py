"""Operator 12: gradients, windows and counts against plain Python, held-out scores against the base."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from waystone.llm import lm
from waystone.llm.common import NO_SPACE, numbered_words
from waystone.llm.lm import Attention, Subwords, op12_lm_scoring, score_documents, score_texts, train_language_model

ODD = [
    (1, None, "a"), (2, "", "b"), (3, " A a b ", "c"), (3, " A a b ", "c"), (None, "the the of", "d"), (4, "x" * 100_000, "e"), (6, "né " * 3_000 + "é é \u0000\u001f", "f"), (11, "<|endoftext|>", "g"), (12, "日本語のテキスト", "g"),
]


def odd(spark):
    return spark.createDataFrame([(i, t, s, 1.5, "r", 3) for i, t, s in ODD], "doc_id long, text string, n_known string, score double, __row string, word int")


def model(vocabulary=300, seed=1):
    rng = np.random.default_rng(seed)
    m = Attention.fresh(vocabulary, rng.integers(0, 50, vocabulary))
    m.matrix[:] = rng.normal(0, 0.3, m.matrix.shape)
    return m


def plain_log_probability(m, ids, target):
    """Of target after ids, one number at a time."""
    p = {k: v.astype(float) for k, v in m.parts().items()}
    x = [p["embed"][i] + p["place"][k] for k, i in enumerate(ids)]
    q = x[-1] @ p["query"] / 4
    a = [math.exp(q @ (e @ p["key"])) for e in x]
    z = x[-1] + sum(w * (e @ p["value"]) for w, e in zip(a, x, strict=True)) / sum(a) @ p["mix"]
    total, before = 0.0, 0
    for k in range(4):
        logits = p["digit"][16 * k : 16 * k + 16] @ z + m.tables[k][before]
        own = target >> 4 * (3 - k) & 15
        total += logits[own] - math.log(sum(math.exp(v) for v in logits))
        before = 16 * before + own
    return total


def test_windows_score_each_id_once_after_its_context():
    m, rng = model(), np.random.default_rng(2)
    sizes = [1, 2, 31, 32, 33, 60, 61, 100]
    ids, off = rng.integers(0, 299, sum(sizes)), np.append(0, np.cumsum(sizes))
    ids[off[1:] - 1] = 299
    got = score_texts(m, ids, off, 299)
    for i in range(len(sizes)):
        text = ids[off[i] : off[i + 1]]
        seen, want = np.append(299, text[:-1]), 0.0
        for k in range(len(text)):
            first = 0 if k < 32 else (k - 32) // 28 * 28 + 28
            want += plain_log_probability(m, seen[first : k + 1], text[k])
        assert got[i] == pytest.approx(want, rel=1e-4)


def test_probabilities_sum_to_one_and_survive_large_parameters():
    m = model()
    own = np.ones((256, 1), bool)
    for scale in (1, 300):
        m.matrix *= scale
        lp = np.concatenate([m.log_probabilities(np.full((256, 1), 5), np.arange(a, a + 256)[:, None], own) for a in range(0, 65536, 256)])
        assert np.isfinite(lp).all() and np.exp(lp).sum() == pytest.approx(1, abs=1e-3)


def test_gradients_match_differences():
    m = model()
    rng = np.random.default_rng(3)
    ids, targets = rng.integers(0, 300, (2, 7)), rng.integers(0, 300, (2, 7))
    targets[1, 4:] = -1
    loss, rows, dx, g = m.gradient(ids, targets)
    live = targets >= 0
    assert loss == pytest.approx(-m.log_probabilities(ids, np.maximum(targets, 0), live).sum() / live.sum(), rel=1e-4)
    at = Attention.rows(300)
    full = np.zeros_like(m.matrix)
    full[rows] = dx
    for k, d in g.items():
        full[at[k]] = d
    for _ in range(60):
        i, j = rng.choice(np.append(rows, np.arange(300, len(full)))), rng.integers(16)
        ends = []
        for step in (-1e-2, 2e-2):
            m.matrix[i, j] += step
            ends.append(m.gradient(ids, targets)[0])
        m.matrix[i, j] -= 1e-2
        assert (ends[1] - ends[0]) / 2e-2 == pytest.approx(full[i, j], abs=2e-3)


def test_subwords_of_words_are_those_of_each_alone():
    s = Subwords()
    words = ["a", "naïve", "x" * 50, "日本", "a b", " ", "don't!!", "<|endoftext|>", "\u0000"]
    ids, off = s.encode(pa.array(words))
    assert len(off) == len(words) + 1
    for i, w in enumerate(words):
        assert s._encoding.decode_bytes(ids[off[i] : off[i + 1]].tolist()) == (" " + w).encode()
        assert ids[off[i] : off[i + 1]].tolist() == s.encode(pa.array([w]))[0].tolist()


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def plain_base(docs):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    c = Counter()
    for i, t in docs:
        if not held_out(i):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in docs:
        w = [*words(t), None]
        out.append((i, held_out(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)))
    return Counter(out)


@pytest.mark.parametrize("head,run_bytes", [(1 << 18, 4 << 20), (5, 1)])
def test_op12_counts_match_plain_counts(spark, sf_dir, head, run_bytes, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "RUN_BYTES", run_bytes)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    rows = op12_lm_scoring(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == plain_base([tuple(r) for r in docs.collect()])
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_learning_helps_and_reruns_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sums = []
    for rounds in (0, 2, 2):
        m = train_language_model(docs, rounds=rounds, every=1)
        sums.append(score_documents(docs.select("doc_id", "text"), m).where("crc32(cast(cast(doc_id AS string) AS binary)) % 7 = 2").groupBy().sum("score").first()[0])
    assert 0.93 * sums[0] < sums[1] and sums[1] == pytest.approx(sums[2], rel=1e-6)  # both below 0; unseen texts gain 7 % over shares alone


def test_op12_edges(spark):
    docs = odd(spark)
    assert op12_lm_scoring(docs.limit(0)).count() == 0
    m = train_language_model(docs.limit(0))
    out = score_documents(docs, m)
    assert out.columns == ["doc_id", "__row", "word", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in rows)


def test_every_id_of_every_text_is_learnt_once(spark):
    sub = Subwords()
    texts = [None, "", "a", " ".join(f"word{i}" for i in range(500)), "x1y2z3" * 200 + " end", "日本 " * 100]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    spans = [np.frombuffer(r.ids, "<u2").tolist() for r in lm.training_spans(docs, sub).collect()]
    got = [i for s in spans for i in s[1:]]
    assert got == [i for t in texts for i in [*sub.encode(pa.array((t or "").split()))[0].tolist(), sub.end]]
    assert all(1 < len(s) <= lm.CONTEXT + 1 for s in spans) and [s[0] for s in spans[1:]] == [s[-1] for s in spans[:-1]] and spans[0][0] == sub.end
    some = lm.training_spans(docs, sub, 4).count()
    assert len(texts) <= some < len(spans) / 2


def test_words_that_tasks_know_are_not_encoded_again(monkeypatch):
    sub = Subwords()
    texts = pa.array(["The cat  sat", None, "", "naïve cat 日本\tsat sat", "unknown_word the"])
    runs = list(numbered_words(texts, NO_SPACE, 1 << 20))
    known = lm.CommonWords(pa.array(["sat", "the", "日本", "naïve", "absent"]), np.array([5, 4, 3, 2, 1]), sub)
    plain = lm.CommonWords(pa.array([], pa.string()), np.zeros(0, np.int64), sub)
    want = [plain.text_ids(d, no, ends) for _, _, d, no, ends in runs]
    asked, encode = [], Subwords.encode
    monkeypatch.setattr(Subwords, "encode", lambda self, words: asked.extend(words.to_pylist()) or encode(self, words))
    for (_, _, d, no, ends), (ids, texts_at, _) in zip(runs, want, strict=True):
        got = known.text_ids(d, no, ends)
        assert got[0].tolist() == ids.tolist() and got[1].tolist() == texts_at.tolist()
        assert [known.words[i].as_py() for i in got[2] if i >= 0] == [w for w in d.to_pylist() if w in known.words.to_pylist()]
    assert sorted(asked) == ["cat", "unknown_word"]
    ids = [i for t in texts.to_pylist() for i in [*encode(sub, pa.array((t or "").replace("T", "t").split()))[0].tolist(), sub.end]]
    assert [i for w in want for i in w[0].tolist()] == ids


def test_careful_gradients_are_the_same_and_large_parameters_leave_them_finite():
    m, rng = model(), np.random.default_rng(5)
    ids, targets = rng.integers(0, 300, (3, 32)), rng.integers(-1, 300, (3, 32))
    plain, careful = m._gradient(ids, targets), m._gradient(ids, targets, True)
    assert plain[0] == pytest.approx(careful[0], rel=1e-5) and plain[1].tolist() == careful[1].tolist() == sorted(set(ids.ravel().tolist()))
    for a, b in zip(plain[2:], careful[2:], strict=True):
        assert np.abs(a - b).max() < 1e-5
    m.matrix *= 300
    loss, _, dx, rest = m._gradient(ids, targets)
    assert math.isfinite(loss) and np.isfinite(dx).all() and np.isfinite(rest).all()


def test_windows_of_spans_are_filled_up():
    spans = [[7], [300, 5], list(range(300, 300 + lm.CONTEXT + 1))]
    column = pa.array([np.array(s, "<u2").tobytes() for s in [[1, 2, 3], *spans]], pa.binary())[1:]
    ids, targets = lm._windows(column, 999)
    for s, i, t in zip(spans, ids.tolist(), targets.tolist(), strict=True):
        assert i == s[:-1] + [999] * (lm.CONTEXT + 1 - len(s)) and t == s[1:] + [-1] * (lm.CONTEXT + 1 - len(s))

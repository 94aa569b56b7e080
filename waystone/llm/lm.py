"""Operator 12: language-model scoring by a small causal self-attention model, trained in numpy inside Spark tasks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_SPACE, free_names, materialize, numbered_words, with_fields
from .quality import fold

#: A public byte-level vocabulary for many languages; END is the id after its last and stands for a text's end.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PIECES = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: Subword ids a window sees, those at its start that the window before has scored, and the width of a state.
CONTEXT, OVERLAP, WIDTH = 32, 4, 16
#: A subword id is DIGITS digits of so many bits; each is predicted after those before it.
DIGIT_BITS, DIGITS = 4, 4
BASE = 1 << DIGIT_BITS
#: Added to each subword's count in the digits' tables.
SMOOTH = 0.1
#: Of how many windows of a text one is learnt from: all.
EVERY = 1
#: Passes over the training windows, shares of them at most between which the models are averaged; windows that a task learns from in
#: a share; step size.
ROUNDS, SHARES, PART, STEP, BATCH = 1, 8, 8_192, 0.2, 32
#: Most frequent training words whose counts go to every task, and the bytes that such a word has at most.
HEAD, HEAD_BYTES = 1 << 18, 32
RUN_BYTES = 4 << 20
#: Subword ids that are scored at once.
BLOCK = 8_192


def _strings(words: pa.Array) -> list[str]:
    """As to_pylist, without an object of Arrow's for each."""
    return words.to_numpy(zero_copy_only=False).tolist()


class Subwords:
    """Words as subword ids; made of the ranks of a public vocabulary, given by its path, which the driver reads."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = max(self.ranks.values()) + 1
        self.line = self.ranks[b"\n"]
        self._encoding: tiktoken.Encoding | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoding": None}

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, a space before each, end to end; offsets)."""
        if self._encoding is None:
            self._encoding = tiktoken.Encoding("subwords", pat_str=PIECES, mergeable_ranks=self.ranks, special_tokens={})
        one = self._encoding.encode_ordinary
        ids = np.asarray(one("".join(f" {w}\n" for w in _strings(words))), np.int64)  # no word holds a line's end
        stop = ids == self.line
        return ids[~stop], np.append(0, np.cumsum(~stop)[stop])


class CommonWords:
    """Words whose counts and subword ids every task knows; others are encoded where they stand."""

    def __init__(self, words: pa.Array, counts: np.ndarray, subwords: Subwords) -> None:
        self.words, self.counts, self.subwords = words, counts, subwords
        ids, self.off = subwords.encode(words)
        self.ids = ids.astype(np.uint16)
        self._numbers: dict[str, int] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_numbers": None}

    def find(self, distinct: pa.Array) -> np.ndarray:
        """The number of each word, -1 for others."""
        if self._numbers is None:
            self._numbers = {w: i for i, w in enumerate(_strings(self.words))}
        return np.fromiter(map(self._numbers.get, _strings(distinct), repeat(-1)), np.int64, len(distinct))

    def text_ids(self, distinct: pa.Array, number: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts of a run as numbered_words gives it, END after each; the texts' offsets; find's numbers of the distinct words)."""
        found = self.find(distinct)
        others = np.flatnonzero(found < 0)
        more, off = self.subwords.encode(distinct.take(pa.array(others)))
        pieces = np.concatenate([self.ids, more, [self.subwords.end]]).astype(np.int64)
        off = np.concatenate([self.off, len(self.ids) + off[1:], [len(pieces)]])
        row = found.copy()
        row[others] = len(self.words) + np.arange(len(others))
        ids, at = gather_runs(pieces, off, np.insert(row[number], ends[1:], len(off) - 2))
        return ids, at[np.append(0, (ends + np.arange(len(ends)))[1:])], found


def gather_runs(values: np.ndarray, off: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs off[i] to off[i + 1] of values for each i of which, end to end; their offsets)."""
    size = np.diff(off)[which]
    ends = np.append(0, np.cumsum(size))
    return values[np.repeat(off[which] - ends[:-1], size) + np.arange(ends[-1])], ends


_ONES = np.ones(BASE, np.float32)
_SHIFTS = (DIGIT_BITS * np.arange(DIGITS)[::-1])[:, None]


@lru_cache
def _before(w: int) -> np.ndarray:
    """One where a place sees another: itself and those before."""
    return np.tri(w, dtype=np.float32)


def _thirds(qkv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, keys, values with what follows them)."""
    return qkv[:, :, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH], qkv[:, :, 2 * WIDTH :]


@dataclass
class Attention:
    """One layer of causal self-attention over subword ids, all parameters rows of one matrix.

    Digits of the next id are predicted by linear maps of the last state, added to the log shares that the digit has
    after the digits before it in all training texts (tables): with all maps zero the model is the unigram model.
    """

    vocabulary: int
    matrix: np.ndarray
    tables: list[np.ndarray]

    @cached_property
    def shares(self) -> np.ndarray:
        """The digits' shares after an id's own digits before them: (id without its last digit, digit's place and digit)."""
        before = np.arange(BASE ** (DIGITS - 1))
        return np.concatenate([np.exp(self.tables[d]).take(before >> (DIGIT_BITS * (DIGITS - 1 - d)), axis=0) for d in range(DIGITS)], axis=1)

    @staticmethod
    @lru_cache
    def rows(vocabulary: int) -> dict[str, slice]:
        out, at = {}, 0
        for name, n in (("embed", vocabulary), ("place", CONTEXT), ("query", WIDTH), ("key", WIDTH), ("value", WIDTH), ("mix", WIDTH), ("digit", BASE * DIGITS)):
            out[name] = slice(at, at + n)
            at += n
        return out

    @classmethod
    def fresh(cls, vocabulary: int, counts: np.ndarray) -> Attention:
        """A model that knows how often each id stands in the training texts and nothing else yet."""
        at = cls.rows(vocabulary)
        m = np.random.default_rng(12).normal(0, WIDTH**-0.5, (at["digit"].stop, WIDTH)).astype(np.float32)
        m[at["digit"]] = 0
        m[at["place"]] *= 0.3
        full = np.zeros(BASE**DIGITS)
        full[:vocabulary] = counts + SMOOTH
        tables = []
        for k in range(DIGITS):
            c = full.reshape(BASE**k, BASE, -1).sum(2) + 1e-12
            tables.append(np.log(c / c.sum(1, keepdims=True)).astype(np.float32))
        return cls(vocabulary, m, tables)

    def parts(self) -> dict[str, np.ndarray]:
        return {k: self.matrix[v] for k, v in self.rows(self.vocabulary).items()}

    def _states(self, ids: np.ndarray, p: dict[str, np.ndarray], careful: bool) -> dict[str, np.ndarray]:
        """Of windows of ids: flat, their embeddings; maps to what is queried with (scaled), asked and given; qkv, these and
        ones; a, weights of the places seen, and their sums; seen, what these give.

        A careful one subtracts each place's maximum before the exponentials.
        """
        n, w = ids.shape
        x = p["embed"].take(ids.ravel(), axis=0).reshape(n, w, WIDTH)
        x += p["place"][:w]
        at = self.rows(self.vocabulary)
        maps = self.matrix[at["query"].start : at["value"].stop].reshape(3, WIDTH, WIDTH).transpose(1, 0, 2).reshape(WIDTH, -1)
        maps[:, :WIDTH] *= np.float32(WIDTH**-0.5)
        flat, qkv = x.reshape(-1, WIDTH), np.empty((n * w, 3 * WIDTH + 1), np.float32)
        np.matmul(flat, maps, out=qkv[:, :-1])
        qkv[:, -1] = 1
        q, k, v = _thirds(qkv.reshape(n, w, -1))
        a = q @ k.transpose(0, 2, 1)
        if careful:
            a += np.triu(np.full((w, w), -np.inf, np.float32), 1)
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        a *= _before(w)
        seen = (a @ v).reshape(n * w, -1)  # the ones give the sums
        sums = seen[:, WIDTH:].copy()
        return {"flat": flat, "maps": maps, "qkv": qkv, "a": a, "sums": sums, "seen": seen[:, :WIDTH] / sums}

    def _digits(self, z: np.ndarray, targets: np.ndarray, p: dict[str, np.ndarray], careful: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log probability of each target, the digits' weights as (target, digit's place and digit), one by their sums as
        (target, digit's place), flat numbers of the targets' own digits' weights and their probabilities as (digit's place,
        target)).

        Shares times exponentials; a careful one adds logarithms and subtracts each digit's maximum first.
        """
        e, n = z @ p["digit"].T, len(targets)
        shares = self.shares.take(targets >> DIGIT_BITS, axis=0)
        at = targets >> _SHIFTS
        at &= BASE - 1
        at += np.arange(0, DIGITS * BASE, BASE)[:, None]
        at += np.arange(0, n * BASE * DIGITS, BASE * DIGITS)
        if careful:
            e += np.log(shares)
            digits = e.reshape(-1, DIGITS, BASE)
            digits -= digits.max(2, keepdims=True)
            total = e.ravel().take(at).sum(0, dtype=float)
        np.exp(e, out=e)
        if not careful:
            e *= shares
        sums = e.reshape(-1, BASE) @ _ONES
        if careful:
            total -= np.log(sums.astype(float)).reshape(n, DIGITS).sum(1)
        inverse = (np.float32(1) / sums).reshape(n, DIGITS)
        own = e.ravel().take(at) * inverse.T
        if not careful:
            total = np.log(np.multiply.reduce(own, axis=0, dtype=float))
        return total, e, inverse, at, own

    def log_probabilities(self, ids: np.ndarray, targets: np.ndarray, own: np.ndarray, careful: bool = False) -> np.ndarray:
        """Natural log probability of each target that own marks, after the ids of its window up to its place.

        ids, targets and own are (windows, places); others are 0. Windows that leave the range of floats go the careful way.
        """
        p, at, out = self.parts(), np.flatnonzero(own.ravel()), np.zeros(ids.size)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            f = self._states(ids, p, careful)
            z = f["seen"].take(at, axis=0) @ p["mix"]
            z += f["flat"].take(at, axis=0)
            out[at] = self._digits(z, targets.ravel().take(at), p, careful)[0]
        out = out.reshape(ids.shape)
        if not careful and not np.isfinite(out.sum()):
            bad = np.flatnonzero(~np.isfinite(out).all(1))
            out[bad] = self.log_probabilities(ids[bad], targets[bad], own[bad], True)
        return out

    def gradient(self, ids: np.ndarray, targets: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """(mean loss, rows of embed that stand in ids, their gradients, gradients of the other parts); targets below 0 don't count."""
        loss, rows, dx, rest = self._gradient(ids, targets)
        return loss, rows, dx, {k: rest[v] for k, v in self.rows(0).items() if k != "embed"}

    def _gradient(self, ids: np.ndarray, targets: np.ndarray, careful: bool = False) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """As gradient, with those of the other parts as one matrix.

        Weights stay undivided by their sums, what meets them is divided instead: no pass over all pairs of places for that.
        """
        p, (n, w) = self.parts(), ids.shape
        t = targets.ravel()
        dead = np.flatnonzero(t < 0)
        t, share = np.maximum(t, 0), np.float32(1 / max(1, len(t) - len(dead)))
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            f = self._states(ids, p, careful)
            z = f["seen"] @ p["mix"]
            z += f["flat"]
            lp, e, inverse, at, own = self._digits(z, t, p, careful)
        lp[dead] = 0
        loss = -float(lp.sum()) * float(share)
        if not careful and not np.isfinite(loss):
            return self._gradient(ids, targets, True)
        inverse *= share
        own -= 1
        own *= share
        inverse[dead], own[:, dead] = 0, 0
        e *= inverse.ravel().repeat(BASE).reshape(e.shape)
        e.ravel()[at] = own
        rest = np.zeros((len(self.matrix) - self.vocabulary, WIDTH), np.float32)
        g = {k: rest[v] for k, v in self.rows(0).items()}
        np.matmul(e.T, z, out=g["digit"])
        dx = e @ p["digit"]
        np.matmul(f["seen"].T, dx, out=g["mix"])
        ds = np.empty((n * w, WIDTH + 1), np.float32)
        own = dx @ p["mix"].T
        ds[:, :-1], ds[:, -1] = own, (own * f["seen"]) @ -np.ones(WIDTH, np.float32)
        ds /= f["sums"]
        ds, d = ds.reshape(n, w, -1), np.empty((n, w, 3 * WIDTH), np.float32)
        q, k, v = _thirds(f["qkv"].reshape(n, w, -1))
        dq, dk, dv = _thirds(d)
        np.matmul(f["a"].transpose(0, 2, 1), ds[:, :, :-1], out=dv)
        da = ds @ v.transpose(0, 2, 1)
        da *= f["a"]
        np.matmul(da, k, out=dq)
        np.matmul(da.transpose(0, 2, 1), q, out=dk)
        d = d.reshape(n * w, -1)
        maps = f["flat"].T @ d
        maps[:, :WIDTH] *= np.float32(WIDTH**-0.5)
        rest[CONTEXT : CONTEXT + 3 * WIDTH].reshape(3, WIDTH, WIDTH)[:] = maps.reshape(WIDTH, 3, WIDTH).transpose(1, 0, 2)
        dx += d @ f["maps"].T
        g["place"][:w] = dx.reshape(n, -1).sum(0).reshape(w, WIDTH)
        flat, number = ids.ravel().astype(np.uint16), np.empty(n * w, np.int64)  # an id is DIGITS digits; numbers so small are sorted by counting
        order = flat.argsort(kind="stable")
        flat = flat.take(order)
        fresh = np.ones(n * w, bool)
        np.not_equal(flat[1:], flat[:-1], out=fresh[1:])
        rows = flat[fresh].astype(np.int64)
        number[order] = fresh.cumsum() * WIDTH - WIDTH
        cells = (number[:, None] + np.arange(WIDTH)).ravel()
        return loss, rows, np.bincount(cells, dx.ravel()).astype(np.float32).reshape(-1, WIDTH), rest

    def learn(self, ids: np.ndarray, targets: np.ndarray, step: float = STEP, batch: int = BATCH) -> float:
        """One pass over windows by Adagrad, in place; the mean loss on the way."""
        total, (past, rest) = 0.0, (np.full_like(self.matrix, 1e-4), slice(self.vocabulary, None))
        for i in range(0, len(ids), batch):  # ids count from 0, targets of -1 only fill windows up
            loss, rows, dx, g = self._gradient(ids[i : i + batch], targets[i : i + batch])
            total += loss * len(ids[i : i + batch])
            now = past.take(rows, axis=0)
            now += dx * dx
            past[rows] = now
            dx *= np.float32(step)
            dx /= np.sqrt(now, out=now)
            self.matrix[rows] = self.matrix.take(rows, axis=0) - dx
            past[rest] += g * g
            self.matrix[rest] -= np.float32(step) * g / np.sqrt(past[rest])
        return total / max(1, len(ids))


def score_texts(model: Attention, ids: np.ndarray, off: np.ndarray, end: int) -> np.ndarray:
    """Log probability (natural) of each text, its ids from off[i] to off[i + 1], the last one end.

    Windows of CONTEXT ids overlap by OVERLAP; each id is scored once, by the first window that reaches it.
    """
    seen = np.append(end, ids[:-1])  # what stands before a text's first id is the end of another
    size = np.diff(off)
    stride = CONTEXT - OVERLAP
    count = 1 + np.maximum(0, -(-(size - CONTEXT) // stride))
    text = np.repeat(np.arange(len(size)), count)
    j = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first, stop = off[text] + j * stride, off[1:][text]
    out, place = np.zeros(len(size)), np.arange(CONTEXT)
    rows = max(1, BLOCK // CONTEXT)
    for a in range(0, len(first), rows):
        at = first[a : a + rows, None] + place
        own = (at < stop[a : a + rows, None]) & ((place >= OVERLAP) | (j[a : a + rows, None] == 0))
        at = np.minimum(at, stop[a : a + rows, None] - 1)
        lp = model.log_probabilities(seen[at], ids[at], own).sum(1)
        out += np.bincount(text[a : a + rows], lp, len(size))
    return out


@dataclass
class LanguageModel:
    """What score_documents needs: training counts (word, c) as a written table, their sums, the commonest words and the
    attention model."""

    counts: DataFrame
    total: int
    distinct: int
    ends: int
    common: CommonWords
    attention: Attention


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all whole texts: the words between white space, A-Z lower-cased. A row a run of texts and word is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, distinct, number, _ in numbered_words(b.column("text"), NO_SPACE, 4 * RUN_BYTES):
                yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(number, minlength=len(distinct)))], ["word", "c"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def subword_counts(counts: DataFrame, subwords: Subwords) -> np.ndarray:
    """How often each subword id stands in the texts that counts (word, c) are of; a row an id and task is shuffled."""
    n = subwords.end + 1
    shared = counts.sparkSession.sparkContext.broadcast(subwords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            ids, off = shared.value.encode(b.column("word"))
            np.add.at(total, ids, np.repeat(b.column("c").to_numpy(), np.diff(off)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "c"])

    out = np.zeros(n, np.int64)
    for r in counts.mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect():  # ids of the vocabulary
        out[r["id"]] = r["c"]
    return out


def training_spans(docs: DataFrame, subwords: Subwords, every: int = EVERY, common: CommonWords | None = None) -> DataFrame:
    """(ids): windows of CONTEXT + 1 subword ids or fewer over every whole text (text); ids as two bytes each.

    Each begins with the id before it, which for a text's first one is the end of another text, so that every id of every
    text, its end included, is to be predicted once. With every above 1, of each so many windows of a text one, at least one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common or CommonWords(pa.array([], pa.string()), np.zeros(0, np.int64), subwords))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for _, _, distinct, number, ends in numbered_words(b.column("text"), NO_SPACE, RUN_BYTES):
                ids, texts, _ = known.text_ids(distinct, number, ends)
                count = -(-np.diff(texts) // CONTEXT)
                j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                some = j % every == np.repeat(texts[1:] % np.minimum(every, count), count)
                first, stop = np.repeat(texts[:-1], count)[some] + j[some] * CONTEXT, np.repeat(texts[1:], count)[some]
                size = np.minimum(stop - first, CONTEXT) + 1
                cut = np.append(0, np.cumsum(size))
                flat = np.append(known.subwords.end, ids).astype("<u2")[np.repeat(first - cut[:-1], size) + np.arange(cut[-1])]
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((cut * 2).astype(np.int32)), pa.py_buffer(flat.tobytes())])], ["ids"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "ids binary")


def _windows(spans: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, targets) of spans, filled up with end and -1."""
    _, off, flat = spans.buffers()
    off = np.frombuffer(off, np.int32)[spans.offset : spans.offset + len(spans) + 1] // 2
    place, size = np.arange(CONTEXT + 1), np.diff(off)[:, None]
    both = np.full((len(spans), CONTEXT + 1), -1, np.int64)
    both[place < size] = np.frombuffer(flat, "<u2")[off[0] : off[-1]]
    return np.where(place[1:] < size, both[:, :-1], end), both[:, 1:].copy()


def fit_attention(spans: DataFrame, model: Attention, end: int, rounds: int = ROUNDS, part: int = PART, shares: int = SHARES) -> Attention:
    """Learns from all spans (ids): parts of about part spans learn in tasks of their own, each from the same model.

    A round takes all spans, share after share (fewer of them where there are fewer parts). After each share the models are averaged row by row, weighted by how often a part met the row; what comes to the
    driver is one matrix. Parts are dealt by a number that stands in a written table, so a task that runs again learns
    the same.
    """
    spark, rows = spans.sparkSession, Attention.rows(model.vocabulary)
    t = materialize(spans.withColumn("no", F.monotonically_increasing_id()))
    n = t.count()
    shares = max(1, min(shares, -(-n // part)))
    own = F.pmod(F.xxhash64(F.lit(-1), "no"), F.lit(shares))
    for r in range(rounds * shares if n else 0):
        shared = spark.sparkContext.broadcast(model)

        def run(table: pa.Table) -> pa.Table:
            old = shared.value  # noqa: B023
            table = table.sort_by("no")
            ids, targets = _windows(pa.concat_arrays(table["ids"].chunks), end)
            new = Attention(old.vocabulary, old.matrix.copy(), old.tables)
            new.shares = old.shares
            new.learn(ids, targets)
            met = np.bincount(ids.ravel(), minlength=old.vocabulary)
            row = np.concatenate([np.flatnonzero(met), np.arange(rows["place"].start, rows["digit"].stop)])
            weight = np.concatenate([met[met > 0], np.full(rows["digit"].stop - rows["place"].start, ids.size)]).astype(float)
            d = pa.FixedSizeListArray.from_arrays(pa.array((new.matrix - old.matrix)[row].ravel()), WIDTH).cast(pa.list_(pa.float32()))
            return pa.Table.from_arrays([pa.array(row), pa.array(weight), d], ["row", "weight", "d"])

        key = F.pmod(F.xxhash64(F.lit(r), "no"), F.lit(max(1, -(-n // (part * shares)))))
        moved = t.where(own == r % shares).groupBy(key.alias("part")).applyInArrow(run, "row long, weight double, d array<float>")
        mean = [(F.sum(F.get("d", F.lit(i)) * F.col("weight")) / F.sum("weight")).alias(f"d{i}") for i in range(WIDTH)]
        got = moved.groupBy("row").agg(*mean).toArrow()
        model.matrix[got["row"].to_numpy()] += np.stack([got[f"d{i}"].to_numpy() for i in range(WIDTH)], axis=1).astype(np.float32)
    return model


def train_language_model(docs: DataFrame, folds: int = 7, out_fold: int = 2, subwords: Subwords | None = None, rounds: int = ROUNDS, every: int = EVERY) -> LanguageModel:
    """Learns from the texts of docs (doc_id, text) outside one fold of the ids.

    Words and subwords are counted over all of them; the attention model learns from every id of every text (of every
    windows one), so its work grows with the texts, and only averages and counts of a bounded vocabulary come to the driver.
    Null and empty texts are a text's end alone; null ids are in fold 0; repeated rows count each; without rows the
    model knows nothing.
    """
    subwords = subwords or Subwords()
    d = docs.where(fold(F.col("doc_id"), folds) != out_fold).select(F.col("text").cast("string").alias("text"))
    counts = materialize(word_counts(d))
    ends = d.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    head = counts.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    common = CommonWords(pa.concat_arrays([pa.array([], pa.string()), *head["word"].cast(pa.string()).chunks]), head["c"].to_numpy(), subwords)
    seen = subword_counts(counts, subwords)
    seen[subwords.end] = ends
    attention = fit_attention(training_spans(d, subwords, every, common), Attention.fresh(subwords.end + 1, seen), subwords.end, rounds)
    return LanguageModel(counts, sums["total"] + ends, sums["distinct"] + (ends > 0), ends, common, attention)


def score_documents(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs (text, …) without text and with n_tokens, n_known, train_tokens, base_score and score, all log10.

    base_score is that of the words and the text's end by their smoothed shares among the training tokens, score that
    of the attention model. Null and empty texts are scored as a text's end alone, rows each on its own; columns of
    these names are replaced, others pass through; an empty table stays empty.

    Counts of the commonest words are looked up in the task that reads the text; other words meet their counts in a
    join, a row a text and word, and only sums come back to the text's row.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in docs.columns if c not in new and c != "text"]
    row, text, known, base, words, times, more, also = free_names(docs.select(*keep), "row", "text", "known", "base", "words", "times", "more", "also")
    rest = LanguageModel(None, model.total, model.distinct, model.ends, model.common, model.attention)
    shared = docs.sparkSession.sparkContext.broadcast(rest)
    per_word = lambda c: np.log10((c + 1) / (rest.total + rest.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        c_head, end = m.common.counts, m.common.subwords.end
        ending = per_word(m.ends)
        for b in batches:
            for lo, hi, distinct, number, ends in numbered_words(b.column(text), NO_SPACE, RUN_BYTES):
                n, size = hi - lo, np.diff(ends)
                ids, texts, found = m.common.text_ids(distinct, number, ends)
                nats = score_texts(m.attention, ids, texts, end)
                of, where = np.repeat(np.arange(n), size), found[number]
                common = where >= 0
                sums = np.bincount(of[common], per_word(c_head[where[common]]), n) + ending
                near = np.bincount(of[common], minlength=n) + (m.ends > 0)
                pair, count = np.unique(of[~common] * max(1, len(distinct)) + number[~common], return_counts=True)
                cut = np.append(0, np.cumsum(np.bincount(pair // max(1, len(distinct)), minlength=n))).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(cut), distinct.take(pa.array(pair % max(1, len(distinct)))))
                times_ = pa.ListArray.from_arrays(pa.array(cut), pa.array(count.astype(np.int64)))
                own = [pa.array(size + 1), pa.array(near.astype(np.int64)), pa.array(np.full(n, m.total)), pa.array(sums), pa.array(nats / np.log(10)), rare, times_]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, n) for c in keep), b.column(row).slice(lo, n), *own], [*keep, row, "n_tokens", known, "train_tokens", base, "score", words, times])

    d = docs.select(*keep, F.col("text").cast("string").alias(text), F.monotonically_increasing_id().alias(row))
    schema = with_fields(docs.select(*keep).schema, **{row: "long", "n_tokens": "long", known: "long", "train_tokens": "long", base: "double", "score": "double", words: "array<string>", times: "array<long>"})
    t = materialize(d.mapInArrow(run, schema))
    rare = t.select(row, F.explode(F.arrays_zip(F.col(words).alias("w"), F.col(times).alias("n"))).alias("x")).select(row, F.col("x.w").alias("word"), F.col("x.n").alias("n"))
    rare = rare.join(model.counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = rare.groupBy(row).agg(F.sum(F.col("n") * F.log10((F.col("c") + 1.0) / F.lit(float(rest.total + rest.distinct + 1)))).alias(more), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias(also))
    t = t.drop(words, times).join(rare, row, "left")
    return t.select(*keep, "n_tokens", (F.col(known) + F.coalesce(also, F.lit(0))).alias("n_known"), "train_tokens", (F.col(base) + F.coalesce(more, F.lit(0.0))).alias("base_score"), "score")


def op12_lm_scoring(docs: DataFrame) -> DataFrame:
    """The digest of score_documents: one row per document."""
    slim = docs.select("doc_id", "text")
    held_out = (fold(F.col("doc_id"), 7) == 2).alias("held_out")
    return score_documents(slim, train_language_model(slim)).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")

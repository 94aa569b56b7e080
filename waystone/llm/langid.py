"""Operator 10: language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, with_fields
from .quality import fold

#: Characters of the longest gram.
ORDER = 4
#: Most training documents, and bytes of their texts, that are drawn for each language, by hash, and most languages.
SAMPLE_ROWS, SAMPLE_BYTES, LANGUAGES = 1_500, 16 << 20, 400
#: One in so many of them is kept back to calibrate rejection.
HELD_BACK = 5
#: Share of held-back documents of a language that its rejection bound lets through.
ACCEPT = 0.995
#: Symbols that the evidence for a score is counted up to: neighbouring symbols are no independent evidence, and all
#: scores of longer texts would round to 1. The predicted language doesn't depend on it.
EVIDENCE = 50
CHUNK_CHARS = 1 << 20
_P = np.uint64(0xD6E8FEB86659FD93)
_SPACE = 32


def symbols(text: str) -> np.ndarray:
    """The text as code points: lower case, every run of what is no letter one space, a space at either end."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = (cp >= 97) & (cp <= 122)
    high = np.flatnonzero(cp >= 128)
    if len(high):
        kinds, at = np.unique(cp[high], return_inverse=True)
        low[high] = np.array([chr(c).isalpha() for c in kinds])[at]
    out = np.full(len(cp) + 2, _SPACE, np.uint32)
    out[1:-1][low] = cp[low]
    return out[np.append(True, (out[1:] != _SPACE) | (out[:-1] != _SPACE))]


def grams(s: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n symbols of s; by place."""
    m = max(0, len(s) - n + 1)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = (h + s[j : j + m].astype(np.uint64) + np.uint64(1)) * _P
    return mix64(h + np.uint64(n))


def _runs(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts with a letter, as (their numbers, symbols end to end, offsets), about CHUNK_CHARS or one text at once."""
    which, parts, size = [], [], 0
    for i, t in enumerate(texts):
        if t and len(s := symbols(t)) > 1:
            which.append(i)
            parts.append(s)
            size += len(s)
        if parts and (size > CHUNK_CHARS or i == len(texts) - 1):
            yield which, np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
            which, parts, size = [], [], 0
    if parts:
        yield which, np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))


@dataclass
class Models:
    """One Kneser-Ney model per language over shared sorted hash arrays.

    keys[n]: the hashes of all n-grams seen in any language; logp[n]: their log probability in each; contexts[n] and
    backoff[n]: the same for contexts of n-grams and the log weight that an unseen symbol's shorter gram gets.
    """

    langs: list[str]
    floor: float = 0.0
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    logp: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    backoff: dict[int, np.ndarray] = field(default_factory=dict)
    bound: np.ndarray | None = None

    def log_probabilities(self, s: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """For each place in at, the log probability in each language of the symbol that ends an n-gram there."""
        if n == 0:
            return np.full((len(at), len(self.langs)), self.floor, np.float32)
        first = at - n + 1
        h = _place_hashes(s, first, n)
        i, hit = _look(self.keys[n], h)
        if hit.all():
            return self.logp[n][i]
        out = np.empty((len(at), len(self.langs)), np.float32)
        out[hit] = self.logp[n][i[hit]]
        miss = np.flatnonzero(~hit)
        j, known = _look(self.contexts[n], _place_hashes(s, first[miss], n - 1))
        out[miss] = self.log_probabilities(s, at[miss], n - 1)
        out[miss[known]] += self.backoff[n][j[known]]
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(mean cost of a symbol in each language, number of symbols) for each text; no letter: 0 symbols."""
        cost, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        if not self.langs:
            return cost, count
        for which, s, off in _runs(texts):
            p = np.zeros((len(s), len(self.langs)), np.float32)
            for n in range(2, ORDER + 1):  # the first symbols of a text have shorter contexts
                at = off[:-1] + n - 1
                at = at[at < off[1:]] if n < ORDER else np.flatnonzero(np.arange(len(s)) - np.repeat(off[:-1], np.diff(off)) >= n - 1)
                p[at] = self.log_probabilities(s, at, n)
            sums = np.add.reduceat(p, off[:-1], axis=0, dtype=np.float64)
            count[which] = np.diff(off) - 1
            cost[which] = -sums / count[which][:, None]
        return cost, count


def _place_hashes(s: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(first), np.uint64)
    for j in range(n):
        h = (h + s[first + j].astype(np.uint64) + np.uint64(1)) * _P
    return mix64(h + np.uint64(n))


def _look(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    i = np.searchsorted(keys, h)
    i[i == len(keys)] = 0
    return i, keys[i] == h


def gram_counts(d: DataFrame) -> DataFrame:
    """(k, gram, c) of documents (k: number of the language, text): how often each gram of ORDER symbols occurs, and of
    fewer symbols those at texts' starts, where nothing stands to the left."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, texts = b.column("k").to_numpy(), b.column("text").to_pylist()
            for k in np.unique(lang):
                for _, s, off in _runs([texts[i] for i in np.flatnonzero(lang == k)]):
                    for n in range(2, ORDER + 1):
                        first = off[:-1][off[:-1] + n <= off[1:]] if n < ORDER else np.flatnonzero(np.arange(len(s)) + n <= np.repeat(off[1:], np.diff(off)))
                        _, at, c = np.unique(_place_hashes(s, first, n), return_index=True, return_counts=True)
                        text = s.astype("<u4").tobytes().decode("utf-32-le")
                        g = [text[i : i + n] for i in first[at]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array(g, pa.string()), pa.array(c, pa.int64())], ["k", "gram", "c"])

    return d.select("k", "text").mapInArrow(count, "k int, gram string, c bigint").groupBy("k", "gram").agg(F.sum("c").alias("c"))


def _hashed(d: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, values) of rows (gram of n symbols, v: array<double>), hashed in Spark tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.frombuffer("".join(b.column("gram").to_pylist()).encode("utf-32-le"), np.uint32)
            h = _place_hashes(s, np.arange(b.num_rows) * n, n)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("v")], ["h", "v"])

    t = d.select("gram", "v").mapInArrow(run, "h bigint, v array<double>").toArrow().combine_chunks()
    if not t.num_rows:
        return np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)
    h = t["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], t["v"].combine_chunks().flatten().to_numpy().reshape(len(h), -1)[order].astype(np.float32)


def build_models(langs: list[str], counts: DataFrame) -> Models:
    """Models from gram_counts of these languages, as Spark aggregates.

    Counts of the longest grams are used as such, those of shorter ones count distinct left neighbours; each order
    takes the absolute discount n1 / (n1 + 2 n2) and interpolates with the next shorter, the shortest with the
    uniform distribution over all symbols seen and one more. Only hashes and log probabilities come to the driver.
    """
    m, kinds = Models(langs), range(len(langs))
    rows = materialize(counts)
    level = {ORDER: rows.where(F.char_length("gram") == ORDER)}
    for n in range(ORDER - 1, 0, -1):
        starts = rows.where(F.char_length("gram") == n)
        suffixes = level[n + 1].select("k", F.substring("gram", 2, n).alias("gram"), F.lit(1).cast("long").alias("c"))
        level[n] = materialize(starts.unionByName(suffixes).groupBy("k", "gram").agg(F.sum("c").alias("c")))
    m.floor = float(-np.log(level[1].select("gram").distinct().count() + 1))
    dense = lambda x: F.array(*[F.sum(F.when(F.col("k") == k, x).otherwise(0)).cast("double") for k in kinds])
    shorter = None
    for n in range(1, ORDER + 1):
        few = {r["k"]: r for r in level[n].groupBy("k").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).collect()}
        cuts = [few[k]["n1"] / (few[k]["n1"] + 2 * few[k]["n2"]) if k in few and few[k]["n1"] and few[k]["n2"] else 0.5 for k in kinds]
        cut = F.array(*map(F.lit, cuts))
        context = F.substring("gram", 1, n - 1).alias("context")
        of = level[n].groupBy(context).agg(dense(F.col("c")).alias("total"), dense(F.lit(1)).alias("kinds"))
        weight = F.transform(F.sequence(F.lit(0), F.lit(len(langs) - 1)), lambda k: F.when(F.get("total", k) > 0, F.get(cut, k) * F.get("kinds", k) / F.get("total", k)).otherwise(1.0))  # noqa: B023
        of = materialize(of.withColumn("weight", weight))
        d = level[n].groupBy("gram").agg(dense(F.col("c")).alias("c")).withColumn("context", context).join(of, "context")
        if shorter is not None:
            d = d.withColumn("low", F.substring("gram", 2, n - 1)).join(shorter.select(F.col("gram").alias("low"), F.col("p").alias("below")), "low")
        else:
            d = d.withColumn("below", F.array(*[F.lit(float(np.exp(m.floor)))] * len(langs)))
        own = lambda k: F.when(F.get("c", k) > 0, F.greatest(F.get("c", k) - F.get(cut, k), F.lit(0.0)) / F.get("total", k)).otherwise(0.0)  # noqa: B023, E731
        d = d.withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(len(langs) - 1)), lambda k: own(k) + F.get("weight", k) * F.get("below", k)))  # noqa: B023
        shorter = materialize(d.select("gram", "p"))
        m.keys[n], m.logp[n] = _hashed(shorter.select("gram", F.transform("p", lambda x: F.log(x)).alias("v")), n)
        m.contexts[n], m.backoff[n] = _hashed(of.select(F.col("context").alias("gram"), F.transform("weight", lambda x: F.log(x)).alias("v")), n - 1)
    return m


def train_languages(docs: DataFrame, folds: int = 3, out_fold: int = 1, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, most: int = LANGUAGES) -> Models:
    """Models of the languages named in docs (doc_id, text, lang), learnt outside one fold of the ids.

    Whole documents are drawn by hash, at most sample_rows and together sample_bytes a language, one text for each id;
    that bounds the models, too. One in HELD_BACK only sets the bound of its language's cross-entropy, beyond which a
    text is rejected. Of more languages than most, the commonest are learnt. Null languages are left out.
    """
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    d = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != out_fold))
    sizes = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    langs = sorted(sizes)
    if not langs:
        return Models([])
    each = lambda f: F.element_at(F.create_map(*[x for i, n in enumerate(langs) for x in (F.lit(n), F.lit(f(i, n)))]), F.col("lang"))
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(10), "doc_id"), 1) / F.lit(2.0**63)
    d = d.where(spot < each(lambda _, n: min(1.0, 2.0 * sample_rows / sizes[n]))).withColumn("k", each(lambda i, _: i))
    d = d.groupBy("k", "lang", "doc_id").agg(F.min("text").alias("text"))
    w = Window.partitionBy("k").orderBy(spot, "doc_id")
    d = d.withColumn("no", F.row_number().over(w)).withColumn("bytes", F.sum(F.octet_length("text").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.where((F.col("no") <= sample_rows) & ((F.col("bytes") <= sample_bytes) | (F.col("no") == 1)))
    d = materialize(d.withColumn("back", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(HELD_BACK)) == 0).select("k", "lang", "text", "back"))
    m = build_models(langs, gram_counts(d.where("NOT back")))
    back = score_languages(d.where("back").select("lang", "text"), m).where("lang_pred = lang").select("lang_pred", "cross_entropy")
    bounds = {r["lang_pred"]: r["b"] for r in back.groupBy("lang_pred").agg(F.percentile("cross_entropy", F.lit(ACCEPT)).alias("b")).collect()}
    m.bound = np.array([bounds.get(x, np.inf) for x in langs])
    return m


def score_languages(docs: DataFrame, models: Models) -> DataFrame:
    """docs with lang_pred, score, cross_entropy and rejected for each whole text, no shuffle.

    The language of least mean cost per symbol wins (ties: the first by name); score is the softmax of the languages'
    costs over at most EVIDENCE symbols; a text whose cost exceeds its language's calibrated bound is marked rejected.
    Null texts, texts without a letter and models without a language give und, 0.0, null and true. Columns of these
    names are replaced; repeated rows are scored each on its own; an empty table stays empty.
    """
    new = ["lang_pred", "score", "cross_entropy", "rejected"]
    keep = [c for c in docs.columns if c not in new]
    d = docs.select(*keep)
    shared = d.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            cost, n = m.cross_entropies(b.column("text").to_pylist())
            some = (n > 0) & bool(m.langs)
            best = cost.argmin(axis=1) if m.langs else np.zeros(len(n), np.int64)
            least = cost[np.arange(len(n)), best] if m.langs else np.zeros(len(n))
            odds = np.exp(-(cost - least[:, None]) * np.minimum(n, EVIDENCE)[:, None]).sum(axis=1) if m.langs else np.ones(len(n))
            bound = m.bound[best] if m.bound is not None and m.langs else np.full(len(n), np.inf)
            name = [m.langs[k] if ok else "und" for k, ok in zip(best, some, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(name, pa.string()), pa.array(np.where(some, 1 / odds, 0.0)), pa.array(least, pa.float64(), mask=~some), pa.array(~some | (least > bound))], [*keep, *new])

    return d.mapInArrow(run, with_fields(d.schema, lang_pred="string", score="double", cross_entropy="double", rejected="boolean"))


def op10_language_id(docs: DataFrame) -> DataFrame:
    """The digest of score_languages: one row per document."""
    scored = score_languages(docs.select("doc_id", "text"), train_languages(docs))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")

"""Operator 13: fill-in-middle rewriting of documents by a two-pass streaming matcher."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, free_names, with_fields

#: A unit is a line with its end.
LINES = r"[^\n]*\n|[^\n]+"
#: Percent of documents that are rewritten, and of those the percent that begin with the suffix.
RATE, SUFFIX_FIRST = 100, 50
#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Rewrite:
    """How texts are rewritten: unit is an expression whose matches cover a text, seed deals out cuts and forms."""

    unit: str = LINES
    rate: int = RATE
    suffix_first: int = SUFFIX_FIRST
    marks: tuple[str, str, str] = MARKS
    seed: int = 7

    def __post_init__(self) -> None:
        if len(set(self.marks)) != 3 or any(not m or m[:i] == m[-i:] for m in self.marks for i in range(1, len(m))):
            raise ValueError("marks must differ and none may begin as it ends")
        if any(a != b and (a in b or any(a[-i:] == b[:i] for i in range(1, min(len(a), len(b))))) for a in self.marks for b in self.marks):
            raise ValueError("no mark may hold another or run into it")

    def draws(self, doc_id: object) -> list[int]:
        """Four numbers below 2^32 that depend on seed and id alone; a null id counts as the empty string."""
        h = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]

    def apply(self, doc_id: object, text: str) -> tuple[int, str, str, str, str, str]:
        """(number of units, form, prefix, middle, suffix, output) of a text.

        The first pass only counts the matches; the second advances one lazy iterator to both cuts. Neither keeps
        more than the match at hand.
        """
        one = re.compile(self.unit)
        n = sum(1 for _ in one.finditer(text))
        a, b, c, d = self.draws(doc_id)
        if not text or c % 100 >= self.rate or any(m in text for m in self.marks):
            return n, "plain", "", "", "", text
        low, high = sorted((a % (n + 1), b % (n + 1)))
        matches = one.finditer(text)
        first = _end_of(matches, low, 0)
        second = _end_of(matches, high - low, first)
        prefix, middle, suffix = text[:first], text[first:second], text[second:]
        p, s, m = self.marks
        if d % 100 < self.suffix_first:
            return n, "spm", prefix, middle, suffix, "".join((s, suffix, p, prefix, m, middle))
        return n, "psm", prefix, middle, suffix, "".join((p, prefix, s, suffix, m, middle))


def _end_of(matches: Iterator[re.Match], units: int, at: int) -> int:
    """The end of so many more matches; at, where there are none."""
    last = next(itertools.islice(matches, units - 1, None), None) if units else None
    return at if last is None else last.end()


def fill_in_middle(docs: DataFrame, how: Rewrite | None = None) -> DataFrame:
    """docs (doc_id, text, …) with fim_text, fim_form, fim_units, prefix_chars, middle_chars and suffix_chars.

    Each whole text is cut before and after a run of units and put together as prefix-suffix-middle (psm) or
    suffix-prefix-middle (spm) with a mark before each part; the cuts and the form hang on the id alone, so reruns
    agree. Null counts as the empty text. Empty texts, those that hold a mark and those outside the rate stay as they
    are (plain, null lengths). What a unit's expression leaves out at the end belongs to the suffix. Rows are
    rewritten each on its own, repeated ones alike; columns of these names are replaced, others pass through; an empty
    table stays empty. Nothing is shuffled.
    """
    how = how or Rewrite()
    new = ["fim_text", "fim_form", "fim_units", "prefix_chars", "middle_chars", "suffix_chars"]
    keep = [c for c in docs.columns if c not in new]
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
    (name,) = free_names(docs.select(*keep), "text")
    d = docs.select(*keep, F.col("text").cast("string").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, size, rows = 0, 0, []
            for i in range(b.num_rows):  # a text at a time; rows go on once they hold CHUNK_BYTES
                n, form, prefix, middle, suffix, out = how.apply(b.column("doc_id")[i].as_py(), b.column(name)[i].as_py() or "")
                sizes = (None,) * 3 if form == "plain" else (len(prefix), len(middle), len(suffix))
                rows.append((out, form, n, *sizes))
                size += len(out)
                if size >= CHUNK_BYTES or i + 1 == b.num_rows:
                    made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(first, i + 1 - first) for c in keep), *made], [*keep, *new])
                    first, size, rows = i + 1, 0, []

    schema = with_fields(docs.select(*keep).schema, fim_text="string", fim_form="string", fim_units="long", prefix_chars="long", middle_chars="long", suffix_chars="long")
    return d.mapInArrow(run, schema)


def restored(text: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The document's text again, from fim_text and fim_form alone."""
    cut = F.split(text, "|".join(re.escape(m) for m in marks))
    return F.when(form == "plain", text).otherwise(F.concat(F.when(form == "psm", F.get(cut, F.lit(1))).otherwise(F.get(cut, F.lit(2))), F.get(cut, F.lit(3)), F.when(form == "psm", F.get(cut, F.lit(2))).otherwise(F.get(cut, F.lit(1)))))


def op13_fill_in_middle(docs: DataFrame) -> DataFrame:
    """The digest of fill_in_middle: one row per document."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs.select("doc_id", "text")).select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), "prefix_chars", "middle_chars",
        sha(F.col("fim_text")).alias("output_sha256"), sha(restored(F.col("fim_text"), F.col("fim_form"))).alias("restored_sha256"),
    )

"""Operator 5: secret scans, with trigram indexes queried by what each rule's expression makes mandatory."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, text_chunks, with_fields


@dataclass(frozen=True)
class Rule:
    """A kind of secret; group's length must be at least least, else the match is dropped. What found says is the secret."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    fold: bool = False
    found: int = 0


#: A PEM key: from its BEGIN line to the END line, if no other BEGIN or END line comes first; else to the end of the base64
#: lines (indented, quoted or with \n written for line ends), encryption headers before them included. Linear: nothing is tried twice.
_EOL = r"""(?=[\x20\t"',;]*+(?:\\|[\r\n]|\Z))"""
_LINE = r"""(?:\r?\n|(?:\\r)?\\n)[\x20\t>#*|"']*+"""
_BASE64 = rf"""(?:(?:[\s>#*|"',]|\\[nrt])*+[A-Za-z0-9+/]{{20,}}+={{0,2}}|{_LINE}[A-Za-z0-9+/]++={{0,2}}{_EOL})"""
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----(?:BEGIN|END)\x20)[^-]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:(?:{_LINE}[A-Za-z][A-Za-z-]*+:\x20[^\r\n\\]*+)*+(?:{_LINE}(?=[\r\n\\]))*+{_BASE64})?+{_BASE64}*+)"
)

#: The base kinds first, then further kinds of secrets.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("private_key", PRIVATE_KEY),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_hook", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    # one try a run of its characters, from the first eyJ on: none later in the run could do better
    Rule("signed", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", found=1),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{20,}", fold=True),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]*+:[^\s:/@]{3,}+@[A-Za-z0-9]"),
)
BASE_KINDS = ("assign", "access", "hex")
#: Most exact strings that a part of an expression is followed as.
EXACT = 48
#: A query is ("all",) | ("and" | "or", parts) | ("gram", bytes).
ALL = ("all",)


def _both(kind: str, parts: list) -> tuple:
    """parts joined; what says nothing drops out of an and, and takes an or with it."""
    if kind == "or" and (not parts or ALL in parts):
        return ALL
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[bytes]) -> tuple:
    return _both("or", [_both("and", [("gram", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


class _Expression:
    """What a regular expression's parts must match, read from left to right.

    It knows characters, escapes, classes, groups of every sort, branches and repeats; what it doesn't know (classes
    of many, negated or named characters, look-arounds, references) says nothing, which is always right.
    """

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def ahead(self, *options: str) -> str:
        """The option that comes next, which is then read; else the empty string."""
        found = next((o for o in options if self.text.startswith(o, self.at)), "")
        self.at += len(found)
        return found

    def branches(self) -> tuple[set[bytes] | None, tuple]:
        """(the strings that the branches match, if they are few; what any match must contain)."""
        parts = [self.sequence()]
        while self.ahead("|"):
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        exact = set().union(*[p[0] for p in parts]) if all(p[0] is not None for p in parts) else None
        return exact, _both("or", [p[1] for p in parts])

    def sequence(self) -> tuple[set[bytes] | None, tuple]:
        run, must, whole = {b""}, [], True
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            exact, query = self.repeated()
            if exact is not None and len(run) * len(exact) <= EXACT:
                run = {a + b for a, b in product(run, exact)}
            else:
                must += [query, _of_strings(run)]
                run, whole = exact or {b""}, False
        return (run if whole else None), _both("and", [*must, _of_strings(run)])

    def repeated(self) -> tuple[set[bytes] | None, tuple]:
        exact, query = self.atom()
        low, high = 1, 1
        if sign := self.ahead("*", "+", "?"):
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[sign]
        elif m := re.compile(r"\{(\d*)(,?)(\d*)\}").match(self.text, self.at):
            self.at = m.end()
            low = int(m[1] or 0)
            high = low if not m[2] else int(m[3]) if m[3] else None
        else:
            return exact, query
        self.ahead("+", "?")
        if high == 1:
            return (exact | {b""} if exact is not None and low == 0 else exact), (query if low else ALL)
        return None, (query if low else ALL)

    def atom(self) -> tuple[set[bytes] | None, tuple]:
        if self.ahead("("):
            kind = self.ahead("?:", "?>", "?=", "?!", "?<=", "?<!") or self.ahead("?P<", "?")
            if kind in ("?P<", "?"):
                if kind == "?":
                    raise ValueError(f"group at {self.at} of {self.text!r}")
                self.at = self.text.index(">", self.at) + 1
            exact, query = self.branches()
            if not self.ahead(")"):
                raise ValueError(f"no end of a group in {self.text!r}")
            if kind in ("?=", "?!", "?<=", "?<!"):
                return {b""}, ALL
            return exact, query
        if self.ahead("["):
            return self.members(), ALL
        if self.ahead("^", "$"):
            return {b""}, ALL
        if self.ahead("."):
            return None, ALL
        c = self.character()
        return ({b""} if c == "" else None if c is None or ord(c) > 127 else {c.lower().encode()}), ALL

    def character(self) -> str | None:
        """The next character; none ("") for a place, None for one of several."""
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return c
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return chr(int(self.text[self.at - 2 : self.at], 16))
        if c in "AbBZ":
            return ""
        if c in "nrtfva0":
            return {"n": "\n", "r": "\r", "t": "\t", "f": "\f", "v": "\v", "a": "\a", "0": "\0"}[c]
        return None if c.isalnum() else c

    def members(self) -> set[bytes] | None:
        """The lower-cased members of a class of few ASCII characters; its bracket has been read."""
        known, out = not self.ahead("^"), set()
        first = True
        while first or self.text[self.at] != "]":
            first = False
            low = high = self.character()
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self.character()
            if low and high and ord(high) < 128:
                out |= {bytes([c]).lower() for c in range(ord(low), ord(high) + 1)}
            else:
                known = False
        self.at += 1
        return out if known and len(out) <= EXACT else None


def trigram_query(pattern: str) -> tuple:
    """What trigrams of lower-cased bytes a text must hold for pattern to match: a Boolean query, or ALL."""
    return _Expression(pattern).branches()[1]


def grams_of(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "gram" else set().union(*map(grams_of, query[1])) if query[0] != "all" else set()


class Index:
    """Postings of the asked trigrams over texts laid end to end: sorted text numbers by trigram."""

    def __init__(self, asked: list[bytes]):
        self.number = {g: i for i, g in enumerate(asked)}
        own = sorted(set(b"".join(asked)))  # bytes of no asked trigram are one class, 0
        self.classes, self.base = np.zeros(256, np.uint32), np.uint32(len(own) + 1)
        self.classes[own] = np.arange(1, len(own) + 1)
        self.classes[65:91] = self.classes[97:123]
        self.table = np.zeros(int(self.base) ** 3, np.uint16)
        for g, i in self.number.items():
            a, b, c = self.classes[list(g)].tolist()
            self.table[(a * int(self.base) + b) * int(self.base) + c] = i + 1

    def build(self, buf: np.ndarray, off: np.ndarray) -> None:
        n, self.texts = len(off) - 1, len(off) - 1
        b = self.classes[buf]
        code = self.table[(b[:-2] * self.base + b[1:-1]) * self.base + b[2:]] if len(b) > 2 else np.zeros(0, np.uint16)
        at = np.flatnonzero(code)
        text = np.searchsorted(off, at, side="right") - 1
        inside = at + 3 <= off[text + 1]
        pairs = np.unique((code[at].astype(np.int64)[inside] - 1) * n + text[inside])
        self.ends = np.searchsorted(pairs, np.arange(len(self.number) + 1) * n)
        self.posting = pairs % max(1, n)

    def find(self, query: tuple) -> np.ndarray:
        """The texts that answer the query, in order."""
        if query[0] == "all":
            return np.arange(self.texts)
        if query[0] == "gram":
            i = self.number[query[1]]
            return self.posting[self.ends[i] : self.ends[i + 1]]
        parts = sorted((self.find(q) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def _matches(rule: Rule, text: str, find: re.Pattern) -> list[tuple[int, int]]:
    return [m.span(rule.found) for m in find.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "secrets") -> DataFrame:
    """docs (text and others) with one more column: array of (kind, start, end) in code points, by start then rule.

    Each run of texts gets an inverted index of the trigrams that the rules' queries name; a rule's postings are
    intersected and united as its query says, and its expression run over the candidates alone. Rules without
    mandatory trigrams run over every whole text. The index only prunes and ends with its run of texts; what it lets
    through is verified. No shuffle; a column of the name is replaced. Null and empty
    texts hold none; repeated rows are scanned each on its own; empty tables stay empty.
    """
    keep = [c for c in docs.columns if c != column]
    d = docs.select(*keep)
    queries = [trigram_query(r.pattern) for r in rules]
    asked = sorted(set().union(*map(grams_of, queries)))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(asked)
        finds = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.fold else 0)) for r in rules]
        for b in batches:
            found: list[list] = [[] for _ in range(b.num_rows)]
            for lo, hi, buf, off in text_chunks(b.column("text")):
                index.build(buf, off)
                texts = b.column("text").slice(lo, hi - lo).to_pylist()  # a run's at a time
                for i, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                    for k in index.find(query):
                        if texts[k]:
                            found[lo + k] += [(s, i, e) for s, e in _matches(rule, texts[k], finds[i])]
            rows = [[{"kind": rules[i].kind, "start": s, "end": e} for s, i, e in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], [*keep, column])

    return d.mapInArrow(run, with_fields(d.schema, **{column: "array<struct<kind:string,start:bigint,end:bigint>>"}))


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret in text replaced by [SECRET], overlapping ones by one; n_chars, if there, follows.

    Rows and columns stay, one named secrets too; null texts stay null. See find_secrets.
    """
    found, spans = free_names(docs, "found", "spans")
    merged = F.aggregate(
        found,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    d = find_secrets(docs, rules, found).withColumn(spans, merged)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
    cut = F.transform(spans, lambda m, i: F.substr(F.col("text"), (before(i) + 1).cast("int"), (m["start"] - before(i)).cast("int")))
    tail = F.substr(F.col("text"), (F.element_at(spans, -1)["end"] + 1).cast("int"))
    d = d.withColumn("text", F.when(F.size(spans) > 0, F.concat(F.array_join(cut, "[SECRET]"), F.lit("[SECRET]"), tail)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = F.when(F.size(spans) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        d = d.withColumn("n_chars", changed)
    return d.select(*docs.columns)


def op5_secret_scans(docs: DataFrame) -> DataFrame:
    """The digest of find_secrets: one row per document."""
    say = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE_KINDS))
    of = lambda k: F.filter("secrets", lambda x: x["kind"] == k)
    count = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return find_secrets(docs.select("doc_id", "text")).select(
        "doc_id", *count, F.sha2(F.array_join(F.transform(base, say), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("secrets", say), ",").alias("spans"),
    )

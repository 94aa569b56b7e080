"""Operator 6: chat formatting by columnar byte assembly, with a loss mask and a reader of its own output."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: Whose words a model learns to say.
SPEAKER = "assistant"
#: A conversation is cut, between turns, into pieces of about so many bytes; hardly any reaches it.
PIECE_BYTES = 1 << 20
#: Formatted bytes that are assembled at once, or one turn.
CHUNK_BYTES = 4 << 20
#: Longer segments are copied whole rather than byte by byte through an index.
LONG = 1 << 16
FORMATTED = "piece bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"
_HEAD = np.frombuffer((TURN + BODY + END).encode(), np.uint8)
_SIZES = [len(x) for x in (TURN, BODY, END)]
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.S)


def escape(texts: pa.Array) -> pa.Array:
    r"""Texts without any control string: <| becomes <\|, and one more \ goes where there are some already."""
    return pc.replace_substring_regex(pc.fill_null(texts, ""), pattern=r"<(\\*)\|", replacement=r"<\\\1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, as views of its buffers."""
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = a.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """(the formatted turns end to end in one buffer, the start of each of a turn's five segments and the whole's end).

    A turn is TURN, role, BODY, text, END; all segments of all turns are copied at once.
    """
    n = len(roles)
    (role, r_off), (text, t_off) = _bytes(roles), _bytes(texts)
    source = np.concatenate([_HEAD, role, text])
    size, start = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for j, (length, at) in enumerate(((_SIZES[0], 0), (np.diff(r_off), len(_HEAD) + r_off[:-1]), (_SIZES[1], _SIZES[0]), (np.diff(t_off), len(_HEAD) + len(role) + t_off[:-1]), (_SIZES[2], _SIZES[0] + _SIZES[1]))):
        size[:, j], start[:, j] = length, at
    size, start = size.ravel(), start.ravel()
    to = np.zeros(5 * n + 1, np.int64)
    np.cumsum(size, out=to[1:])
    out = pa.allocate_buffer(int(to[-1]))
    view = np.frombuffer(out, np.uint8)
    short = np.where(size < LONG, size, 0)
    ends = np.cumsum(short)
    step = np.arange(ends[-1] if n else 0) - np.repeat(ends - short, short)
    view[np.repeat(to[:-1], short) + step] = source[np.repeat(start, short) + step]
    for i in np.flatnonzero(size >= LONG):
        view[to[i] : to[i + 1]] = source[start[i] : start[i] + size[i]]
    return out, to


class _Conversations:
    """Cuts turns that come in order of their conversations into pieces; keeps the last, unfinished one back."""

    def __init__(self, names: list[str], piece_bytes: int):
        self.names, self.piece_bytes, self.kept, self.base = names, piece_bytes, None, 0

    def feed(self, batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables([pa.Table.from_batches([x]) for x in (self.kept, batch) if x is not None]) if self.kept is not None or batch is not None else None
        self.kept = None
        if t is None or not t.num_rows:
            return
        b = t.combine_chunks().to_batches()[0]
        key, role, text = b.column("conv_id"), escape(b.column("role")), escape(b.column("text"))
        length = np.diff(_bytes(role)[1]) + np.diff(_bytes(text)[1]) + sum(_SIZES)
        first = np.ones(b.num_rows, bool)
        a, c = key.slice(1), key.slice(0, len(key) - 1)
        first[1:] = ~pc.fill_null(pc.equal(a, c), False).to_numpy(zero_copy_only=False) & ~pc.and_(pc.is_null(a), pc.is_null(c)).to_numpy(zero_copy_only=False)
        conv = np.cumsum(first) - 1
        before = np.cumsum(length) - length
        offset = before - before[first][conv] + np.where(conv == 0, self.base, 0)
        piece = offset // self.piece_bytes
        new = first.copy()
        new[1:] |= piece[1:] != piece[:-1]
        starts = np.flatnonzero(new)
        if batch is not None:  # what follows may belong to the last piece
            self.kept, self.base = b.slice(starts[-1]), int(offset[starts[-1]])
            starts, stop = starts[:-1], int(starts[-1])
        else:
            stop = b.num_rows
        while len(starts):
            k = max(1, int(np.searchsorted(np.append(before[starts[1:]], before[stop - 1] + length[stop - 1]), before[starts[0]] + CHUNK_BYTES, side="right")))
            end = int(starts[k]) if k < len(starts) else stop
            yield self._emit(key, role.slice(starts[0], end - starts[0]), text.slice(starts[0], end - starts[0]), starts[:k], end, piece)
            starts = starts[k:]

    def _emit(self, key: pa.Array, role: pa.Array, text: pa.Array, starts: np.ndarray, end: int, piece: np.ndarray) -> pa.RecordBatch:
        out, to = assemble(role, text)
        row = np.append(starts, end) - starts[0]
        bounds = to[5 * row]
        said = np.flatnonzero(pc.equal(role, SPEAKER).to_numpy(zero_copy_only=False))
        of = np.searchsorted(row, said, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(to[5 * said + 3] - bounds[of]), pa.array(to[5 * said + 4] - bounds[of])], ["start", "end"])
        loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(said, row).astype(np.int32)), spans)
        text = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int32)), out)
        return pa.RecordBatch.from_arrays([key.take(pa.array(starts)), pa.array(piece[starts]), text, loss], self.names)


def format_chat(conversations: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as (conv_id, piece, formatted, loss: byte spans of formatted).

    Turns go by turn (null first), then role and text where turns tie; repeated rows are repeated turns. Null role and
    text are empty. The loss mask covers the escaped texts of SPEAKER alone. A null conv_id is a conversation of its
    own; an empty table gives no rows; other columns are not looked at. One shuffle by conv_id and a sort; a task
    holds a batch and a piece, never a conversation, so one of any length passes through.
    """
    c = conversations.select("conv_id", F.col("turn").alias("__turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    c = c.repartition("conv_id").sortWithinPartitions("conv_id", "__turn", "role", "text").select("conv_id", "role", "text")
    names = ["conv_id", "piece", "formatted", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Conversations(names, piece_bytes)
        for b in batches:
            yield from cutter.feed(b)
        yield from cutter.feed(None)

    return c.mapInArrow(run, f"conv_id {dict(c.dtypes)['conv_id']}, {FORMATTED}")


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted piece."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What format_chat wrote, read back: a row per conversation with its turns' and its loss mask's digests.

    Pieces of a conversation must follow one another in a partition, as format_chat leaves them; hashes are carried
    from piece to piece, so no conversation is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types: list[pa.DataType] = []
        rows: list[list] = []
        open_: list | None = None

        def flush() -> pa.RecordBatch:
            done = [[r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]] for r in rows]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names)

        for b in batches:
            types = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for i in range(b.num_rows):
                key, text, loss = b.column("conv_id")[i].as_py(), b.column("formatted")[i].as_py(), b.column("loss")[i].as_py()
                if b.column("piece")[i].as_py() == 0 and open_:
                    rows.append(open_)
                if b.column("piece")[i].as_py() == 0 or open_ is None:
                    open_ = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse_chat(text)
                open_[1] += len(turns)
                open_[2].update("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass"))
                raw = text.encode("utf-8", "surrogatepass")
                masked = "".join(unescape(raw[s["start"] : s["end"]].decode("utf-8", "surrogatepass")) for s in loss)
                open_[3] += len(masked)
                open_[4].update(masked.encode("utf-8", "surrogatepass"))
                open_[5] += len(text)
                if len(rows) >= 2000:
                    yield flush()
        if open_:
            rows.append(open_)
        if rows:
            yield flush()

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op6_chat_formatting(conversations: DataFrame) -> DataFrame:
    """The digest of format_chat over conversations and one more, -7, that quotes control strings."""
    said = "</s>[INST] ok [/INST]"
    more = conversations.sparkSession.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_digests(format_chat(conversations.select("conv_id", "turn", "role", "text").unionByName(more)))

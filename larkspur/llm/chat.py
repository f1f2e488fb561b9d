"""Chat formatting by columnar assembly of bytes.

A turn is `<s>role[INST]text[/INST]</s>`. Inside roles and texts a backslash is doubled and a control string gets `\\-`
after its first character, so no text can open or close a turn, and unescaping gives it back. Segment lengths, their
cumulative offsets and scatter indices are computed in numpy for a batch of turns at once, and headers and contents are
copied into one preallocated buffer, which becomes the Arrow column.

Scale: one shuffle by conversation and a sort within partitions; rows stream through in turn order, so a task holds a
batch and at most one unfinished piece. A conversation of more than `PIECE` bytes is returned in several pieces, cut
between turns, and never held whole; its digests are streamed too.

Defined cases: a null text or role is empty; turns go by number, then role and text, null first; repeated rows are
turns of their own; a null id is one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common as c

OPEN, MIDDLE, CLOSE = b"<s>", b"[INST]", b"[/INST]</s>"
CONTROL = (r"<(</?SYS>>|/?s>)", r"\[(/?INST\])")  # first character, rest
PIECE = 8 << 20
_TURN = re.compile(rb"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.S)
_ESCAPED = re.compile(rb"\\([\\-])")


def escape(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(pc.fill_null(texts, ""), "\\", "\\\\")
    for first, pattern in zip("<[", CONTROL):
        texts = pc.replace_substring_regex(texts, pattern, rf"{first}\\-\1")
    return texts


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(lambda m: b"\\" if m[1] == b"\\" else b"", text) if b"\\" in text else text


def _scatter(out: np.ndarray, data: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> None:
    """Copy consecutive contents of the given lengths to their places."""
    shift = places - (np.cumsum(lengths) - lengths)
    out[np.arange(len(data)) + np.repeat(shift, lengths)] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer of all turns, turn offsets (turns + 1), and start and length of each text in the buffer."""
    (role_bytes, role_off), (text_bytes, text_off) = c.raw(escape(roles)), c.raw(escape(texts))
    role_len, text_len = np.diff(role_off), np.diff(text_off)
    n = len(role_len)
    lengths = np.stack([np.full(n, len(OPEN)), role_len, np.full(n, len(MIDDLE)), text_len, np.full(n, len(CLOSE))], 1)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    places = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for j, fixed in ((0, OPEN), (2, MIDDLE), (4, CLOSE)):
        out[places[:, j, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    _scatter(out, role_bytes, role_len, places[:, 1])
    _scatter(out, text_bytes, text_len, places[:, 3])
    return out, np.concatenate(([0], ends[:, -1])).astype(np.int64), places[:, 3], text_len


def _format(kind: pa.DataType, loss_role: str, piece_bytes: int):
    names = ["conv_id", "piece", "n_turns", "formatted", "loss_starts", "loss_lengths"]

    def build(rows: pa.RecordBatch, first_piece: int) -> tuple[pa.RecordBatch, int]:
        """Pieces of sorted turns; the first conversation goes on with the given piece number."""
        ids = rows.column(0)
        buf, off, start, length = assemble(rows.column(1), rows.column(2))
        n = len(rows)
        change = np.ones(n, bool)
        if n > 1:
            a, b = ids.slice(1), ids.slice(0, n - 1)
            same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
            change[1:] = ~same
        conv = np.cumsum(change) - 1
        number = (off[1:] - off[np.flatnonzero(change)][conv] - 1) // piece_bytes  # of the turn's last byte
        cut = change.copy()
        cut[1:] |= number[1:] != number[:-1]
        at = np.flatnonzero(cut)
        piece = np.arange(len(at)) - np.flatnonzero(change[at])[conv[at]]
        piece += np.where(conv[at] == 0, first_piece, 0)
        offsets = np.append(off[at], off[-1])
        loss = pc.fill_null(pc.equal(rows.column(1), loss_role), False).to_numpy(zero_copy_only=False)
        owner = np.cumsum(cut) - 1
        bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner[loss], minlength=len(at))))), pa.int32())
        text = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(buf))
        got = [ids.take(pa.array(at)), pa.array(piece, pa.int64()), pa.array(np.diff(np.append(at, n)), pa.int64()), text,
               pa.ListArray.from_arrays(bounds, pa.array(start[loss] - offsets[owner[loss]], pa.int64())), pa.ListArray.from_arrays(bounds, pa.array(length[loss], pa.int64()))]
        return pa.RecordBatch.from_arrays(got, names), int(piece[-1]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # turns of a conversation that may go on
        going, number = None, 0  # conversation that was cut before `held`, and the number of its next piece
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            ids = rows.column(0).to_pylist()
            last = len(rows)
            while last and ids[last - 1] == ids[-1]:
                last -= 1
            first = number if going is not None and going[0] == ids[0] else 0
            if last:
                yield build(rows.slice(0, last), first)[0]
                first, going = 0, None
            held = rows.slice(last)
            if c.raw(held.column(2))[1][-1] > piece_bytes:
                out, number = build(held, first)
                yield out
                going, held = (ids[-1],), None
        if held is not None:
            first = number if going is not None and going[0] == held.column(0)[0].as_py() else 0
            yield build(held, first)[0]

    return run


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         loss_role: str = "assistant", piece_bytes: int = PIECE) -> DataFrame:
    """Pieces in order within each partition: conv_id, piece, n_turns, formatted, and the loss mask as byte spans of it."""
    from pyspark.sql.pandas.types import to_arrow_type

    c.ship_package(turns.sparkSession)
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["conv_id"].dataType
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    got = placed.mapInArrow(_format(to_arrow_type(kind), loss_role, piece_bytes),
                            f"conv_id {kind.simpleString()}, piece long, n_turns long, formatted string, loss_starts array<long>, loss_lengths array<long>")
    return got.withColumnRenamed("conv_id", id_col)


class _Digest:
    def __init__(self, key):
        self.key, self.turns, self.loss_chars, self.chars = key, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: bytes, starts: list[int], lengths: list[int]) -> None:
        self.chars += len(formatted.decode())
        for role, text in _TURN.findall(formatted):
            self.turns += 1
            self.all.update(unescape(role) + b"\n" + unescape(text) + b"\n")
        for start, length in zip(starts, lengths):
            text = unescape(formatted[start:start + length])
            self.loss_chars += len(text.decode())
            self.loss.update(text)

    def row(self) -> tuple:
        return self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_back(kind: pa.DataType):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            buf, off = c.raw(batch.column(3))
            data = buf.tobytes()
            for i, (key, starts, lengths) in enumerate(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                if now is None or now.key != key:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(key)
                now.add(data[off[i]:off[i + 1]], starts, lengths)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*done), kinds)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now.row(), kinds)], names)

    return run


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted pieces as `format_conversations` returns them, unshuffled."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = formatted.schema["conv_id"].dataType
    return formatted.mapInArrow(_read_back(to_arrow_type(kind)),
                                f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    """op5: whole `conversations` and conversation -7, whose texts are control strings."""
    given = c.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return digests(format_conversations(given.unionByName(extra)))


_TURNS = f"""(select conv_id, turn, role, coalesce(text, '') text from conversations
 union all select -7, 0, 'user', '{CONTROL_TEXT}' union all select -7, 1, 'assistant', '{CONTROL_TEXT}')"""
_ESCAPE = r"regexp_replace(regexp_replace(replace({}, '\', '\\'), '<(</?SYS>>|/?s>)', '<\\-\1', 'g'), '\[(/?INST\])', '[\\-\1', 'g')"
ORACLE = f"""
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) loss_sha256,
       sum(20 + length({_ESCAPE.format("role")}) + length({_ESCAPE.format("text")}))::bigint formatted_chars
from {_TURNS} group by conv_id
"""

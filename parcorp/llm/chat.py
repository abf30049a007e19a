"""Chat formatting at token level, with reversible escapes and a loss mask."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcorp.llm.common import with_package, written

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How the public byte-level vocabulary splits text, and its own control string
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = "<|endoftext|>"
# The template: reserved ids follow the vocabulary's, in this order
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]"]
BEGIN, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END = range(len(CONTROL))

BUCKET_TURNS = 1024
_STRINGS = re.compile(
    r"(?P<a>[<\[])(?P<n>\\*)(?P<b>" + "|".join(sorted({re.escape(c[1:]) for c in [*CONTROL, END_OF_TEXT]})) + ")")


def escape(text: str) -> str:
    r"""Put a backslash behind the first character of every control string.

    Strings that already look escaped get one more: `<s>`, `<\s>`, `<\\s>` become `<\s>`,
    `<\\s>`, `<\\\s>`, so that nothing is lost and no control string is left.
    """
    return _STRINGS.sub(lambda m: f"{m['a']}\\{m['n']}{m['b']}", text)


def unescape(text: str) -> str:
    return _STRINGS.sub(lambda m: f"{m['a']}{m['n'][1:]}{m['b']}", text)


@functools.lru_cache(maxsize=4)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.splitlines() if line)
    table = {base64.b64decode(token): int(rank) for token, rank in pairs}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def first_reserved(ranks: bytes) -> int:
    return 1 + max(int(line.split()[1]) for line in ranks.splitlines() if line) + 1  # one free id is skipped


def turn_tokens(enc: tiktoken.Encoding, base: int, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss) of one turn: its segments are encoded separately, reserved ids spliced in.

    user: [INST] text [/INST]; system: [SYS] text [/SYS]; assistant: text </s>; any other
    role: [ROLE] role [/ROLE] text </s>. The mask is the prefix sum of a mark where an
    assistant's text begins and its opposite where it ends.
    """
    body = enc.encode_ordinary(escape(text))
    if role == "user":
        before, after = [base + USER], [base + USER_END]
    elif role == "system":
        before, after = [base + SYSTEM], [base + SYSTEM_END]
    elif role == "assistant":
        before, after = [], [base + END]
    else:
        before = [base + ROLE, *enc.encode_ordinary(escape(role)), base + ROLE_END]
        after = [base + END]
    ids = np.array([*before, *body, *after], np.int32)
    marks = np.zeros(len(ids) + 1, np.int8)
    if role == "assistant":
        marks[len(before)] += 1
        marks[len(before) + len(body)] -= 1
    return ids, np.cumsum(marks[:-1], dtype=np.int8)


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text", ranks: str = RANKS) -> DataFrame:
    """(conv_id, turn_no, at, ids, loss): token ids and loss mask of every turn, and where
    in its conversation they begin. The first turn also holds the opening <s>.

    Rows of a conversation are ordered by turn (nulls first), ties by role and a digest of
    the text; rows without an id make up one conversation. Null roles and texts count as
    empty. A conversation is as many rows as it has turns, so none grows beyond its longest
    text. Places are prefix sums in two levels (buckets of 1024 turn numbers, then within a
    bucket), so that no task sums a conversation that holds a large part of all rows. An
    empty table gives no rows.
    """
    with_package(turns.sparkSession)
    with open(ranks, "rb") as f:  # once, on the driver; tasks get the ranks with the code
        data = f.read()
    base = first_reserved(data)
    rows = turns.select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.md5("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(data)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                coded = [turn_tokens(enc, base, r.as_py(), t.as_py()) for r, t in zip(part.column(2), part.column(3))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), part.column(4),
                     pa.array([a for a, _ in coded], pa.list_(pa.int32())),
                     pa.array([b for _, b in coded], pa.list_(pa.int8()))],
                    ["conv_id", "turn", "role", "tie", "ids", "loss"])

    coded = rows.mapInArrow(
        encode, "conv_id bigint, turn bigint, role string, tie string, ids array<int>, loss array<tinyint>")
    coded = written(coded, "chat-turns")  # read for the sums and for the rows
    coded = coded.withColumn("b", F.floor(F.coalesce("turn", F.lit(-(2**62))) / BUCKET_TURNS))
    coded = coded.withColumn("size", F.size("ids").cast("bigint"))

    sums = coded.groupBy("conv_id", "b").agg(F.sum("size").alias("s"), F.count("*").alias("c"))
    before = W.partitionBy("conv_id").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv_id").alias("c_"), F.col("b").alias("b_"),
        F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s_"),
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("n_"))
    inner = W.partitionBy("conv_id", "b").orderBy("turn", "role", "tie")
    ranked = coded.withColumn("i", F.row_number().over(inner) - 1).withColumn(
        "at", F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    ranked = ranked.join(sums, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("b") == F.col("b_")))
    first = F.col("turn_no") == 0
    return ranked.withColumn("turn_no", F.col("n_") + F.col("i")).select(
        "conv_id", "turn_no",
        F.when(first, F.lit(0)).otherwise(F.col("at") + F.col("s_") + 1).cast("bigint").alias("at"),
        F.when(first, F.concat(F.array(F.lit(base + BEGIN)), "ids")).otherwise(F.col("ids")).alias("ids"),
        F.when(first, F.concat(F.array(F.lit(0).cast("tinyint")), "loss")).otherwise(F.col("loss")).alias("loss"))


class Reader:
    """What a conversation's tokens say, read in order, a piece at a time."""

    def __init__(self, enc: tiktoken.Encoding, base: int) -> None:
        self.enc, self.base = enc, base
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.size = 0

    def add(self, at: int, ids: np.ndarray, loss: np.ndarray) -> None:
        if at != self.size:
            raise ValueError(f"tokens missing: {self.size} read, next at {at}")
        self.size += len(ids)
        role, kind = "assistant", None
        start = 0
        for stop in [*np.flatnonzero(ids >= self.base).tolist(), len(ids)]:
            raw = self.enc.decode_bytes(ids[start:stop].tolist()).decode("utf-8", "surrogatepass")
            self.chars += len(raw)
            if stop == len(ids):
                break
            kind = int(ids[stop]) - self.base
            self.chars += len(CONTROL[kind])
            start = stop + 1
            if kind == ROLE_END:
                role = unescape(raw)
            elif kind in (USER_END, SYSTEM_END, END):
                role = {USER_END: "user", SYSTEM_END: "system", END: role}[kind]
                text = unescape(raw)
                self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                self.n_turns += 1
                role = "assistant"
        edges = np.flatnonzero(np.diff(np.concatenate([[0], loss, [0]])))
        for a, b in zip(edges[::2], edges[1::2]):
            text = unescape(self.enc.decode_bytes(ids[a:b].tolist()).decode("utf-8", "surrogatepass"))
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)


def read_back(tokens: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the
    rows of `formatted`. A conversation streams through one task in order of its tokens (a
    digest needs them in order), a turn at a time, and is never held as a whole."""
    with open(ranks, "rb") as f:
        data = f.read()
    base = first_reserved(data)
    width = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tokens.select("conv_id", "at", "ids", "loss").repartition(width, "conv_id").sortWithinPartitions("conv_id", "at")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, now, state, out = encoding(data), None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def close() -> None:
            out.append((now, state.n_turns, state.turns.hexdigest(), state.loss_chars,
                        state.loss.hexdigest(), state.chars))

        for batch in batches:
            ids, loss = batch.column(2), batch.column(3)
            for conv, at, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids, loss):
                if state is None or conv != now:
                    if state is not None:
                        close()
                    now, state = conv, Reader(enc, base)
                state.add(at, a.values.to_numpy(), b.values.to_numpy())
            yield flush()
            out.clear()
        if state is not None:
            close()
        yield flush()

    return rows.mapInArrow(
        scan, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
              "loss_sha256 string, formatted_chars bigint")

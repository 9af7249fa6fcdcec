"""Chat formatting (operator 3): budgeted, turn-aligned windows with a loss mask.

A window's budget holds its own turns, the conversation's opening system turn and repeated history.
What is left for own turns is halved: a turn of more than one half is a window of its own, and runs of
shorter turns between such are cut where their prefix sums of tokens pass a multiple of the other
half, so that the last turn of a window never takes it beyond the budget. Every window is thus found
from prefix sums alone, without walking a conversation. History are the turns at the end of the window
before, as many as the history budget and the window's room allow; repeated turns are masked. Prefix
sums over a conversation of any length use its range-partitioned pieces and one total per piece.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from shipshape.llm.common import batches, partitions, written

WINDOW_TOKENS, HISTORY_TOKENS, TURN_TOKENS = 512, 128, 4
BEGIN, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _RESTORE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No control string survives: every ``<``, backslashes, ``|`` gets one backslash more."""
    return _ESCAPE.sub(r"<\1\\|", text)


def restore(text: str) -> str:
    return _RESTORE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def restore_role(role: str) -> str:
    return restore(role).replace("%0A", "\n").replace("%25", "%")


def render(turns) -> tuple[str, list[int]]:
    """Text of a window and its loss spans, flat (start, end, ...): own assistant texts."""
    out, at, loss = [], 0, []
    for role, text, own in turns:
        head, body = f"{BEGIN}{escape_role(role)}\n", escape(text)
        if own and role == "assistant":
            loss += [at + len(head), at + len(head) + len(body)]
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), loss


def parse(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the text in the window) of each turn."""
    out, at = [], 0
    while at < len(window):
        line = window.index("\n", at)
        stop = window.index(END, line + 1)
        out.append((restore_role(window[at + len(BEGIN):line]), restore(window[line + 1:stop]), line + 1, stop))
        at = stop + len(END) + 1
    return out


def _numbered(it):
    """Tokens and long turns before each turn within its conversation and this partition."""
    part, now, total, longs = TaskContext.get().partitionId(), object(), 0, 0
    for b in it:
        before, runs = [], []
        for conv, n, long in zip(b.column("conv").to_pylist(), b.column("tokens").to_pylist(), b.column("long").to_pylist()):
            if conv != now:
                now, total, longs = conv, 0, 0
            before.append(total)
            runs.append(longs)
            total, longs = total + n, longs + long
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names), pa.array([part] * len(before), pa.int32()), pa.array(before, pa.int64()), pa.array(runs, pa.int64())],
                                         names=[*b.schema.names, "part", "before", "run"])


def _rendered(it):
    for b in it:
        made = [render([(t["role"], t["text"], t["own"]) for t in turns]) for turns in b.column("turns").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("window"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.int32())), b.column("repeated"), b.column("tokens")],
                                         names=["conv", "window", "formatted", "loss", "repeated", "tokens"])


def windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
            budget: int = WINDOW_TOKENS, history: int = HISTORY_TOKENS) -> DataFrame:
    """conv, window, formatted, loss (flat spans), repeated (turns at the front that are repeats), tokens.

    ``window`` is the number of the conversation's tokens before the window's own turns. No window has
    more than ``budget`` tokens, unless one own turn with the system turn has. Null texts and roles
    count as empty. Turns of one number stand by role, then text; null numbers come first; rows of a
    null conversation form one. Repeated rows are turns of their own. An empty table gives no windows.
    Other columns of the input, whatever their names, take no part.
    """
    spark = turns.sparkSession
    batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), text.alias("text"),
                        (F.regexp_count(text, F.lit(r"\w+|[^\w\s]+")) + TURN_TOKENS).cast("long").alias("tokens"), F.xxhash64(text).alias("tie"))
    kinds = dict(rows.dtypes)
    opening = rows.groupBy("conv", "turn", "role").agg(F.max("tokens").alias("n")).groupBy("conv").agg(F.min(F.struct("turn", "role", "n")).alias("f")).where("f.role = 'system'")
    opening = opening.select(F.col("conv").alias("c1"), F.col("f.n").alias("system"))
    half = F.floor(F.greatest(F.lit(budget - history) - F.col("system"), F.lit(2)) / 2)
    rows = rows.join(opening, F.col("conv").eqNullSafe(F.col("c1")), "left").drop("c1").withColumn("system", F.coalesce("system", F.lit(0)).cast("long"))
    rows = rows.withColumn("half", half.cast("long")).withColumn("long", (F.col("tokens") > F.col("half")).cast("int"))
    placed = rows.repartitionByRange(partitions(spark), "conv", "turn", "role", "tie").sortWithinPartitions("conv", "turn", "role", "text")
    placed = written(placed.mapInArrow(_numbered, ", ".join(f"{c} {k}" for c, k in rows.dtypes) + ", part int, before long, run long"))
    # a conversation continues into later partitions only as their first: one total per conversation and partition, of those that span several
    sums = placed.groupBy("conv", "part").agg(F.sum("tokens").alias("s"), F.sum("long").alias("l"))
    over = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv").alias("c2"), F.col("part").alias("p2"), F.sum("s").over(over).alias("carry"), F.sum("l").over(over).alias("carry_run")).where("carry is not null")
    placed = placed.join(sums, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("part") == F.col("p2")), "left").withColumn(
        "before", F.col("before") + F.coalesce("carry", F.lit(0))).withColumn("run", F.col("run") + F.coalesce("carry_run", F.lit(0)))
    cell = F.when(F.col("long") == 1, F.lit(-1)).otherwise(F.floor(F.col("before") / F.col("half"))).cast("long")
    placed = written(placed.select("conv", "role", "text", "before", "tokens", "system", "run", cell.alias("cell")))
    end = F.col("before") + F.col("tokens")
    spans = written(placed.groupBy(F.col("conv").alias("c4"), F.col("run").alias("r4"), F.col("cell").alias("k4")).agg(
        F.min("before").alias("window"), F.max(end).alias("stop"), F.sum("tokens").alias("own_tokens")))
    placed = placed.join(spans, F.col("conv").eqNullSafe(F.col("c4")) & (F.col("run") == F.col("r4")) & (F.col("cell") == F.col("k4"))).drop("c4", "r4", "k4")
    opens = (F.col("before") == 0) & (F.col("role") == "system")
    first = placed.where(opens).select(F.col("conv").alias("c3"), F.col("text").alias("s3"), F.col("tokens").alias("n3"))
    after = spans.select(F.col("c4").alias("c5"), F.col("window").alias("next"), F.col("own_tokens").alias("next_tokens"))
    room = F.least(F.lit(history), F.lit(budget) - F.col("system") - F.col("next_tokens"))
    again = placed.where(~opens & (F.col("stop") - F.col("before") <= history)).join(after, F.col("conv").eqNullSafe(F.col("c5")) & (F.col("stop") == F.col("next"))).where(
        F.col("stop") - F.col("before") <= room)
    kept, mine = F.lit(False).alias("own"), F.lit(True).alias("own")
    front = spans.where("window > 0").join(first, F.col("c4").eqNullSafe(F.col("c3"))).select(F.col("c4").alias("conv"), "window", F.lit(-1).cast("long").alias("before"), F.lit("system").alias("role"), F.col("s3").alias("text"), kept, "n3")
    both = placed.select("conv", "window", "before", "role", "text", mine, "tokens").union(again.select("conv", "next", "before", "role", "text", kept, "tokens")).union(front)
    # a window's turns are few: each has TURN_TOKENS tokens or more
    held = both.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("before", "role", "text", "own"))).alias("turns"), F.sum((~F.col("own")).cast("int")).alias("repeated"), F.sum("tokens").alias("tokens"))
    return held.select("conv", "window", "turns", "repeated", "tokens").mapInArrow(_rendered, f"conv {kinds['conv']}, window long, formatted string, loss array<int>, repeated long, tokens long")


def _read_back(it):
    """Partitions sorted by conversation and window: digests of one conversation at a time, as a stream."""
    now, state, names = object(), None, ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def close(out):
        if state:
            out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    kind = None
    for b in it:
        out, kind = [], b.schema.field("conv").type
        for conv, text, loss, repeated in zip(*(b.column(c).to_pylist() for c in ("conv", "formatted", "loss", "repeated"))):
            if state is None or conv != now:
                close(out)
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, turn, _, _ in parse(text)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{turn}\n".encode())
            for s, e in zip(loss[::2], loss[1::2]):
                target = restore(text[s:e])
                state[2] += len(target)
                state[3].update(target.encode())
            state[4] += len(text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)
    out = []
    close(out)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its windows hold: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a whole conversation is sequential, so its windows pass through one task as a stream.
    """
    kind = dict(formatted.dtypes)["conv"]
    return formatted.repartition(partitions(formatted.sparkSession), "conv").sortWithinPartitions("conv", "window").mapInArrow(
        _read_back, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

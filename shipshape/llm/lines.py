"""Substring dedup (operator 5): repeated lines or paragraphs, the earliest occurrence kept.

Units are cut at line breaks (or blank lines) and normalised (A-Z lower-cased, runs of white space
one space, none at the ends). Their 128-bit digests are grouped globally; of each digest the
occurrence that ranks first (smallest id, then place) stays and the others are repeats. Short lines
are repeated by chance, so a repeat goes only as part of a run: adjacent repeats whose kept units
are adjacent too, of at least ``run`` words together. All offsets are those of the original text.

A passage that another document holds with other line breaks, or inside its lines, has few whole
units in common with it or none. For these, digests are also taken of runs of words wherever they
begin (``passages``), and grouped in the same way.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shipshape.llm.common import _SPACE, batches, mix, string_bytes, tidy, word_hashes, word_starts, written

#: Units of fewer words are not judged, and runs of fewer words stay, unless the caller says otherwise.
LEAST_WORDS = 1
RUN_WORDS = 13
#: A run of so many words in two documents is found wherever it stands in them.
PASSAGE_WORDS = 50
#: A digest in this share of all units is frequent: it is sent to every task, so its units aren't dealt by it.
FREQUENT = 0.0001
_CUT = {"line": re.compile(r"[^\n]+"), "paragraph": re.compile(r"(?:(?!\n[\x20\t]*\n)[\s\S])+")}
_LOWER = {i: i + 32 for i in range(65, 91)}


def units(text: str, unit: str = "line", least: int = LEAST_WORDS):
    """(start, end, words, digest) of the units of a text; code points, end exclusive."""
    for m in _CUT[unit].finditer(text):
        words = m[0].translate(_LOWER).split()
        if len(words) >= least:
            yield m.start(), m.end(), len(words), hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _units(unit: str, least: int):
    def run(it):
        for b in it:
            rows = [(i, h, k, *u) for i, h, t in zip(b.column("id").to_pylist(), b.column("t").to_pylist(), b.column("text").to_pylist()) for k, u in enumerate(units(t or "", unit, least))]
            if rows:
                ids, h, k, s, e, n, d = zip(*rows)
                two = np.frombuffer(b"".join(d), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("id").type), *(pa.array(c, pa.int64()) for c in (h, k, s, e, n)), pa.array(two[:, 0]), pa.array(two[:, 1])],
                                                 names=["id", "t", "k", "start", "end", "words", "d1", "d2"])
    return tidy(run)


def _with_kept(found: DataFrame, place, repeated) -> DataFrame:
    """``found`` with the least place of its digest, for digests whose least and greatest place (``kept``, ``other``) are ``repeated``."""
    kept = found.groupBy("d1", "d2").agg(F.min(place).alias("kept"), F.max(place).alias("other"), F.count("*").alias("n")).where(repeated)
    kept = written(kept.select("d1", "d2", "kept", "n"))
    often = F.col("n") >= max(1000, FREQUENT * found.count())  # at most 1 / FREQUENT digests
    hot, rest = kept.where(often).drop("n"), kept.where(~often).drop("n")
    # one row that is no digest: without frequent digests the plan stays as it is with some
    sent = F.broadcast(hot.select("d1", "d2").union(found.sparkSession.range(1).select(F.col("id").alias("d1"), F.col("id").alias("d2"))))
    return found.join(F.broadcast(hot), ["d1", "d2"]).union(found.join(sent, ["d1", "d2"], "left_anti").join(rest, ["d1", "d2"]))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", least: int = LEAST_WORDS, run: int = RUN_WORDS) -> DataFrame:
    """(id, start, end, kept_id, kept_start, kept_end) of every unit to be removed.

    ``run`` = 0 removes every repeat, whatever stands beside it. Null and empty texts have no units.
    Of rows that repeat an id the same places repeat: they count as one occurrence and are removed,
    or kept, together. Rows with a null id rank last. An empty table gives no rows.
    """
    batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").alias("text"))
    kind = dict(base.dtypes)["id"]
    found = written(base.mapInArrow(_units(unit, least), f"id {kind}, t long, k long, start long, end long, words long, d1 long, d2 long"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "start", "end", "t", "k")
    both = _with_kept(found, place, ~F.struct("kept.id", "kept.start").eqNullSafe(F.struct("other.id", "other.start")))
    both = both.where(~(F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("start") == F.col("kept.start"))))
    if run > 0:
        # repeats of one document and one kept text that stand at the same distance; a run ends where a unit is left out
        side = ["id", "t", F.col("kept.id"), F.col("kept.t"), F.col("k") - F.col("kept.k")]
        both = both.distinct().withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy(*side).orderBy("k")))
        both = both.withColumn("of_run", F.sum("words").over(Window.partitionBy(*side, "run"))).where(F.col("of_run") >= run)
    return both.select("id", "start", "end", F.col("kept.id").alias("kept_id"), F.col("kept.start").alias("kept_start"), F.col("kept.end").alias("kept_end")).distinct()


_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def anchors(col, words: int):
    """(row, w, start, end, d1, d2) of chosen runs of ``size`` words: the row, the first word's number, code points, the digest.

    Of every ``words - size + 1`` runs in sequence the one of least digest is chosen (winnowing), so
    two texts that share ``words`` words in sequence share a chosen run, and neighbours in it overlap.
    Of equal digests in sequence only the first is.
    """
    size = (words + 2) // 2
    span = words - size + 1
    raw, off = string_bytes(col)
    h, woff = word_hashes(col)
    n = len(h) - size + 1
    if n < span:
        return [np.zeros(0, np.int64)] * 6
    d = []
    for base in _BASES:
        sums_ = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(base)) * _powers(base, len(h)), dtype=np.uint64)])
        d.append(mix((sums_[size:] - sums_[:-size]) * _powers(pow(base, -1, 1 << 64), n)))
    row = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    low, width = d[0], 1
    while width < span:
        step = min(width, span - width)
        low, width = np.minimum(low[:len(low) - step], low[step:]), width + step
    inside = row[:len(low)] == row[words - 1:]  # windows of one row
    high = np.where(inside, low, np.uint64(0))  # the greatest least digest of the windows that hold a run: its own, where it is chosen
    padded = np.concatenate([np.zeros(span - 1, np.uint64), high, np.zeros(span - 1, np.uint64)])
    width = 1
    while width < span:
        step = min(width, span - width)
        padded, width = np.maximum(padded[:len(padded) - step], padded[step:]), width + step
    chosen = padded == d[0]
    again = np.zeros(n, bool)  # a text that repeats itself: equal digests in sequence
    again[1:] = chosen[1:] & chosen[:-1] & (d[0][1:] == d[0][:-1]) & (row[1:n] == row[:n - 1])
    place = np.arange(n)
    chosen &= (place - np.maximum.accumulate(np.where(again, 0, place))) % size == 0
    at = np.flatnonzero(chosen)
    starts = np.append(word_starts(raw, off), len(raw))
    held = np.maximum.accumulate(np.where(_SPACE[raw], 0, np.arange(1, len(raw) + 1)))  # end of the last byte that isn't white space
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    first = points[off[row[at]]]
    ends = held[np.minimum(starts[at + size], off[row[at] + 1]) - 1]
    return row[at], at - woff[row[at]], points[starts[at]] - first, points[ends] - first, d[0][at].view(np.int64), d[1][at].view(np.int64)


def _anchors(words: int):
    def run(it):
        for b in it:
            row, *cells = anchors(b.column("text"), words)
            if len(row):
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), b.column("t").take(pa.array(row)), *map(pa.array, cells)], names=["id", "t", "w", "start", "end", "d1", "d2"])
    return tidy(run)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """(id, start, end, kept_id, kept_start, kept_end) of runs of words that another, earlier document holds, wherever they stand in either.

    Every run of ``words`` words (A-Z lower-cased, whatever white space between) that a document shares
    with another is found, by the part of it that chosen runs of words // 2 + 1 cover; shorter ones down to that may be. The first document (smallest id)
    keeps its own. Rows that repeat id and text count as one; null ids rank last.
    """
    batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    kind = dict(base.dtypes)["id"]
    found = written(base.mapInArrow(_anchors(words), f"id {kind}, t long, w long, start long, end long, d1 long, d2 long"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "t", "w", "start", "end")
    both = _with_kept(found, place, ~F.struct("kept.id", "kept.t").eqNullSafe(F.struct("other.id", "other.t")))
    both = both.where(~(F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("t") == F.col("kept.t")))).distinct()
    # chosen runs that stand at the same distance in both and overlap or touch are one passage
    side = ["id", "t", F.col("kept.id").alias("kept_id"), F.col("kept.t").alias("kept_t"), (F.col("w") - F.col("kept.w")).alias("by")]
    both = both.select(*side, "w", "start", "end", F.col("kept.start").alias("kept_start"), F.col("kept.end").alias("kept_end"))
    at = Window.partitionBy("id", "t", "kept_id", "kept_t", "by").orderBy("w")
    begins = F.coalesce(F.col("w") - F.lag("w").over(at) > (words + 2) // 2, F.lit(True))
    both = both.withColumn("begins", begins.cast("int")).withColumn("part", F.sum("begins").over(at))
    return both.groupBy("id", "t", "kept_id", "kept_t", "by", "part").agg(*(f(c).alias(c) for f, c in ((F.min, "start"), (F.max, "end"), (F.min, "kept_start"), (F.max, "kept_end")))).select(
        "id", "start", "end", "kept_id", "kept_start", "kept_end").distinct()


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", least: int = LEAST_WORDS, run: int = RUN_WORDS, words: int = 0) -> DataFrame:
    """Per document that loses a unit, or keeps one for other places: id, n_removed, removed_chars, spans, n_kept, kept.

    ``spans`` are its removed units (start, end, kept_id, kept_start), ``kept`` the units it keeps
    (start, end, places removed elsewhere), both by start. With ``words`` the ``passages`` of so many
    words are removed and kept too, in the columns n_passages, passages, n_passages_kept and
    passages_kept; ``removed_chars`` counts what any span covers once.
    """
    found = [repeats(docs, id_col, text_col, unit, least, run)] + ([passages(docs, id_col, text_col, words)] if words else [])
    both = None
    for of, part in enumerate(found):
        part = written(part)
        lost = part.select("id", "start", "end", "kept_id", "kept_start", F.lit(None).cast("long").alias("places"))
        held = part.groupBy(F.col("kept_id").alias("id"), F.col("kept_start").alias("start"), F.col("kept_end").alias("end")).agg(F.count("*").alias("places")).select(
            "id", "start", "end", F.lit(None).cast(dict(part.dtypes)["kept_id"]).alias("kept_id"), F.lit(None).cast("long").alias("kept_start"), "places")
        part = lost.union(held).withColumn("of", F.lit(of))
        both = part if both is None else both.union(part)
    out = []
    for of, (n, spans, n_kept, kept) in enumerate([("n_removed", "spans", "n_kept", "kept"), ("n_passages", "passages", "n_passages_kept", "passages_kept")][:len(found)]):
        gone, stays = F.col("places").isNull() & (F.col("of") == of), F.col("places").isNotNull() & (F.col("of") == of)
        out += [F.count(F.when(gone, 1)).alias(n), F.array_sort(F.collect_list(F.when(gone, F.struct("start", "end", "kept_id", "kept_start")))).alias(spans),
                F.count(F.when(stays, 1)).alias(n_kept), F.array_sort(F.collect_list(F.when(stays, F.struct("start", "end", "places")))).alias(kept)]
    out = both.groupBy(F.col("id").alias(id_col)).agg(*out)
    ends = F.array_sort(F.concat(*(F.transform(c, lambda x: F.struct(x["start"], x["end"])) for c in ("spans", "passages")[:len(found)])))
    chars = F.aggregate(ends, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, x: F.struct(
        (a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["to"]), F.lit(0).cast("long"))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")), lambda a: a["n"])
    return out.withColumn("removed_chars", chars).select(id_col, "n_removed", "removed_chars", *[c for c in out.columns if c not in (id_col, "n_removed")])

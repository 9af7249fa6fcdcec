"""URL filters (operator 8): many glob rules at once by a bit-parallel automaton.

Every rule is compiled to a chain of states over the bytes of the canonical URL (host, then path):
``**`` loops on any byte, ``*`` on any byte but the slash, ``?`` is one byte, other bytes stand for themselves. All chains share one multiword
state vector; a step is a shift, a mask of the byte read and a mask of the loops, done for all URLs
of a batch together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shipshape.llm.common import batches, string_bytes

# fixed values: the rules (verdict, host, path) that are given
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Globs that judge URLs without a rule (any fit: block).
GLOBS = ["*/**login**", "*/**wp-admin/**", "*/**.exe", "ads.*/**", "*.ads.*/**"]
#: URLs of more bytes are walked one by one, shorter ones together.
TOGETHER = 4096


def compiled(patterns: list[str]):
    """Masks of the automaton: (by byte: match, by byte: loop, first states, last state of each pattern), as (n, words) uint64."""
    bits, match, loop, first, last = 0, {}, {}, [], []
    for p in patterns:
        states, i = [], 0
        first.append(bits)
        # state 0 of a pattern stands before its first byte; loops sit on the state they follow
        raw = p.encode()
        loops = [0]
        while i < len(raw):
            if raw[i:i + 2] == b"**":
                loops[-1] = 2
                i += 2
            elif raw[i:i + 1] == b"*":
                loops[-1] = max(loops[-1], 1)
                i += 1
            else:
                states.append(raw[i])
                loops.append(0)
                i += 1
        for k, kind in enumerate(loops):
            if kind:
                loop[bits + k] = kind
        for k, c in enumerate(states):
            match[bits + k + 1] = c
        last.append(bits + len(states))
        bits += len(states) + 1
    words = (bits + 63) // 64 or 1
    m, lo = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    one = lambda b: (b >> 6, np.uint64(1) << np.uint64(b & 63))
    for b, c in match.items():
        w, bit = one(b)
        if c == ord("?"):
            m[:, w] |= bit
        else:
            m[c, w] |= bit
    for b, kind in loop.items():
        w, bit = one(b)
        lo[:, w] |= bit
        if kind == 1:
            lo[ord("/"), w] &= ~bit
    start = np.zeros(words, np.uint64)
    for b in first:
        w, bit = one(b)
        start[w] |= bit
    return m, lo, start, last


def fits(col, automaton) -> np.ndarray:
    """Which pattern fits which URL, as (rows, patterns) booleans; the whole URL has to fit."""
    m, lo, start, last = automaton
    raw, off = string_bytes(col)
    n = np.diff(off)
    out = np.zeros((len(n), len(last)), bool)
    order = np.argsort(n, kind="stable")
    groups = [order[n[order] <= TOGETHER], *([i] for i in order[n[order] > TOGETHER])]
    for rows in map(np.asarray, groups):
        if not len(rows):
            continue
        state = np.repeat(start[None, :], len(rows), 0)
        size, alive = n[rows], 0
        for at in range(int(size.max())):
            while size[alive] <= at:
                alive += 1
            live = state[alive:]
            c = raw[off[rows[alive:]] + at]
            moved = live << np.uint64(1)
            moved[:, 1:] |= live[:, :-1] >> np.uint64(63)
            state[alive:] = (moved & m[c]) | (live & lo[c])
        for j, b in enumerate(last):
            out[rows, j] = (state[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1) == 1
    return out


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for a null URL or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, rules=None, globs=None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict of every row.

    A rule (verdict, host, path prefix) fits its host and all subdomains; the longest wins, then the
    earlier. Without a rule the globs decide: block if one fits, else allow. Null and malformed URLs
    have an empty host and path. Repeated rows are judged each.
    """
    rules, globs = RULES if rules is None else rules, GLOBS if globs is None else globs
    batches(pages.sparkSession)
    patterns = [f"{sub}{h}{p}**" for _, h, p in rules for sub in ("", "*.")] + list(globs)
    automaton = compiled(patterns)
    names = [f"{h}{p}" for _, h, p in rules]
    order = sorted(range(len(rules)), key=lambda i: (-len(names[i]), i))

    def run(it):
        for b in it:
            hit = fits(b.column("url"), automaton)
            own = hit[:, 0:2 * len(rules):2] | hit[:, 1:2 * len(rules):2]
            rest = hit[:, 2 * len(rules):].any(1) if globs else np.zeros(len(hit), bool)
            best = [next((i for i in order if r[i]), None) for r in own]
            rule = [None if i is None else names[i] for i in best]
            verdict = [("block" if g else "allow") if i is None else rules[i][0] for i, g in zip(best, rest)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])
    host, path = canonical(F.col(url_col).cast("string"))
    base = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("url", F.concat("host", "path"))
    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)

"""Secret scan (operator 2): fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models over the characters of identifiers are trained from labelled samples: random
strings and ordinary runs of the same characters that are judged (identifiers, paths, rules). A
share of each row goes to the label's character shares, so a transition without samples costs the
same however large the corpus is. A run is reported when the random model explains it clearly better. Training sums transition counts in Spark; a table of fixed size reaches
the driver and the scanning tasks.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shipshape.llm.common import batches

# fixed values: the base patterns, their least lengths, and the order of kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run of at least 32
KINDS = ("assign", "access", "hex", "markov")

CLUES = ("password", "passwd", "secret", "token", "api")
#: Runs that the models judge, runs (of the same characters) that are ordinary samples, and the least log-likelihood ratio (nats).
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
WORD = re.compile(r"[A-Za-z0-9+/_=-]{3,}")
THRESHOLD = 12.0
BACK, EVEN = 0.05, 0.2  # least share of a row that goes to the label's character shares, share of those that is uniform
CODES = 68  # letters, digits, + / _ = -, and the end
_CODE = np.full(128, CODES - 1, np.int64)
for _i, _c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"):
    _CODE[ord(_c)] = _i
END = CODES - 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns by start, then kind; code points, end exclusive."""
    out = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(c in low for c in CLUES):
            out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def transitions(samples: list[str]) -> np.ndarray:
    """Counts of (character, next character) over samples, an end mark before and after each."""
    raw = np.frombuffer(("\x7f" + "\x7f".join(samples) + "\x7f").encode("ascii", "replace"), np.uint8)
    code = _CODE[raw & 127]
    return np.bincount(code[:-1] * CODES + code[1:], minlength=CODES * CODES)


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(label, pair, n): transition counts of samples labelled by the base patterns, over all whole texts.

    Values that a base pattern catches are random strings (label 1), words outside of them ordinary (0).
    """
    batches(docs.sparkSession)

    def run(it):
        total = np.zeros((2, CODES * CODES), np.int64)
        for b in it:
            for t in b.column("text").to_pylist():
                t = t or ""
                spans = base_spans(t)
                if spans:
                    total[1] += transitions([re.split(r"[:=][\x20\"']*", t[s:e], maxsplit=1)[-1] for s, e, _ in spans])
                    at, rest = 0, []
                    for s, e, _ in spans:
                        rest.append(t[at:max(s, at)])
                        at = max(e, at)
                    t = " ".join([*rest, t[at:]])
                total[0] += transitions(WORD.findall(t))
        label, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(pair, pa.int32()), pa.array(total[label, pair])], names=["label", "pair", "n"])
    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))


def ratios(counts: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each transition (random over ordinary); at most 2 * CODES * CODES counts reach the driver."""
    total = np.zeros((2, CODES, CODES))
    for r in counts.where("label in (0, 1) and pair is not null and n is not null").collect():
        total[r["label"], r["pair"] // CODES, r["pair"] % CODES] += r["n"]
    of_all, of_row = total.sum((1, 2))[:, None], total.sum(2, keepdims=True)
    shares = np.where(of_all > 0, (1 - EVEN) * total.sum(1) / np.maximum(of_all, 1) + EVEN / CODES, 1 / CODES)[:, None, :]
    # rows of few samples for their distinct successors go further back
    kinds = (total > 0).sum(2, keepdims=True)
    back = np.where(of_row > 0, np.maximum(BACK, kinds / np.maximum(of_row + kinds, 1)), 1)
    logs = np.log((1 - back) * total / np.maximum(of_row, 1) + back * shares)
    return logs[1] - logs[0]


def markov_spans(text: str, table: np.ndarray, base: list, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    out = []
    for m in RUN.finditer(text):
        s, e = m.span()
        if any(a < e and s < b for a, b, _ in base):
            continue
        code = _CODE[np.frombuffer(m[0].encode(), np.uint8)]
        # each transition once: repeats of one (rules, borders) are no further evidence
        if table.ravel()[np.unique(code[:-1] * CODES + code[1:])].sum() >= threshold:
            out.append((s, e, 3))
    return out


def spelled(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, counts: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, n_markov, base_sha256, spans.

    ``counts`` are labelled transition counts (default: from ``docs`` itself). A null text counts as
    empty; without any sample of one label its model is uniform. Spans of the models never overlap a
    base span. Repeated rows are scanned each.
    """
    table = ratios(labelled(docs, id_col, text_col) if counts is None else counts)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(it):
        for b in it:
            rows = []
            for t in b.column("text").to_pylist():
                base = base_spans(t or "")
                more = markov_spans(t or "", shared.value, base)
                n = [sum(k == j for _, _, k in base) for j in range(3)]
                rows.append((*n, len(more), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(sorted(base + more, key=lambda s: (s[0], s[2], s[1])))))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                                             names=["id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string").withColumnRenamed("id", id_col)

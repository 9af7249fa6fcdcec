"""Quality classifier (operator 10): histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed in one pass with numpy on Arrow batches. The trees are
grown on a bounded sample of labelled rows (``SAMPLE``, by hash of the id) from histograms of
quantile bins, then flattened into arrays (feature, threshold, child, value) that a scoring task
walks for all rows of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shipshape.llm.common import batches, string_bytes, tidy, word_hashes, written

#: Labelled rows the trees are grown on at most (parameter of ``classify``).
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, MIN_ROWS, RIDGE = 60, 4, 64, 0.15, 5, 1.0

_KINDS = ["upper", "lower", "digit", "blank", "line", "stop", "comma", "bar", "bang", "mark", "other", "high"]
_KIND = np.full(256, _KINDS.index("other"), np.int64)
_KIND[ord("A"):ord("Z") + 1] = 0
_KIND[ord("a"):ord("z") + 1] = 1
_KIND[ord("0"):ord("9") + 1] = 2
_KIND[[0x20, 9, 11, 12, 13]] = 3
_KIND[10] = 4
_KIND[[ord(c) for c in ".;:"]] = 5
_KIND[ord(",")] = 6
_KIND[ord("|")] = 7
_KIND[[ord(c) for c in "!?"]] = 8
_KIND[[ord(c) for c in "#$%&*+=@^~_/\\<>"]] = 9
_KIND[128:] = 11
FEATURES = [*(f"share_{k}" for k in _KINDS), "bytes", "words", "bytes_per_word", "distinct_words", "repeated_next", "top_word", "lines", "words_per_line", "changes"]


def statistics(col) -> np.ndarray:
    """One row of FEATURES per text; an empty or null text has all zeros."""
    raw, off = string_bytes(col)
    n, rows = np.diff(off), len(off) - 1
    kind = _KIND[raw]
    row = np.repeat(np.arange(rows), n)
    counts = np.bincount(row * len(_KINDS) + kind, minlength=rows * len(_KINDS)).reshape(rows, -1).astype(float)
    size = np.maximum(n, 1)
    words, woff = word_hashes(col)
    w = np.diff(woff)
    wsize = np.maximum(w, 1)
    same = np.zeros(len(words) + 1)
    if len(words) > 1:
        inner = np.ones(len(words), bool)
        inner[woff[:-1][w > 0]] = False
        same[1:][1:] = np.cumsum((words[1:] == words[:-1]) & inner[1:])
    repeated = same[woff[1:]] - same[np.minimum(woff[:-1] + 1, len(words))]
    distinct, top = np.zeros(rows), np.zeros(rows)
    for i in np.flatnonzero(w):
        s = np.sort(words[woff[i]:woff[i + 1]])
        cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
        distinct[i], top[i] = len(cut) - 1, np.diff(cut).max()
    change = np.zeros(len(raw) + 1)
    if len(raw) > 1:
        change[2:] = np.cumsum(kind[1:] != kind[:-1])
    changes = change[off[1:]] - change[np.minimum(off[:-1] + 1, len(raw))]
    lines = counts[:, 4] + (n > 0)
    return np.column_stack([counts / size[:, None], n, w, n / wsize, distinct / wsize, np.maximum(repeated, 0) / wsize, top / wsize, lines, w / np.maximum(lines, 1), np.maximum(changes, 0) / size])


def _statistics(it):
    for b in it:
        s = statistics(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["id", "stats"])


def grow(x: np.ndarray, y: np.ndarray) -> dict:
    """Boosted trees of logistic loss on binned features, as flat arrays (complete binary trees)."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = np.log(prior / (1 - prior))
    score = np.full(len(y), base)
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    feature, threshold, value = np.zeros((TREES, inner), int), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), int)
        for level in range(DEPTH):
            width, first = 1 << level, (1 << level) - 1
            local = node - first
            best = np.full(width, 1e-6)
            choice = [(0, np.inf, BINS)] * width
            total = [np.bincount(local, v, width) for v in (g, h)]
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = local * BINS + binned[:, f]
                sg, sh, sn = (np.cumsum(np.bincount(key, v, width * BINS).reshape(width, BINS), 1) for v in (g, h, None))
                rg, rh, rn = total[0][:, None] - sg, total[1][:, None] - sh, sn[:, -1:] - sn
                gain = sg ** 2 / (sh + RIDGE) + rg ** 2 / (rh + RIDGE) - (total[0] ** 2 / (total[1] + RIDGE))[:, None]
                gain[(sn < MIN_ROWS) | (rn < MIN_ROWS)] = 0
                gain = gain[:, :len(c)]
                at = gain.argmax(1)
                for j in range(width):
                    if gain[j, at[j]] > best[j]:
                        best[j], choice[j] = gain[j, at[j]], (f, c[at[j]], at[j])
            for j, (f, cut, _) in enumerate(choice):
                feature[t, first + j], threshold[t, first + j] = f, cut
            at = np.array([c[2] for c in choice])
            right = binned[np.arange(len(y)), feature[t, node]] > at[local]
            node = 2 * node + 1 + right
        leaf = node - inner
        value[t] = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        score += value[t][leaf]
    return {"base": base, "feature": feature, "threshold": threshold, "value": value}


def walk(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of all rows: every tree is walked for the whole batch, level by level."""
    score = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"]):
        node = np.zeros(len(x), int)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        score += value[node - len(threshold)]
    return 1 / (1 + np.exp(-score))


def _score(model):
    def run(it):
        for b in it:
            x = np.asarray(b.column("stats").values).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(walk(model, x))], names=["id", "score"])
    return tidy(run)


def held_out(col):
    """Whether a row is kept from learning: crc32 of the id as text divides by 5 (a null id is)."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             sample: int = SAMPLE, threshold: float = 0.3, row_col: str | None = None) -> DataFrame:
    """id, held_out, score, predicted for every row of ``docs``; with ``row_col`` that column too.

    Learns from labelled rows that are not held out, at most ``sample`` of them. Null labels and ids
    are not learnt from; of several labels of an id the largest counts. Without any label the score
    is 0.5, with one class only its smoothed share. Empty texts are scored like any other.
    """
    spark = docs.sparkSession
    batches(spark)
    own = F.col(id_col) if row_col is None else F.struct(F.col(id_col).alias("of"), F.col(row_col).alias("row"))
    base = docs.select(own.alias("id"), F.col(text_col).cast("string").alias("text"))
    doc_id = F.col("id") if row_col is None else F.col("id.of")
    stats = written(base.mapInArrow(tidy(_statistics), f"id {dict(base.dtypes)['id']}, stats array<double>"))
    known = (labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y in (0, 1)")
             .groupBy("k").agg(F.max("y").alias("y")).where(~held_out(F.col("k"))))
    drawn = stats.join(known, doc_id == F.col("k")).select("id", "stats", "y").orderBy(F.xxhash64(doc_id), doc_id, "stats").limit(sample)
    drawn = written(drawn).collect()  # collected at once, every partition would send its own ``sample`` rows to the driver
    if drawn:
        model = grow(np.array([r["stats"] for r in drawn]), np.array([r["y"] for r in drawn], float))
    else:
        model = {"base": 0.0, "feature": np.zeros((0, 1), int), "threshold": np.zeros((0, 1)), "value": np.zeros((0, 2))}
    scored = stats.mapInArrow(_score(model), f"id {dict(base.dtypes)['id']}, score double")
    row = [] if row_col is None else [F.col("id.row").alias(row_col)]
    return scored.select(doc_id.alias(id_col), *row, held_out(doc_id).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

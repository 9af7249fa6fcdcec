"""Spelling variant grouping (operator 11): Bloom-guided neighbourhoods over the vocabulary.

Words of all texts are counted. The vocabulary fills blocked Bloom filters, one shard per word
length, which are broadcast; every word's deletions and replacements are hashed and probed there, in
arrays. Only positives leave the task, as hashes and edits; an exact join with the vocabulary
rebuilds the edited word and removes false positives. Insertions are the deletions of the longer
word, and a replacement by a larger letter is one by a smaller letter seen from the other word, so
each pair is found once. A broadcast stays below ``FILTER_BYTES``: a larger vocabulary is cut by
hash into parts that are probed one after another.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shipshape.llm.common import batches, mix, written

#: Bytes of one broadcast filter.
FILTER_BYTES = 32 << 20
#: Bits of the filter for each word, and lengths that have a shard of their own.
WORD_BITS, LONG = 24, 64
#: Places whose edits are probed at once.
LOT = 40_000
#: Blocks of eight 32-bit lanes built by one group.
SEGMENT = 8192
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_P = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_P, -1, 1 << 64))
_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, often: int = 3, every: int = 97) -> DataFrame:
    """(word, n): words of at least ``least`` code points and ``often`` occurrences.

    Of runs whose crc32 of ``<id>:<run>`` is divisible by ``every`` one letter is deleted, at crc32 % length.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(F.split(text, "[^a-zÀ-ÿ]+")).alias("run"))
    runs = runs.where(F.char_length("run") >= least).select("run", F.crc32(F.concat("id", "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, _without(F.col("run"), at)).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def _without(word: Column, at: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), at), F.substr(word, at + 2))


# ---- hashes of words and of their edits ----

@dataclass
class Places:
    """Code points of some words end to end: the word, place and value of each, and hashes of the whole words."""

    of: np.ndarray
    at: np.ndarray
    code: np.ndarray
    length: np.ndarray
    power: np.ndarray
    before: np.ndarray
    whole: np.ndarray


def places(words: list[str]) -> Places:
    """A word's hash is the sum of code * P^place modulo 2^64; one edit changes it by a few terms."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(length) - length
    of = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(code)) - start[of]
    powers = np.full(int(length.max(initial=0)) + 1, _P, np.uint64)
    powers[0] = 1
    power = np.cumprod(powers)[at]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power, dtype=np.uint64)])
    return Places(of, at, code, length, power, total[:-1] - total[start][of], total[start + length] - total[start])


def key(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(sums + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


# ---- blocked Bloom filters ----

@dataclass(frozen=True)
class Shards:
    """Where the shard of each length begins among the blocks, and how many blocks it has; by part."""

    first: np.ndarray
    blocks: np.ndarray
    parts: int

    @classmethod
    def of(cls, counts: dict[int, int]) -> "Shards":
        words = np.zeros(LONG + 1, np.int64)
        for length, n in counts.items():
            words[min(length, LONG)] += n
        parts = max(1, -(-int(words.sum()) * WORD_BITS // (FILTER_BYTES * 8)))
        blocks = np.where(words > 0, -(-words * WORD_BITS // (256 * parts)), 0)
        return cls(np.cumsum(blocks) - blocks, blocks, parts)

    @property
    def total(self) -> int:
        return int(self.blocks.sum())

    def part(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(self.parts)).astype(np.int32)

    def block(self, keys: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The block of each key; -1 where no word of that length is known."""
        shard = np.minimum(length, LONG)
        n = self.blocks[shard]
        return np.where(n > 0, self.first[shard] + (((keys >> np.uint64(32)) * n.astype(np.uint64)) >> np.uint64(32)).astype(np.int64), -1)


def lane_bits(keys: np.ndarray, lane: int) -> np.ndarray:
    return np.uint32(1) << ((keys.astype(np.uint32) * _SALTS[lane]) >> np.uint32(27))


def held(lanes: np.ndarray, shards: Shards, keys: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places in ``keys`` that the filter may hold; of the others one lane's bit is unset."""
    block = shards.block(keys, length)
    left = np.flatnonzero(block >= 0)
    for lane in range(8):
        left = left[(lanes[block[left] * 8 + lane] & lane_bits(keys[left], lane)) != 0]
    return left


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n, len, h): the words with the 64-bit hash that the filters hold."""
    def run(it):
        for b in it:
            p = places(b.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(p.length), pa.array(key(p.whole, p.length).view(np.int64))], names=["word", "n", "len", "h"])
    return words.select("word", "n").mapInArrow(run, "word string, n long, len long, h long")


def filled(vocab: DataFrame, shards: Shards, part: int) -> np.ndarray:
    """Lanes of the filter of one part: segments are built on executors; their bytes are bounded by FILTER_BYTES."""
    def dealt(it):
        for b in it:
            h = np.asarray(b.column("h")).view(np.uint64)
            mine = np.flatnonzero(shards.part(h) == part)
            block = shards.block(h[mine], np.asarray(b.column("len"))[mine])
            yield pa.RecordBatch.from_arrays([pa.array((block // SEGMENT).astype(np.int32)), pa.array((block % SEGMENT).astype(np.int32)), pa.array(h[mine].view(np.int64))], names=["segment", "block", "h"])

    def built(group: pa.Table) -> pa.Table:
        lanes = np.zeros(SEGMENT * 8, np.uint32)
        h, block = group.column("h").to_numpy().view(np.uint64), group.column("block").to_numpy().astype(np.int64)
        for lane in range(8):
            np.bitwise_or.at(lanes, block * 8 + lane, lane_bits(h, lane))
        return pa.table({"segment": group.column("segment")[:1], "lanes": pa.array([lanes.tobytes()], pa.binary())})
    # a segment's words are bounded: a block has about 256 / WORD_BITS of them
    segments = vocab.select("h", "len").mapInArrow(dealt, "segment int, block int, h long").groupBy("segment").applyInArrow(built, "segment int, lanes binary")
    out = np.zeros((-(-shards.total // SEGMENT), SEGMENT * 8), np.uint32)
    for r in segments.collect():
        out[r["segment"]] = np.frombuffer(r["lanes"], np.uint32)
    return out.ravel()


def probed(vocab: DataFrame, shards: Shards, part: int, letters: np.ndarray, lanes) -> DataFrame:
    """(src, cand, at, code): hashes of a word and of an edit that the filter of ``part`` may hold.

    ``code`` is the letter put at ``at``, -1 a deletion. ``lanes`` is the broadcast filter.
    """
    def run(it):
        for b in it:
            p = places(b.column("word").to_pylist())
            h = np.asarray(b.column("h"))
            for i in range(0, len(p.code), LOT):
                s = slice(i, i + LOT)
                of, at, code, power, before = p.of[s], p.at[s], p.code[s], p.power[s], p.before[s]
                length = p.length[of]
                # deletions, of a run of equal letters the first only
                first = (at == 0) | (code != (p.code[i - 1:i + len(code) - 1] if i else np.concatenate([[0], code[:-1]]).astype(np.uint64)))
                cut = np.flatnonzero(first & (length > 1))
                after = p.whole[of[cut]] - before[cut] - code[cut] * power[cut]
                keys = [key(before[cut] + after * _INVERSE, length[cut] - 1)]
                rows, put, size = [cut], [np.full(len(cut), -1)], [length[cut] - 1]
                # replacements by larger letters
                row, letter = np.nonzero(letters[None, :] > code[:, None])
                keys.append(key(p.whole[of[row]] + (letters[letter] - code[row]) * power[row], length[row]))
                rows, put, size = np.concatenate([*rows, row]), np.concatenate([*put, letters[letter].astype(np.int64)]), np.concatenate([*size, length[row]])
                keys = np.concatenate(keys)
                if shards.parts > 1:
                    mine = np.flatnonzero(shards.part(keys) == part)
                    keys, rows, put, size = keys[mine], rows[mine], put[mine], size[mine]
                hit = held(lanes.value, shards, keys, size)
                yield pa.RecordBatch.from_arrays([pa.array(h[of[rows[hit]]]), pa.array(keys[hit].view(np.int64)), pa.array(at[rows[hit]].astype(np.int32)), pa.array(put[hit].astype(np.int32))],
                                                 names=["src", "cand", "at", "code"])
    return vocab.select("word", "h").mapInArrow(run, "src long, cand long, at int, code int")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(word, n, near, near_n), both ways: words that differ by one inserted, deleted or replaced code point."""
    spark = vocab.sparkSession
    counts = {r["len"]: r["count"] for r in vocab.groupBy(F.least("len", F.lit(LONG)).alias("len")).count().collect()}  # at most LONG rows
    shards = Shards.of(counts)
    letters = np.array(sorted(ord(r[0]) for r in vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().where("c <> ''").collect()), np.uint64)  # letters of the class
    found = None
    for part in range(shards.parts if counts else 0):
        lanes = spark.sparkContext.broadcast(filled(vocab, shards, part))
        more = written(probed(vocab, shards, part, letters, lanes))
        lanes.unpersist()
        found = more if found is None else found.union(more)
    if found is None:
        return spark.createDataFrame([], "word string, n long, near string, near_n long")
    found = found.join(vocab.select(F.col("h").alias("cand"), F.col("word").alias("near"), F.col("n").alias("near_n")), "cand").join(
        vocab.select(F.col("h").alias("src"), "word", "n"), "src")
    put = F.when(F.col("code") < 0, F.lit("")).otherwise(F.chr(F.col("code")))
    edited = F.concat(F.substring("word", F.lit(1), F.col("at")), put, F.substr(F.col("word"), F.col("at") + 2))
    pairs = written(found.where(edited == F.col("near")).select("word", "n", "near", "near_n"))
    return pairs.union(pairs.select("near", "near_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of (word, form).

    A form occurs at least twice as often as its word, so chains have no circles and their length is
    a logarithm of the largest count. Each round the open chains take the pointer of what they point
    to, which halves what is left of them; chains at their end are only read.
    """
    ends = open_ = forms.select("word", F.col("form").alias("root"))
    done = None
    while True:
        step = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(open_.join(step, "root", "left").select("word", "root", "further"))
        ended = moved.where("further is null").select("word", "root")
        done = ended if done is None else done.union(ended)
        open_ = moved.where("further is not null").select("word", F.col("further").alias("root"))
        if open_.isEmpty():
            return done
        ends = done.union(open_)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, often: int = 3, every: int = 97, times: int = 2) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (ties: the smallest by code points) if that is at least
    ``times`` n. Null and empty texts have no words; a null id counts as an empty one. Rows that
    repeat an id are counted each. Words of any length take part. An empty table, or one without
    frequent words, gives no rows.
    """
    batches(docs.sparkSession)
    vocab = written(vocabulary(counted(docs, id_col, text_col, least, often, every)))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    near = written(near_pairs(vocab).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.when(-F.col("b.m") >= times * F.col("n"), F.col("b.near")).alias("form"), F.when(-F.col("b.m") >= times * F.col("n"), -F.col("b.m")).alias("form_n")))
    ends = roots(near.where("form is not null").select("word", "form"))
    return vocab.select("word", "n").join(near, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")

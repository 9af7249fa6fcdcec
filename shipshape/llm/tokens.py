"""Token ids in Parquet (operator 7): list column with dictionary or delta encoding, small pages, page indexes.

Documents are range-partitioned and sorted by id, encoded and written as Parquet: id, block
(partition, ascending with the id), pos (place in the block), local_start (ids of the block before
it), n_tokens, tokens. Ids are dictionary-encoded with a fall-back to delta (format version 2); row
groups and pages are small and carry indexes, so metadata or the tokens of a few documents can be
read alone. Prefix sums over the file need one number per block.
"""

from __future__ import annotations

import zlib
from string import ascii_letters, digits, punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shipshape.llm.common import batches, kept, partitions, shared_folder, string_bytes, tidy

PARQUET = {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(32 << 20), "parquet.page.size": str(128 << 10),
           "parquet.page.row.count.limit": "20000", "parquet.enable.dictionary": "true", "compression": "zstd"}
#: Encoded words a worker keeps; beyond, those not used for longest go until half of it is left.
CACHE = 800_000
#: Bytes of text that a worker encodes at a time.
TEXT_BYTES = 8 << 20
#: White space of every script but the space.
_OTHER = r"\x09-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Slices that hold white space besides a space at their beginning, or are long: they aren't kept.
_ODD = rf"(?s:.)[ {_OTHER}]|\A[{_OTHER}]|\A \z|(?s:.{{201}})"
_WIDE = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_WHITE, _PUNCT, _ALNUM = np.zeros((3, 256), bool)
_WHITE[[*range(9, 14), *range(0x1C, 0x21)]] = True
_PUNCT[list(punctuation.encode())] = True
_ALNUM[list((digits + ascii_letters).encode())] = True
_state = kept("tokens")


class _Words:
    """Words that were encoded, as columns: the words, their ids as bytes, the turn each was last used in."""

    def __init__(self):
        self.words, self.ids, self.used, self.turn = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, "i4"), 0

    def __len__(self):
        return len(self.words)

    def __iter__(self):
        return iter(self.words.to_pylist())

    def find(self, words: pa.Array) -> np.ndarray:
        """Places of words, -1 for those not here."""
        return pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy()

    def use(self, at: np.ndarray, words: pa.Array, ids: pa.Array) -> None:
        """Mark the words at these places as used, add words; those not used for longest may go."""
        self.turn += 1
        self.used[at] = self.turn
        self.words, self.ids = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.ids, ids])
        self.used = np.concatenate([self.used, np.full(len(words), self.turn, "i4")])
        if len(self) > CACHE:
            stays = self.used > min(np.partition(self.used, -(CACHE // 2))[-(CACHE // 2)], self.turn - 1)
            self.words, self.ids, self.used = self.words.filter(pa.array(stays)), self.ids.filter(pa.array(stays)), self.used[stays]


def _tokenizer(path: str):
    if _state.get("path") != path:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        _state.clear()
        _state.update(path=path, own=own, words=_Words(), added=[t.content for t in own.get_added_tokens_decoder().values()],
                      brk=own.encode("\n", add_special_tokens=False).ids)
    return _state["own"]


def _whole(own, texts: list[str]) -> pa.Array:
    """Ids of each text, as bytes."""
    return pa.array([np.array(e.ids, "<u4").tobytes() for e in own.encode_batch_fast(texts, add_special_tokens=False)] if texts else [], pa.large_binary())


def _slices(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First bytes of slices of texts, UTF-8 from ``off`` on; what is behind each begins a pre-token wherever the slice stands.

    A text is cut before a space and on both sides of a line break that stands between other characters
    than white space, and between a letter or digit and ASCII punctuation. The pre-tokenizer's pattern
    looks ahead in white space only, so the ids of slices are those of the text.
    """
    n = len(raw)
    raw = np.concatenate([raw, np.zeros(3, "u1")])
    white = _WHITE[raw]
    at = np.flatnonzero(raw == 0xC2)
    at = at[(raw[at + 1] == 0x85) | (raw[at + 1] == 0xA0)]
    white[at] = white[at + 1] = True
    at = np.flatnonzero((raw >= 0xE1) & (raw <= 0xE3))
    code = raw[[at, at + 1, at + 2]].astype("i4")
    at = at[np.isin((code[0] & 15) << 12 | (code[1] & 63) << 6 | code[2] & 63, _WIDE)]
    for j in range(3):
        white[at + j] = True
    cut = np.zeros(n + 3, bool)
    cut[off] = True
    at = np.flatnonzero((raw[:n] == 0x20) | (raw[:n] == 0x0A))
    at = at[~(white[at - 1] | cut[at] | white[at + 1] | cut[at + 1])]
    marks = np.flatnonzero(_PUNCT[raw[:n]])
    last, lead = raw[marks - 1], raw[marks - 2]
    letter = (last >> 6 == 2) & (lead >= 0xC3) & ((lead <= 0xC8) | (lead == 0xC9) & (last <= 0x8F)) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
    marks = marks[(_ALNUM[last] | letter) & ~cut[marks]]
    cut[at] = cut[at[raw[at] == 0x0A] + 1] = cut[marks] = True
    return np.flatnonzero(cut[:n])


def _learn(own, words: list[str]) -> pa.Array:
    """Ids of words, as bytes: many are encoded at a time, a line break (one id, in none of them) between."""
    lots, brk, found = ["\n".join(words[i:i + 200]) for i in range(0, len(words), 200)], _state["brk"], []
    for i in range(0, len(lots), 20):
        for e in own.encode_batch_fast(lots[i:i + 20], add_special_tokens=False):
            found += [np.array(e.ids, "<u4"), np.array(brk, "<u4")]
    ids = np.concatenate([*found, np.zeros(0, "<u4")])
    ends = np.flatnonzero(ids == brk[0])
    off = np.concatenate([[0], ends - np.arange(len(ends))]) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(off), pa.py_buffer(ids[ids != brk[0]])])


def encode_column(texts: pa.Array, path: str, special: bool = False, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """32-bit ids of all texts, one after the other, each whole and with ``end`` behind it, and their offsets.

    With ``special`` the ids are those of the tokenizer as loaded, for which a special token's content
    is that token: texts that hold one are encoded as they are. Otherwise the content is text like any other.

    Texts are cut into slices that encode by themselves; distinct slices are looked up among the words
    kept, by columns, and encoded once if they are new.
    """
    own = _tokenizer(path)
    held = np.zeros(len(texts), bool)
    for content in _state["added"] if special else ():
        held |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
    if held.any() and "plain" not in _state:  # loaded only for such texts
        _state["plain"] = type(own).from_file(path)
    raw, off = string_bytes(pc.if_else(pa.array(held), "", texts) if held.any() else texts)
    starts = _slices(raw, off)
    slices = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw))
    found = slices.dictionary_encode()
    words, place = found.dictionary, found.indices.to_numpy()
    kept_words = _state["words"]
    at = kept_words.find(words)
    known = at >= 0
    odd = pc.match_substring_regex(words, _ODD).to_numpy(zero_copy_only=False) | (len(_state["brk"]) != 1)
    new = words.filter(pa.array(~known & ~odd))
    new_ids = _learn(own, new.to_pylist())
    # ids of the words kept, then of new ones, odd ones, whole texts, then the end
    ids = [kept_words.ids, new_ids, _whole(own, words.filter(pa.array(odd)).to_pylist()), _whole(_state.get("plain"), texts.filter(pa.array(held)).to_pylist()), pa.array([end], pa.large_binary())]
    first = np.cumsum([0, *map(len, ids)])
    used = at[known]
    at = at.copy()
    at[~known & ~odd] = first[1] + np.arange(len(new))
    at[odd] = first[2] + np.arange(len(ids[2]))
    tail = np.full(len(texts) + held.sum(), first[4], "i4")
    rows = np.repeat(np.arange(len(texts)), 1 + held)
    tail[:-1][rows[:-1] == rows[1:]] = first[3] + np.arange(len(ids[3]))
    off = np.searchsorted(starts, off)
    taken = pa.concat_arrays(ids).take(pa.array(np.insert(at[place], off[1:][rows], tail)))
    kept_words.use(used, new, new_ids)
    off[1:] += np.cumsum(1 + held)
    _, ends, flat = taken.buffers()
    ends = np.frombuffer(ends, "i8", len(taken) + 1)
    return np.frombuffer(flat, "<i4", ends[-1] // 4) if ends[-1] else np.zeros(0, "<i4"), ends[off] // 4


def encode(texts: list[str], path: str, special: bool = False) -> list[bytes]:
    """Little-endian 32-bit ids of each text, whole, as :func:`encode_column` finds them."""
    flat, off = encode_column(pa.array(texts, pa.large_string()), path, special)
    return [flat[i:j].tobytes() for i, j in zip(off[:-1], off[1:])]


def _gathered(it):
    """Batches put together up to ``TEXT_BYTES`` of text: words that repeat are then looked up once."""
    held, size = [], 0
    for b in it:
        held.append(b)
        size += b.column("text").nbytes
        if size >= TEXT_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _encode(path: str, end_id: int):
    def run(it):
        block, pos, start = TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        for t in _gathered(it):
            for b in t.combine_chunks().to_batches():
                flat, off = encode_column(b.column("text").cast(pa.large_string()).fill_null(""), path, True, end)
                n = np.diff(off)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.full(len(n), block, "i4")), pa.array(pos + np.arange(len(n))), pa.array(start + off[:-1]), pa.array(n),
                                                  pa.ListArray.from_arrays(pa.array(off.astype("i4")), pa.array(flat))],
                                                 names=["id", "block", "pos", "local_start", "n_tokens", "tokens"])
                pos, start = pos + len(n), start + int(off[-1])
    return tidy(run, "tokens")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty) with the tokenizer as its file has it, no tokens added, plus ``end_id`` and write the files in ascending order of id.

    Null ids come first; rows of the same id stand by their texts. An empty table writes an empty file set.
    """
    spark = docs.sparkSession
    batches(spark)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = base.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", "text")
    kind = dict(base.dtypes)["id"]
    ordered.mapInArrow(_encode(tokenizer, end_id), f"id {kind}, block int, pos long, local_start long, n_tokens long, tokens array<int>").write.options(**PARQUET).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """id, start, n_tokens, tokens: ``start`` counts the ids of all documents before."""
    files = spark.read.parquet(path)
    blocks = files.groupBy("block").agg(F.sum("n_tokens").alias("s"))  # metadata columns only; a row per block
    before = blocks.select(F.col("block").alias("k"), F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return files.join(F.broadcast(before), F.col("block") == F.col("k")).select("id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def _digests(it):
    for b in it:
        lists = b.column("tokens")
        off, flat = np.asarray(lists.offsets), np.asarray(lists.values).astype("<i4", copy=False)
        crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(off[:-1], off[1:])]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files, read them back: id, start, n_tokens, ids_crc32 of each document."""
    spark = docs.sparkSession
    path = shared_folder(spark)
    write_tokens(docs, path, tokenizer, 0, id_col, text_col)
    back = read_tokens(spark, path)
    return back.mapInArrow(tidy(_digests, "tokens"), f"id {dict(back.dtypes)['id']}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)

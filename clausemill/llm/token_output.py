"""Token-id output as Parquet list columns.

Documents are dealt into ranges of ascending doc_id, encoded within their range and
written by Spark: ids as a dictionary-encoded list column, numbers delta-encoded (v2 data
pages), row groups and pages of a stated size, page indexes on.  A reader can fetch the
metadata columns without touching ids, and a doc_id predicate skips pages and row groups.
A manifest beside the files gives each shard's number of ids and the ids before it.
"""

from __future__ import annotations

import sys
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, scratch_dir
from .words import LOWER, NON_SPACE, WordHasher, text_blocks, word_borders

TOKENIZER = "word_bpe_49k.json"
_KEPT = "_clausemill_encoders"
END_ID = 1
#: Slots of a worker's table of words: 2^20 take 32 MB, for half a million words.  Once it is full it
#: stays as it is, and other words are encoded once in each piece where they occur; that changes no
#: result.  Words of more bytes than REMEMBERED_BYTES aren't kept.
SLOTS, REMEMBERED_BYTES = 1 << 20, 64
#: Texts are encoded and handed on in pieces of about so many bytes, one text at least.
PIECE_BYTES = 1 << 20
#: Bytes by class: a-z, 0-9, marks between which and letters the tokenizer splits before anything
#: else (no apostrophe: it has rules for 's and the like), and all others.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("0") : ord("9") + 1] = 1, 2
_CLASS[list(b"!#$%&*+,-./:;<=>?@^_|~")] = 3
WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#shard_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def atoms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut where the tokenizer cuts them: those of a-z, digits and marks alone into runs of
    letters, single digits and runs of marks; others stay whole.  Starts, ends, and which are such
    cuts."""
    kind = _CLASS[data]
    odd = np.append(0, np.cumsum(kind == 0))
    plain = odd[ends] == odd[starts]
    step = np.zeros(len(data) + 1, np.int8)
    step[starts[plain]] += 1
    step[ends[plain]] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    cut = np.zeros(len(data), bool)
    cut[1:] = inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    cut[starts] = True
    firsts = np.flatnonzero(cut)
    of = np.searchsorted(starts, firsts, "right") - 1
    return firsts, np.minimum(np.append(firsts[1:], len(data)), ends[of]), plain[of]


class WordTable:
    """Ids of words by a 64-bit hash of the word, in arrays whose size never changes: open
    addressing over ``slots``, at most half of them taken, and four ids for each on average."""

    def __init__(self, slots: int = SLOTS):
        self.keys, self.rows = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.begin, self.length = np.zeros(slots // 2, np.int32), np.zeros(slots // 2, np.int32)
        self.ids, self.words, self.used = np.zeros(2 * slots, np.int32), 0, 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at, out, left = self._place(keys), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(left):
            row = self.rows[at[left]]
            same = (row >= 0) & (self.keys[at[left]] == keys[left])
            out[left[same]] = row[same]
            left = left[(row >= 0) & ~same]
            at[left] = (at[left] + 1) % len(self.keys)
        return out

    def add(self, keys: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """Adds distinct keys that aren't there, as many as there is room for."""
        n = min(len(keys), len(self.begin) - self.words, int(np.searchsorted(np.cumsum(length), len(self.ids) - self.used, "right")))
        keys, length = keys[:n], length[:n]
        rows = np.arange(self.words, self.words + n, dtype=np.int32)
        ends = np.cumsum(length)
        self.begin[rows], self.length[rows] = self.used + ends - length, length
        total = int(ends[-1]) if n else 0
        self.ids[self.used : self.used + total] = ids[:total]
        self.words, self.used = self.words + n, self.used + total
        at, left = self._place(keys), np.arange(n)
        while len(left):
            free = left[self.rows[at[left]] < 0]
            # of several that meet in a slot the last gets it
            self.rows[at[free]] = rows[free]
            left = left[self.rows[at[left]] != rows[left]]
            at[left] = (at[left] + 1) % len(self.keys)
        slots = np.flatnonzero(self.rows >= self.words - n)
        self.keys[slots] = keys[self.rows[slots] - (self.words - n)]


class WordEncoder:
    """Encodes whole texts word by word; each different word of a piece once, and words that are
    remembered not at all.

    The tokenizer lower-cases, then splits at white space and between letters, digits and other
    characters before anything else, so the ids of a text are those of its white-space
    words in order, and those of ``word,`` are those of ``word`` and ``,``.  Texts with a
    vertical tab or form feed, whose class depends on the regex engine, and texts that may
    hold a special token are encoded in one piece.
    """

    def __init__(self, path: str, slots: int = SLOTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.is_end[i] = token.endswith("</w>")
        self.table, self.hasher = WordTable(slots), WordHasher()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_call(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and how many each has, by one call for all, cut at the tokens that end a
        word; word by word if these aren't as many."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        (ids,) = self._ids([b" ".join(words).decode()])
        cuts = np.flatnonzero(self.is_end[ids]) + 1
        if len(cuts) == len(words):
            return ids, np.diff(np.append(0, cuts))
        each = self._ids([w.decode() for w in words])
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def word_ids(self, words: list[bytes], is_plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which words are encoded, their ids in that order and how many each has:
        plain ones, then others that are letters alone, then the rest one by one."""
        plain, others = np.flatnonzero(is_plain), np.flatnonzero(~is_plain).tolist()
        letters = [k for k in others if words[k].decode().isalpha()]
        rest = sorted(set(others).difference(letters))
        parts = [self._one_call([words[k] for k in some]) for some in (plain.tolist(), letters)]
        if rest:
            each = self._ids([words[k].decode() for k in rest])
            parts.append((np.concatenate(each), np.array([len(x) for x in each], np.int64)))
        ids, length = (np.concatenate(x) for x in zip(*parts))
        return np.concatenate([plain, letters, rest]).astype(np.int64), ids, length

    def _piece(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, and how many each text has."""
        table, data = self.table, LOWER[raw]
        starts, ends, _ = word_borders(data, offsets, NON_SPACE)
        if not len(starts):
            ids, count = np.empty(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        else:
            starts, ends, is_plain = atoms(data, starts, ends)
            keys, at, which = np.unique(self.hasher(data, starts, ends), return_index=True, return_inverse=True)
            rows = table.find(keys)
            begin, length = table.begin[rows].astype(np.int64), table.length[rows].astype(np.int64)
            store, new = table.ids, np.flatnonzero(rows < 0)
            if len(new):
                s, e = starts[at[new]], ends[at[new]]
                order, found, n = self.word_ids([data[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist())], is_plain[at[new]])
                new, size = new[order], (e - s)[order]
                store = np.concatenate([table.ids[: table.used], found])
                begin[new], length[new] = table.used + np.cumsum(n) - n, n
                short = size <= REMEMBERED_BYTES
                table.add(keys[new[short]], n[short], found if short.all() else found[np.repeat(short, n)])
            n = length[which]
            after = np.cumsum(n)
            ids = store[np.arange(int(after[-1])) + np.repeat(begin[which] - (after - n), n)]
            count = np.diff(np.append(0, after)[np.searchsorted(starts, offsets)])
        odd = (raw == 11) | (raw == 12)
        odd[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
        odd = np.diff(np.append(0, np.cumsum(odd))[offsets]) > 0
        if odd.any():
            each = np.split(ids, np.cumsum(count)[:-1])
            for k in np.flatnonzero(odd).tolist():
                (each[k],) = self._ids([raw[offsets[k] : offsets[k + 1]].tobytes().decode()])
            ids, count = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        return ids, count

    def __call__(self, column, end_id: int | None = None):
        """Of the texts of an Arrow column (null: empty), piece by piece: all ids, and the end of
        each text's ids; with ``end_id`` after each text."""
        for _, raw, offsets in text_blocks(column, PIECE_BYTES):
            ids, count = self._piece(raw, offsets)
            ends = np.cumsum(count)
            if end_id is not None:
                ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
            yield ids, ends


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which its later tasks use again with the words that it
    remembers: some 40 MB, whose size never changes."""
    kept = sys.modules.setdefault(_KEPT, types.ModuleType(_KEPT)).__dict__
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def _encoder(path: str, end_id: int):
    def run(batches):
        encode, shard, total = worker_encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            lo = 0
            for ids, ends in encode(batch.column("text"), end_id):
                n = len(ends)
                tokens = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
                sizes = np.diff(np.append(0, ends))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo : lo + n], pa.array(np.full(n, shard), pa.int32()), pa.array(total + ends - sizes), pa.array(sizes), tokens],
                    ["doc_id", "shard", "shard_start", "n_tokens", "tokens"],
                )
                total += int(ends[-1])
                lo += n

    return run


def write_tokens(documents: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, options: dict[str, str] = WRITE_OPTIONS) -> None:
    """Encodes every whole text of ``documents`` (doc_id, text) and writes ``path/ids`` and
    ``path/manifest``.  Null texts are empty (the end id alone); null ids come first;
    repeated ids stay, ordered by a hash of their text.  Other columns are ignored."""
    spark = documents.sparkSession
    bound_batches(spark)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    (
        rows.repartitionByRange(shards, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(_encoder(public_tokenizers.path(tokenizer), end_id), f"doc_id {kind}, shard int, shard_start long, n_tokens long, tokens array<int>")
        .write.options(**options)
        .parquet(f"{path}/ids")
    )
    ids = spark.read.parquet(f"{path}/ids")
    counts = ids.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each shard
    counts.withColumn("start", F.coalesce(before, F.lit(0)).cast("long")).write.parquet(f"{path}/manifest")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) without reading ids."""
    ids = spark.read.parquet(f"{path}/ids").select("doc_id", "shard", "shard_start", "n_tokens")
    return _with_start(spark, path, ids).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens)."""
    return _with_start(spark, path, spark.read.parquet(f"{path}/ids")).select("doc_id", "start", "n_tokens", "tokens")


def _with_start(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    # the manifest has one row for each shard, at most spark.sql.shuffle.partitions
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", F.col("start").alias("before"))
    return ids.join(F.broadcast(manifest), "shard").withColumn("start", F.col("before") + F.col("shard_start"))


def _crc32(batches):
    sys.modules.pop(_KEPT, None)  # ids are written; a worker that reads them back needs no encoder any more
    for batch in batches:
        tokens = batch.column("tokens")
        values = np.asarray(tokens.values).astype("<u4", copy=False)
        offsets = np.asarray(tokens.offsets)
        crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        out = batch.select(["doc_id", "start"]).append_column("n_tokens", pa.array(np.diff(offsets), pa.int64()))
        yield out.append_column("ids_crc32", pa.array(crcs, pa.int64()))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Of each document, from the files: doc_id, start, n_tokens and the crc32 of its ids as
    little-endian unsigned 32-bit integers."""
    tokens = read_tokens(spark, path).select("doc_id", "start", "tokens")
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(_crc32, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def encode_and_digest(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    path = scratch_dir(spark)
    write_tokens(documents, path)
    return token_digest(spark, path)

"""Concatenate and cut: every token of a corpus in fixed windows, by two passes over partition totals.

Pass one encodes the rows of each partition and writes the ids with their start inside the partition.  Prefix sums over
the partitions' totals (one row a partition) give global offsets; pass two cuts each document at the multiples of the
window and gives one record for each piece.  No token is moved between partitions.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TwoGenerations, read, small_batches, stage_table, text_of

VOCABULARY, WINDOW, LAST_ID = "word_bpe_49k.json", 4096, 2
#: Entries of each generation of the cache of encoded words that a Python worker keeps.
CACHED = 450_000

#: Outside these characters a text can be put in lower case before the tokenizer does so, with the same ids.
_UNUSUAL = re.compile("[\x1c-\x1f\u0130\u0300-\U0010ffff]")
#: A stop or comma after a letter and before white space is a word of its own to the tokenizer.
_STOP = re.compile(r"[.,](?<=[^\W\d_][.,])(?=\s)")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: What stands between words that are encoded in one call, and how many words that are.
_MARK, _GROUP = "|", 256

_encoders: dict = {}


def _usual(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _UNUSUAL.search(text)
    return not any(c in text for c in _SEPARATORS)


class WordEncoder:
    """Ids of whole texts as little-endian 16-bit bytes.  The tokenizer drops white space and never merges over it, so
    parts between white space are encoded apart, each distinct one once while the cache knows it."""

    def __init__(self, path: str, cap: int = CACHED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids do not fit 16 bits")
        self.cache = TwoGenerations(cap)
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _alone(self, words: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: struct.pack(f"<{len(ids)}H", *ids) for w, ids in zip(words, (e.ids for e in found), strict=True)}

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """Words in groups with a mark between them, which costs less than a call's result for each; a word that holds the
        mark or unusual characters, and a group that does not give as many marks as it should, are encoded word by word."""
        if self.mark is None:
            return self._alone(words)
        plain, alone, out = [], [], {}
        for w in words:
            (alone if _MARK in w or _UNUSUAL.search(w) else plain).append(w)
        groups = [plain[i : i + _GROUP] for i in range(0, len(plain), _GROUP)]
        found = self.tokenizer.encode_batch_fast([f" {_MARK} ".join(g) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, found, strict=True):
            ids = np.asarray(encoding.ids, "<u2")
            ends = np.flatnonzero(ids == self.mark).tolist()
            if len(ends) != len(group) - 1:
                alone += group
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(group, [*ends, len(ids)], strict=True):
                out[w] = raw[2 * at : 2 * end]
                at = end + 1
        if alone:
            out |= self._alone(alone)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        # str.split() also splits at 0x1C-0x1F, which are no white space to the tokenizer
        parts = []
        for t in texts:
            if _usual(t):
                parts.append(_STOP.sub(r" \g<0>", t.lower()).split())
            else:
                parts.append([t] if any(c in t for c in _SEPARATORS) else t.split())
        young, old, fresh = self.cache.young, self.cache.old, []
        for w in set().union(*parts).difference(young):
            if w in old:
                young[w] = old[w]
            else:
                fresh.append(w)
        if fresh:
            young.update(self._encode(fresh))
        out = [b"".join(map(young.__getitem__, ps)) for ps in parts]
        for w in fresh:
            if len(w) > 64:
                del young[w]
        self.cache.turn()
        return out


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_partitions(docs: DataFrame, path: str, last_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (part, local, id, n, ids): ``local`` is the number of tokens before the document in its partition."""
    small_batches(docs.sparkSession)

    def run(batches):
        encoder, part, local, end = _encoder(path), TaskContext.get().partitionId(), 0, np.asarray([last_id], "<u2").tobytes()
        for batch in batches:
            ids = [x + end for x in encoder.encode(batch.column(1).to_pylist())]
            n = np.array([len(x) // 2 for x in ids], "i8")
            starts = local + np.concatenate(([0], np.cumsum(n)))
            local = int(starts[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, "i4")), pa.array(starts[:-1]), batch.column(0).cast(pa.int64()), pa.array(n), pa.array(ids, pa.binary())], names=["part", "local", "id", "n", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t")).mapInArrow(run, "part int, local long, id long, n long, ids binary")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, last_id: int = LAST_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids as binary).

    Null and empty texts are one piece with ``last_id``.  Repeated rows are packed each.  A null id stays null.  Only
    the last sequence is shorter than the window.  Other columns are ignored; an empty table gives no piece.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    encoded = stage_table(encode_partitions(docs, path, last_id, id_col, text_col), "token-ids")
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))  # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for at, doc, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids, done = np.frombuffer(raw, "<u2").astype("<u4"), 0
                while done < n:
                    seq, off = divmod(at + done, window)
                    k = min(window - off, n - done)
                    piece = ids[done : done + k].tobytes()
                    for column, value in zip(out, (doc, done, k, zlib.crc32(piece), n, seq, off, piece if with_ids else None), strict=True):
                        column.append(value)
                    done += k
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out[:7]] + [pa.array(out[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    pieces = encoded.join(F.broadcast(offsets), "part").select((F.col("base") + F.col("local")).alias("at"), "id", "n", "ids")
    out = pieces.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out if with_ids else out.drop("ids")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))

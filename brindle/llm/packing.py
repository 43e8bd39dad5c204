"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many of ``max_len`` as fit, then
the binary digits of the rest, longest first.  Every piece is a sequence of its own and lies in the bucket of
its length, so no sequence holds two documents and none needs padding; a batch is drawn from one bucket.

Token ids come from the tokenizers library, called once for each distinct pre-token that a worker has not met;
texts that hold a special token's string are encoded whole by the library, and so is every text where the vocabulary
file asks for another normaliser or pre-tokeniser than the one that ``vocab`` has.  Pre-tokens are told apart byte for
byte.

Null text counts as empty: such a document is its end token alone.  Repeated rows are packed each on its own, and so
are rows without a doc_id.  A text is never cut short.  There are no ties.  An empty table gives an empty one; other
columns are ignored, whatever their names.  Sequence ids are unique: the input partition's number and a counter
within it, so a task that runs again after a lost executor gives the same ids for the same rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cached, encoded, read_table, ship, slices, text_or_empty, worker
from brindle.llm.vocab import Known, byte_level_starts, ragged

_ENCODERS: dict[str, ByteLevelEncoder] = {}
cached("packing", _ENCODERS.clear)


def tokenizer_path(name: str) -> str:
    """A full path stays; a bare name is looked up where the public vocabularies are installed."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteLevelEncoder:
    """Token ids of texts laid end to end, for a byte-level BPE vocabulary without normaliser."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        self.by_word = not spec["normalizer"] and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known = Known()
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(vocab.values()) + 1, bool)  # tokens that begin with the byte of a space
        self.leads[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of pre-tokens.  Those that begin with a space and go on with ink are encoded many at a
        time, one after another: each space starts a pre-token there, and its token shows where."""
        joined = [len(w) > 1 and w[0] == " " and not w[1].isspace() for w in words]
        many = [w for w, j in zip(words, joined, strict=True) if j]
        texts = ["".join(many[i : i + 500]) for i in range(0, len(many), 500)]
        ids = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        size = np.diff(np.append(np.flatnonzero(self.leads[ids]), len(ids)))
        alone = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast([w for w, j in zip(words, joined, strict=True) if not j], add_special_tokens=False)]
        if len(size) != len(many):
            raise ValueError("a pre-token that begins with a space was split")
        mask = np.array(joined, bool)
        sizes = np.zeros(len(words), np.int64)
        sizes[mask], sizes[~mask] = size, [len(a) for a in alone]
        order = np.argsort(np.concatenate((np.flatnonzero(mask), np.flatnonzero(~mask))), kind="stable")
        pool = np.concatenate([ids, *alone])
        at = np.concatenate(([0], np.cumsum(np.concatenate((sizes[mask], sizes[~mask])))[:-1])).astype(np.int64)
        return sizes, ragged(pool, at[order], sizes)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and n + 1 bounds."""
        odd = {i for i, t in enumerate(texts) if not self.by_word or any(s in t for s in self.special)}
        plain = ["" if i in odd else t for i, t in enumerate(texts)]
        laid = "".join(plain)
        points = np.frombuffer(laid.encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = np.frombuffer(laid.encode("utf-8", "surrogatepass"), np.uint8)
        limits = np.concatenate(([0], np.cumsum([len(t) for t in plain]))).astype(np.int64)
        if len(points):
            starts = byte_level_starts(points, limits)
            words, number = encoded(raw, np.append(byte_places(points, len(raw))[starts], len(raw)))
            row = self.known.rows(words, lambda new: self.encode_words([w.decode("utf-8", "surrogatepass") for w in new]))[number]
            size = self.known.size[row]
            ids = ragged(self.known.pool, self.known.at[row], size)
            upto = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
            bounds = upto[np.searchsorted(starts, limits)]
        else:
            ids, bounds = np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if not odd:
            return ids, bounds
        rows = [np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32) if i in odd else ids[bounds[i] : bounds[i + 1]] for i, t in enumerate(texts)]
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)


def byte_places(points: np.ndarray, n_bytes: int) -> np.ndarray:
    """Where each code point begins in the UTF-8 form, which has ``n_bytes``."""
    if n_bytes == len(points):
        return np.arange(n_bytes, dtype=np.int64)
    width = np.int64(1) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    return np.cumsum(width) - width


def binary_pieces(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of n tokens, longest first."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _packer(name: str, end_id: int, max_len: int, with_ids: bool):
    @worker("packing", keep=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS[name] = ByteLevelEncoder(name)
        encode, number = _ENCODERS[name], TaskContext.get().partitionId() << 40
        for batch in slices(batches, 1):
            ids, bounds = encode(batch.column(1).to_pylist())
            rows, tokens = [], []
            for doc, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                at = 0
                for length in binary_pieces(len(own), max_len):
                    piece = own[at : at + length]
                    rows.append((doc, at, length, zlib.crc32(piece.tobytes()), len(own), number, 0, length))
                    if with_ids:
                        tokens.append(piece.astype(np.int32))
                    number += 1
                    at += length
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
            if with_ids:
                lengths = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(tokens))))
                names.append("input_ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, max_len: int = 2048, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and input_ids.

    ``bucket`` is the sequence's length, a power of two up to ``max_len``; ``max_len`` must be one.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    ship(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket long"
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return given.mapInArrow(_packer(tokenizer, end_id, max_len, with_ids), schema + (", input_ids array<int>" if with_ids else ""))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Training files, one folder a bucket: every file holds sequences of one length."""
    pieces.write.partitionBy("bucket").parquet(path)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), with_ids=False)

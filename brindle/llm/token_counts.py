"""Token counts by rank-synchronous array merging.

Texts are normalised and split as the vocabulary file says (NFC, white-space runs to one space, lower case by
character; contractions, letter runs, single numbers, runs of others).  The pre-tokens that a worker has not
met are held together as one ragged array of symbols, and all are merged at once: in every round each sequence
applies its own lowest-ranked pair at all places where it occurs, left to right, until no sequence has a pair
that the merge table knows.  What is left is counted.

Strings of added tokens inside a text are taken out before normalising and count one token each.  A text with a
character that Python's tables do not know, or give another lower case than the library, is counted by the library.

Null text counts as empty: 0 bytes, 0 tokens.  Texts are counted whole, repeated rows each on their own, rows
without a doc_id like others.  There are no ties.  An empty table gives an empty one; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cached, read_table, ship, text_or_empty, worker
from brindle.llm.packing import tokenizer_path

_COUNTERS: dict[str, WordCounter] = {}
cached("token_counts", _COUNTERS.clear)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordCounter:
    """Counts tokens of a byte-level BPE vocabulary with an end-of-word mark."""

    def __init__(self, name: str, limit: int = 1_000_000):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Lowercase

        self.whole, self.lower = Tokenizer.from_file(tokenizer_path(name)), Lowercase()
        self.same: dict[str, bool] = {}
        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        missing = -1
        self.inner = np.array([vocab.get(c, missing) for c in letters], np.int64)
        self.final = np.array([vocab.get(c + end, missing) for c in letters], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.base = len(vocab) + 1
        codes = np.array([a * self.base + b for a, b, _ in pairs], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.rank, self.made = codes[order], order, np.array([m for _, _, m in pairs], np.int64)[order]
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)))
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.counts: dict[str, int] = {}
        self.limit = limit

    def merge(self, words: list[str]) -> np.ndarray:
        """Tokens in each pre-token."""
        data = [w.encode("utf-8") for w in words]
        size = np.array([len(d) for d in data], np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        stop = np.cumsum(size)
        symbols = self.inner[raw]
        symbols[stop - 1] = self.final[raw[stop - 1]]
        owner = np.repeat(np.arange(len(words)), size)
        known = symbols >= 0
        symbols, owner = symbols[known], owner[known]
        out = np.zeros(len(words), np.int64)
        never = len(self.codes) + 1
        while len(symbols):
            code = symbols[:-1] * self.base + symbols[1:]
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            fits = (self.codes[place] == code) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(fits, self.rank[place], never), never)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(owner)))
            done = least == never
            out[owner[first[done]]] = length[done]
            least_here = np.repeat(least, length)
            hit = (rank == least_here) & (rank < never)
            # In a run of overlapping hits (one symbol repeated) every second one counts, from the left.
            at = np.flatnonzero(hit)
            if len(at):
                new_run = np.append(True, np.diff(at) != 1)
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
                symbols = symbols.copy()
                symbols[at] = self.made[place[at]]
            keep = np.repeat(~done, length)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def known(self, text: str) -> bool:
        """Whether Python lower-cases every character as the library does."""
        for c in set(text) - self.same.keys():
            self.same[c] = unicodedata.category(c) != "Cn" and self.lower.normalize_str(c) == c.lower()
        return text.isascii() or all(map(self.same.__getitem__, set(text)))

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        else:
            text = text.lower()
        return self.pattern.findall(text)

    def __call__(self, texts: list[str]) -> list[int]:
        held, extra = [], []
        for t in texts:
            if not t.isascii() and not self.known(t):
                extra.append(len(self.whole.encode(t, add_special_tokens=False).ids))
                held.append([])
                continue
            special = len(self.cut.findall(t)) if any(a in t for a in self.added) else 0
            extra.append(special)
            held.append([w for part in self.cut.split(t) for w in self.words(part)] if special else self.words(t))
        if len(self.counts) > self.limit:
            self.counts.clear()
        new = list({w for ws in held for w in ws if w not in self.counts})
        for i in range(0, len(new), 1 << 16):
            part = new[i : i + (1 << 16)]
            self.counts.update(zip(part, self.merge(part).tolist(), strict=True))
        count = self.counts.__getitem__
        return [n + sum(map(count, ws)) for n, ws in zip(extra, held, strict=True)]


def _counter(name: str):
    @worker("token_counts", keep=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _COUNTERS:
            _COUNTERS[name] = WordCounter(name)
        counter = _COUNTERS[name]
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                n = counter(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens."""
    ship(docs.sparkSession)
    text = text_or_empty()
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return given.mapInArrow(_counter(tokenizer), "doc_id long, n_bytes long, n_tokens long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    counted = count_tokens(read_table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)

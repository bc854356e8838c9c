"""Token counts: pieces per distinct pre-token, joined to the pre-token frequencies of each document.

A byte-level BPE never merges across pre-tokens, so the number of tokens of a text is the sum over its
pre-tokens of the pieces of each. Every task keeps the piece count of each distinct pre-token that it has
met (bounded by ``CACHE``) and joins it to the frequencies of each document; ids are never built.
The pass is narrow: no shuffle, one scan, memory bounded by the cache and one piece of text.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import textkit

#: Distinct pre-tokens a task remembers before it starts over.
CACHE = 400_000

# The pre-token pattern of the vocabulary file (byte level, no added prefix space).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PieceCounter:
    """Counts tokens of texts with one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.pattern = regex.compile(PATTERN)
        self.pieces: dict[str, int] = {}
        self.assigned: set[str] = set()

    def _settled(self, text: str) -> bool:
        """False if a character is unassigned in this Python's Unicode tables: two libraries may class it differently."""
        if text.isascii():
            return True
        new = set(text) - self.assigned
        self.assigned.update(c for c in new if unicodedata.category(c) != "Cn")
        return self.assigned.issuperset(new)

    def count(self, texts: list[str]) -> list[int]:
        frequencies, specials = [], []
        for text in texts:
            if not self._settled(text):
                specials.append(len(self.tokenizer.encode(text, add_special_tokens=False)))
                frequencies.append(Counter())
                continue
            found = len(self.added.findall(text)) if self.added else 0
            specials.append(found)
            parts = self.added.split(text) if found else [text]
            frequencies.append(Counter(p for part in parts for p in self.pattern.findall(part)) if found else Counter(self.pattern.findall(text)))
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        new = list(set().union(*frequencies).difference(self.pieces))
        encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.pieces.update(zip(new, map(len, encoded)))
        return [s + sum(n * self.pieces[p] for p, n in f.items()) for f, s in zip(frequencies, specials)]


@cache
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to ``doc_id``.

    ``tokenizer`` names a byte-level BPE file of the ``public_tokenizers`` package, opened on each executor.
    A null text counts as empty (0 bytes, 0 tokens). Other columns are dropped; repeated rows and repeated
    or null ids stay, each with its own count. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counter = _counter(public_tokenizers.path(tokenizer))
        for batch in textkit.pieces(batches, "text"):
            _, offsets = textkit.raw(batch.column("text"))
            n = counter.count(batch.column("text").fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(F.col("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

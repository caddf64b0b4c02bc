"""Encoding of a whole corpus with a public byte-level BPE tokenizer by content-defined chunk reuse.

1. A rolling hash over the last ``WINDOW`` bytes cuts every text at content-defined places, so equal passages of
   different documents give equal chunks wherever they stand.
2. Chunks are brought together by their hash and each different chunk is encoded once where it lies; a chunk that very
   many documents share is split over tasks by size (adaptive rebalancing), so it costs one encoding per task.
3. The chunks of a document are joined again. A token sequence cut at a chunk's edge is not the one of the whole text, so
   each join is repaired: the text around it is encoded again from a safe place left of it to a safe place right of it.
   The window grows until the tokens it gives between the outer and the inner safe places agree on both sides with
   those of the chunks, at the latest when it covers both of them whole.

A place is *safe* before a blank that stands between two visible ASCII characters: the pre-tokenizer splits there
whatever lies further left or right.

Token ids fit in 16 bits for vocabularies up to 65,536 entries and travel as such between the stages.

Defined results: null and empty texts give an empty list; text that looks like a special token is ordinary text; equal
``doc_id`` rows would be merged, so the column has to be unique; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Place of the vocabulary (ranks); a parameter of :func:`encode_corpus`.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published pre-tokenization pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

WINDOW, MEAN_BITS = 16, 9
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


class Encoder:
    """The tokenizer with the tables that the repair of joins needs."""

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.wide = np.uint16 if max(ranks.values()) < 65536 else np.uint32
        self._encode = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.opens = np.array([len(t) > 1 and t[0] == 32 and 32 < t[1] < 127 for t in self.bytes_of])
        self.closes = np.array([len(t) > 0 and 32 < t[-1] < 127 for t in self.bytes_of])

    def encode(self, text: bytes) -> np.ndarray:
        return np.array(self._encode(text.decode()), self.wide)

    def safe(self, ids: np.ndarray) -> np.ndarray:
        """The positions of ``ids`` before which a safe place lies."""
        return np.flatnonzero(self.opens[ids[1:]] & self.closes[ids[:-1]]) + 1

    def join(self, chunks: list[np.ndarray]) -> np.ndarray:
        """The ids of the whole text from the ids of its chunks."""
        chunks = [c for c in chunks if len(c)]
        if not chunks:
            return np.zeros(0, self.wide)
        done: list[np.ndarray] = []
        left = chunks[0]
        for right in chunks[1:]:
            head, middle = self._repair(left, right)
            done.append(head)
            left = middle
        return np.concatenate([*done, left])

    def _repair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Split left + right at a safe place: ids that stay, and the ids of the rest of the text so far."""
        a, b = self.safe(left), self.safe(right)
        for reach in range(1, max(len(a), len(b)) + 2):
            # inner and outer safe places; 0 and len() where there is none left
            li, lo = (int(a[-reach]) if len(a) >= reach else 0), (int(a[-reach - 1]) if len(a) > reach else 0)
            ri, ro = (int(b[reach - 1]) if len(b) >= reach else len(right)), (int(b[reach]) if len(b) > reach else len(right))
            ids = self.encode(b"".join(map(self.bytes_of.__getitem__, [*left[lo:].tolist(), *right[:ro].tolist()])))
            before, after = left[lo:li], right[ri:ro]
            if (lo == 0 and ro == len(right)) or (np.array_equal(ids[: len(before)], before) and np.array_equal(ids[len(ids) - len(after) :], after)):
                break
        return left[:lo], np.concatenate([ids, right[ro:]])


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Where content-defined chunks of a UTF-8 byte array begin (0 left out)."""
    gear = _GEAR[data]
    rolled = gear.copy()
    for j in range(1, min(WINDOW, len(data))):
        rolled[j:] += gear[:-j] << np.uint32(j)
    cuts = np.flatnonzero((rolled >> np.uint32(32 - MEAN_BITS)) == 0) + 1
    cuts = cuts[cuts < len(data)]
    while (inside := (data[cuts] & 0xC0) == 0x80).any():  # not within a character
        cuts = cuts + inside
        cuts = cuts[cuts < len(data)]
    return np.unique(cuts)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, pos, keys, texts = [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            text = text or b""
            at = [0, *cut_places(np.frombuffer(text, np.uint8)).tolist(), len(text)] if len(text) > WINDOW else [0, len(text)]
            for k in range(len(at) - 1):
                ids.append(i)
                pos.append(k)
                texts.append(text[at[k] : at[k + 1]])
                keys.append(xxhash.xxh3_64_intdigest(texts[-1]) - 2**63)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(keys, pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "pos", "chunk_key", "chunk"])


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row (doc_id, ids) per document. Two shuffles: the chunks by hash, and their 16-bit ids by document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        seen: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            out = []
            for chunk in batch.column("chunk").to_pylist():
                ids = seen.get(chunk)
                if ids is None:
                    ids = seen[chunk] = enc.encode(chunk).tobytes()
                    held += len(chunk) + len(ids) + 200
                    if held > 64e6:  # bounds the worker's memory; what follows is encoded afresh
                        seen, held = {}, 0
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pos"), pa.array(out, pa.binary())], names=["doc_id", "pos", "part"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            lists = [enc.join([np.frombuffer(p["part"], enc.wide) for p in parts]) for parts in batch.column("parts").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunks = docs.mapInArrow(_chunks, "doc_id long, pos int, chunk_key long, chunk binary")
    parts = chunks.hint("rebalance", "chunk_key").mapInArrow(encode, "doc_id long, pos int, part binary")
    whole = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    return whole.mapInArrow(join, "doc_id long, ids array<int>")

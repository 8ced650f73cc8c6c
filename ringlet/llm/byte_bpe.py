"""Byte-level BPE with a hierarchical-bitmap rank queue.

Within one pre-token, adjacent pairs wait in buckets, one per merge rank; a bucket
holds positions of a doubly linked list of symbols.  A two-level bitmap tells which
buckets are non-empty, so that find-first-set gives the lowest rank in two steps.
Entries whose pair has changed since are stale and skipped.  One pre-token of n bytes
costs O(n log n), however long it is.

Defined results: null text counts as empty; an empty text has no tokens and decodes
to no bytes; strings of special tokens are ordinary text; texts are never cut.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlet.llm.common import tidy

#: Pre-tokens up to this many characters are remembered: the latest as objects, more of them packed, so many or so many bytes in each of two generations.
CACHED_CHARS, LATEST, CACHED, CACHED_BYTES = 48, 65_536, 393_216, 20_000_000
#: Pairs that are remembered.
CACHED_PAIRS = 196_608
_BIT = [1 << k for k in range(256)]
#: Rows and characters in one batch that goes back to Spark.
BATCH_ROWS, BATCH_CHARS = 512, 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class RankQueue:
    """Buckets of positions by rank under a bitmap of two levels of 256 bits.

    ``top`` marks the non-zero words of ``low``, whose bits mark the non-empty buckets.
    """

    def __init__(self, n_ranks: int):
        self.low = [0] * (n_ranks // 256 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 8] |= 1 << (rank & 255)
        self.top |= 1 << (rank >> 8)

    def pop(self) -> tuple[int, int]:
        """The leftmost position of the lowest rank; (-1, -1) when empty."""
        top = self.top
        if not top:
            return -1, -1
        bit = top & -top
        a = bit.bit_length() - 1
        word = self.low[a]
        least = word & -word
        rank = a << 8 | (least.bit_length() - 1)
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.low[a] = word = word ^ least
        if not word:
            self.top = top ^ bit
        return rank, bucket[0]


class _Pairs(dict):
    """left << shift | right -> rank of the two tokens together, or -1."""

    def __init__(self, ranks: dict[bytes, int], tokens: dict[int, bytes], shift: int):
        super().__init__()
        self.ranks, self.tokens, self.shift, self.mask = ranks, tokens, shift, (1 << shift) - 1

    def __missing__(self, key: int) -> int:
        rank = self.ranks.get(self.tokens[key >> self.shift] + self.tokens[key & self.mask], -1)
        if len(self) < CACHED_PAIRS:
            self[key] = rank
        return rank


class _Packed:
    """Pre-tokens and their ids in some 30 bytes each: records of a length byte, the pre-token in UTF-8, a count byte and the ids lie one after
    another; an open-addressed table holds where they begin, 0 where it is free.  The length in front makes a matching prefix an equal key."""

    def __init__(self, most: int):
        self.most, self.count, self.records = most, 0, bytearray(1)
        self.mask = (1 << (2 * most).bit_length()) - 1
        self.slots = array("I", bytes(4 * (self.mask + 1)))

    @staticmethod
    def key(piece: bytes) -> bytes:
        return bytes((len(piece),)) + piece

    def get(self, key: bytes) -> bytes | None:
        slots, records, mask = self.slots, self.records, self.mask
        at = hash(key) & mask
        while start := slots[at]:
            if records.startswith(key, start):
                start += len(key)
                return bytes(records[start + 1 : start + 1 + 4 * records[start]])
            at = (at + 1) & mask
        return None

    def full(self) -> bool:
        return self.count >= self.most or len(self.records) >= CACHED_BYTES

    def put(self, key: bytes, ids: bytes) -> None:
        """``key`` is absent, and this is not ``full``."""
        at = hash(key) & self.mask
        while self.slots[at]:
            at = (at + 1) & self.mask
        self.slots[at] = len(self.records)
        self.records += key
        self.records.append(len(ids) // 4)
        self.records += ids
        self.count += 1


class _Pieces(dict):
    """Pre-token -> its ids.  The latest are kept as they are; behind them are two packed generations: when one is full, it becomes the older."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe, self.now, self.old = bpe, _Packed(CACHED), _Packed(0)

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        if len(piece) > CACHED_CHARS:
            return array("I", self.bpe.merge(data)).tobytes()
        key = _Packed.key(data)
        got = self.now.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = array("I", self.bpe.merge(data)).tobytes()
            if self.now.full():
                self.old, self.now = self.now, _Packed(CACHED)
            self.now.put(key, got)
        if len(self) >= min(LATEST, CACHED):
            self.clear()
        self[piece] = got
        return got


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values()) + 1)
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"rank file without the single bytes {missing}")
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.shift = max(ranks.values()).bit_length()
        self.pairs = _Pairs(ranks, self.tokens, self.shift)
        self.known = _Pieces(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, pairs, shift, queue = len(piece), self.pairs, self.shift, self.queue
        # The queue's push and pop, written out: calls cost much in short pre-tokens.
        low, top, buckets = queue.low, 0, queue.buckets
        ids = list(map(self.single.__getitem__, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = ids[0]
        for i in range(1, n):
            right = ids[i]
            if (r := pairs[left << shift | right]) >= 0:
                if r in buckets:
                    buckets[r].append(i - 1)  # in order, so that it stays a heap
                else:
                    buckets[r] = [i - 1]
                    low[r >> 8] |= _BIT[r & 255]
                    top |= _BIT[r >> 8] if r < 65_536 else 1 << (r >> 8)
            left = right
        while top:
            a = (top & -top).bit_length() - 1
            word = low[a]
            least = word & -word
            rank = a << 8 | least.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[a] = word = word ^ least
                if not word:
                    top &= top - 1
            # Stale: i or its neighbour has been merged away, or the pair differs now.
            left, j = ids[i], after[i]
            if left < 0 or j >= n or pairs[left << shift | ids[j]] != rank:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            h = before[i]
            if k < n:
                before[k] = i
                if (r := pairs[rank << shift | ids[k]]) >= 0:
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        low[r >> 8] |= _BIT[r & 255]
                        top |= _BIT[r >> 8] if r < 65_536 else 1 << (r >> 8)
            if h >= 0 and (r := pairs[ids[h] << shift | rank]) >= 0:
                if r in buckets:
                    heappush(buckets[r], h)
                else:
                    buckets[r] = [h]
                    low[r >> 8] |= _BIT[r & 255]
                    top |= _BIT[r >> 8] if r < 65_536 else 1 << (r >> 8)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.split.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


@cache
def codec(path: str, pattern: str) -> ByteBPE:
    """One per Python worker and rank file."""
    return ByteBPE(load_ranks(path), pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary) of every row.

    No shuffle: rows stay in their scan's partition.  ``path`` names a rank file that
    every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            ids, decoded, start, chars = [], [], 0, 0
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                ids.append(bpe.encode(text))
                decoded.append(bpe.decode(ids[-1]))
                chars += len(text)
                if i + 1 == len(texts) or len(ids) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    out = [doc_ids.slice(start, len(ids)), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"])
                    ids, decoded, start, chars = [], [], i + 1, 0

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: token count, and digests of ids and decoded bytes."""
    return encode_decode(docs, path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def tokenizer_file() -> tuple[str, str]:
    """Rank file and split pattern of the box's public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ringlet.llm.common import table

    return digests(table(spark, sf_dir, "documents"), *tokenizer_file())

"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All words handed over together form one doubly linked list of tokens with gaps between the words.  For each merge rank
a bucket holds the list positions whose pair has that rank; a bitmap of three levels tells which buckets hold anything,
so that find-first-set gives the lowest rank in a few steps.  Positions whose pair has changed meanwhile are stale and
skipped.  Work for a pre-token of n bytes is O(n log n) at worst, for very long ones too.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import map_arrow, unique_docs
from tessera.llm.pretokens import Memo, chunks


class RankQueue:
    """Ranks that have positions waiting: buckets, and a three-level bitmap over them.

    A bucket is filled unordered until it is opened, which sorts it; what comes later goes to a heap beside it.  So every
    position is put in order once, however often a bucket is left for a lower rank.
    """

    def __init__(self, n_ranks: int):
        self.low, self.mid, self.top = [0] * (n_ranks // 64 + 1), [0] * (n_ranks // 4096 + 1), 0
        self.buckets: dict[int, Bucket] = {}

    def put(self, rank: int, positions: list[int]) -> None:
        held = self.buckets.get(rank)
        if held is None:
            self.buckets[rank] = Bucket(positions)
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        elif held.late is None:
            held.waiting.extend(positions)
        else:
            for p in positions:
                heapq.heappush(held.late, p)

    def lowest(self) -> int:
        """The lowest rank of all buckets, by find-first-set."""
        a = (self.top & -self.top).bit_length() - 1
        b = (a << 6) + (self.mid[a] & -self.mid[a]).bit_length() - 1
        return (b << 6) + (self.low[b] & -self.low[b]).bit_length() - 1

    def drop(self, rank: int) -> None:
        """Removes an empty bucket."""
        del self.buckets[rank]
        self.low[rank >> 6] &= ~(1 << (rank & 63))
        if not self.low[rank >> 6]:
            self.mid[rank >> 12] &= ~(1 << (rank >> 6 & 63))
            if not self.mid[rank >> 12]:
                self.top &= ~(1 << (rank >> 12))

    def __bool__(self) -> bool:
        return bool(self.top)


class Bucket:
    """Positions of one rank, taken in ascending order."""

    __slots__ = ("waiting", "late")

    def __init__(self, positions: list[int]):
        self.waiting, self.late = positions, None

    def open(self) -> tuple[list[int], list[int]]:
        """What waits, from the last to be taken to the first, and the heap of what came later; the lesser goes first."""
        if self.late is None:
            self.waiting.sort(reverse=True)
            self.late = []
        return self.waiting, self.late


class ByteBpe:
    """Encoder and decoder for a rank file (lines of base64 token and rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.n = max(self.rank.values()) + 1
        tokens = [b""] * self.n
        for token, rank in self.rank.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        #: Rank of what two adjacent tokens make, for each way to cut a token into two tokens.
        self.joined: dict[int, int] = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    self.joined[left << 32 | right] = rank
        table = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                table[a, b] = self.joined.get(int(self.byte_id[a]) << 32 | int(self.byte_id[b]), -1)
        self.byte_pairs = table

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word.  A word that is a token as a whole is that token."""
        out: list[list[int] | None] = [None if (r := self.rank.get(w)) is None else [r] for w in words]
        todo = [i for i, ids in enumerate(out) if ids is None]
        if todo:
            lengths = np.array([len(words[i]) for i in todo])
            for i, ids in zip(todo, self._merge(b"".join(words[i] for i in todo), lengths), strict=True):
                out[i] = ids
        return out

    def _merge(self, raw: bytes, lengths: np.ndarray) -> Iterator[list[int]]:
        data = np.frombuffer(raw, np.uint8)
        n, ends = len(data), np.cumsum(lengths)
        alive = np.ones(n, bool)
        alive[ends[ends > 0] - 1] = False  # no pair starts at a word's last byte
        first = np.flatnonzero(alive[:-1]) if n > 1 else np.array([], np.int64)
        ranks = self.byte_pairs[data[first], data[first + 1]]
        first, ranks = first[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        first, ranks = first[order], ranks[order]
        queue, cuts = RankQueue(self.n), np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, a, b in zip(ranks[cuts].tolist(), cuts.tolist(), np.append(cuts, len(ranks))[1:].tolist(), strict=True):
            queue.put(rank, first[a:b].tolist())
        ids = self.byte_id[data].tolist()
        following = np.arange(1, n + 1)
        following[ends[lengths > 0] - 1] = -1
        leading = np.arange(-1, n - 1)
        leading[(ends - lengths)[lengths > 0]] = -1
        after, before, joined = following.tolist(), leading.tolist(), self.joined.get
        while queue:
            rank, lower = queue.lowest(), False
            waiting, late = queue.buckets[rank].open()
            while not lower:
                if late and (not waiting or late[0] < waiting[-1]):
                    at = heapq.heappop(late)
                elif waiting:
                    at = waiting.pop()
                else:
                    queue.drop(rank)
                    break
                left = ids[at]
                right_at = after[at]
                if left < 0 or right_at < 0 or joined(left << 32 | ids[right_at]) != rank:
                    continue  # stale
                ids[at], ids[right_at] = rank, -1
                after[at] = beyond = after[right_at]
                if beyond >= 0:
                    before[beyond] = at
                    if (found := joined(rank << 32 | ids[beyond])) is not None:
                        queue.put(found, [at])
                        lower = found < rank
                if (prior := before[at]) >= 0 and (found := joined(ids[prior] << 32 | rank)) is not None:
                    queue.put(found, [prior])
                    lower |= found < rank
        kept = np.array(ids)
        counts = np.add.reduceat(kept >= 0, (ends - lengths)[lengths > 0]) if n else np.array([], int)
        flat, at, sizes = kept[kept >= 0].tolist(), 0, iter(counts.tolist())
        for length in lengths.tolist():
            size = next(sizes) if length else 0
            yield flat[at : at + size]
            at += size

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
        """Bytes of ids, end to end, and where each id's start (and the end)."""
        taken = self.tokens.take(pa.array(ids.astype(np.int64)))
        _, offsets, data = taken.buffers()
        return np.frombuffer(offsets, np.int64)[taken.offset :], memoryview(data if data is not None else b"")


@functools.cache
def bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and return a digest of both.

    docs needs ``doc_id`` and ``text``; other columns are ignored, repeated rows give repeated results.  A null text
    counts as empty: no ids, digests of the empty string.  Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by
    a space), decoded_sha256, and with keep_ids also the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe(path)

        def compute(words: list[bytes]) -> list[tuple[bytes, bytes]]:
            return [(np.array(ids, np.uint32).tobytes(), " ".join(map(str, ids)).encode() + b" ") for ids in codec.encode_words(words)]

        memo = Memo(compute)
        for batch in batches:
            doc_id = batch.column(0)
            for chunk in chunks(batch.column(1)):
                values = memo.values(chunk.words)
                at, raw = chunk.gather([v[0] for v in values])
                shown_at, shown = chunk.gather([v[1] for v in values])
                ids = np.frombuffer(raw, np.uint32)[: at[-1] // 4]
                decoded_at, decoded = codec.decode(ids)
                counts, out = np.diff(at) // 4, {"ids": [], "text": [], "list": []}
                for k in range(len(chunk.rows)):
                    a, b = at[k] // 4, at[k + 1] // 4
                    out["ids"].append(hashlib.sha256(shown[shown_at[k] : max(shown_at[k], shown_at[k + 1] - 1)]).hexdigest())
                    out["text"].append(hashlib.sha256(decoded[decoded_at[a] : decoded_at[b]]).hexdigest())
                    if keep_ids:
                        out["list"].append(ids[a:b].astype(np.int32))
                columns = [doc_id.slice(chunk.rows.start, len(chunk.rows)), pa.array(counts, pa.int64()), pa.array(out["ids"], pa.string()), pa.array(out["text"], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns, names = [*columns, pa.array(out["list"], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return map_arrow(unique_docs(docs, "doc_id", "text"), run, schema)

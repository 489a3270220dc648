"""Sum-of-squares packing of tokenized documents into sequences of fixed length.

A sequence that still has room is an open bin; its gap is the room left. A piece is put where the
sum over gaps of the squared number of open bins with that gap becomes smallest, so no gap gets
common and later pieces find bins that they fill. Only the counts per gap matter, so one placement
costs a few operations on an array of the sequence length.

Pieces are dealt at random into groups of a bounded size, and one task packs a group. It does so
twice, longest first and in random order with the small ones last, and keeps the packing that needs
fewer sequences. A group leaves a few sequences open at its end, whatever its size.
"""

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once_per_worker, stored

CAPACITY = 2048
#: Pieces that one task packs, on average.
GROUP = 60_000
#: Pieces shorter than this share of a sequence may come last, to fill gaps.
SMALL = 0.15
PIECE = "piece int, start long, length long, ids_crc32 long"


class ByteBpe:
    """Ids of texts as the tokenizers library gives them for a byte-level BPE file.

    The same vocabulary run by a faster library; special tokens in a text become their ids.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {_as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.whole = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        """The ids as unsigned 32-bit numbers."""
        return self.whole.encode_to_numpy(text, allowed_special="all")


def _as_bytes(token: str) -> bytes:
    """A token of a byte-level vocabulary as bytes: printable bytes stand for themselves."""
    return bytes(map(_byte_of().__getitem__, token))


def _byte_of() -> dict:
    def make():
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    return once_per_worker("byte_of", make)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be short."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)] if n > capacity else [(0, n)]


def pieces_of(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id and PIECE of every piece; a document ends with id 0, a null text is empty."""

    def rows(batches):
        import zlib

        import pyarrow as pa

        bpe = once_per_worker(("byte_bpe", path), lambda: ByteBpe(path, pattern))
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.append(bpe.encode(text.as_py() or ""), np.uint32(0)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    at.append(i)
                    found.append((k, start, n, zlib.crc32(ids[start : start + n])))
            columns = zip(*found, strict=True) if found else ([], [], [], [])
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(at, pa.int64()))] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.mapInArrow(rows, f"doc_id long, {PIECE}")


def sum_of_squares(lengths: np.ndarray, order: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every piece, placed in the given order.

    ``count[g]`` open bins have gap g. Moving a bin from gap g to g - s changes the sum of squares
    by 2 * (count[g - s] - count[g] + 1); a new bin adds 2 * count[capacity - s] + 1; a bin that
    becomes full leaves the sum. Of equal choices the smallest gap is taken.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins = [[] for _ in range(capacity + 1)]
    place = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    far = np.iinfo(np.int64).max
    bins = 0
    for i in order.tolist():
        s = int(lengths[i])
        gaps = count[s:capacity]
        change = 2 * (count[: capacity - s] - gaps + 1)
        if len(change):
            change[0] = 1 - 2 * gaps[0]
            change[gaps == 0] = far
            best = int(np.argmin(change))
            cost = int(change[best])
        else:
            best, cost = 0, far
        new = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if cost <= new:
            gap = s + best
            k = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, k = capacity, bins
            bins += 1
        place[i], offset[i] = k, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_bins[gap - s].append(k)
    return place, offset


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The better one of two orders; see the module's text."""
    longest = np.argsort(-lengths, kind="stable")
    mixed = np.random.default_rng(len(lengths)).permutation(len(lengths))
    large = lengths > SMALL * capacity
    late = np.concatenate([mixed[large[mixed]], longest[~large[longest]]])
    found = [sum_of_squares(lengths, order, capacity) for order in (longest, late)]
    return min(found, key=lambda f: f[0].max(initial=-1))


def packed_sequences(
    docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, group: int = GROUP
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is a document, repeated ids and rows too; a null id stays null, a null
    or empty text is the end id alone. Pieces as long as a sequence are one. sequence_id is unique
    over the table; offsets of a sequence begin at 0 and leave no gap. Other columns are left
    aside. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(pieces_of(docs, path, pattern, capacity), "pieces")
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group))
    dealt = F.pmod(F.xxhash64("doc_id", "ids_crc32", "length", F.lit(11)), F.lit(groups))
    # copies of one row would all fall in one group
    spread = F.when(F.lit(groups) == 1, F.lit(0)).otherwise(F.pmod(dealt + F.floor(F.rand(5) * groups), F.lit(groups)))

    def rows(table):
        import pyarrow as pa

        lengths = table.column("length").to_numpy()
        number = table.column("group")[0].as_py()
        place, offset = pack_group(lengths, capacity)
        table = table.drop_columns(["group"])
        table = table.append_column("sequence_id", pa.array(2 * (number + groups * place), pa.int64()))
        return table.append_column("offset", pa.array(offset, pa.int64()))

    schema = f"doc_id long, {PIECE}, sequence_id long, offset long"
    together = short.withColumn("group", spread.cast("long")).groupBy("group").applyInArrow(rows, schema)
    # odd numbers: partition and place in it
    whole = pieces.where(F.col("length") == capacity)
    alone = whole.withColumns({"sequence_id": 2 * F.monotonically_increasing_id() + 1, "offset": F.lit(0).cast("long")})
    return alone.unionByName(together)

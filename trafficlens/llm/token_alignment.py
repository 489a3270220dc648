"""Alignment of the tokens that two tokenizers make of the same texts.

Both cut the bytes of a text. Every token points to the token of the other kind that overlaps it and
reaches farthest to the right (the last one of a group, of the second tokenizer, to itself). Pointer
jumping (each pointer is replaced by the pointer of what it points to, for all tokens at once) leads
every token to the last one of its group in a number of rounds that grows with the logarithm of the
longest chain. Counts of overlapping pairs cover the whole corpus: texts are worked on in blocks of a
bounded size, each block asks once for every pair it holds, and gets the corpus-wide counts back.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once_per_worker, stored, text_batches
from .packing import ByteBpe
from .piece_spans import _gathered, _names, piece_model

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 1 << 19


class ByteTokens(ByteBpe):
    """Ids of a byte-level BPE file; strings of special tokens are plain text."""

    def __init__(self, path: str, pattern: str):
        super().__init__(path, pattern)
        tokens = [b""] * self.whole.n_vocab
        for token, i in self.whole._mergeable_ranks.items():
            tokens[i] = token
        self.sizes = np.array([len(t) for t in tokens])
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def plain(self, text: str) -> np.ndarray:
        return self.whole.encode_to_numpy(text, disallowed_special=())


def jumped(pointers: np.ndarray) -> np.ndarray:
    """Where each chain of pointers ends; an end points to itself."""
    while True:
        after = pointers[pointers]
        if np.array_equal(after, pointers):
            return after
        pointers = after


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and each B token, as the index of the group's last B token.

    Both rows of ends cover the same bytes; groups do not reach across a place where both end.
    """
    n = len(a_ends)
    to_b, to_a = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
    own = np.arange(len(b_ends))
    back = np.where(a_ends[to_a] > b_ends, to_a, n + own) if n else n + own
    ends = jumped(np.concatenate([n + to_b, back])) - n
    return ends[:n], ends[n:]


def links_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of every overlap: between two neighbouring ends lies exactly one."""
    both = []
    marks = np.zeros((2, a_ends[-1] + 1 if len(a_ends) else 1), dtype=bool)
    marks[0, a_ends] = marks[1, b_ends] = True
    at = np.flatnonzero(marks[0] | marks[1])
    for mark in marks:
        here = mark[at]
        both.append(np.cumsum(here) - here)
    return both[0], both[1]


def _decimals(size: int):
    """Decimal numbers up to ``size`` with each of the signs , | ; behind them, as flat bytes."""
    all_ = [b"%d%s" % (i, sign) for sign in (b",", b"|", b";") for i in range(size)]
    sizes = np.array([len(x) for x in all_])
    return np.frombuffer(b"".join(all_), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def _written(a_ids, a_group, b_ids, b_group, decimals) -> tuple[bytes, np.ndarray]:
    """All groups as text, each ended by ; and the ends of the tokens in it, in order."""
    flat, firsts, sizes = decimals
    size = len(sizes) // 3
    a_more = np.append(a_group[1:] == a_group[:-1], False)
    b_more = np.append(b_group[1:] == b_group[:-1], False)
    codes = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
    codes[np.arange(len(a_ids)) + np.searchsorted(b_group, a_group)] = a_ids + np.where(a_more, 0, size)
    codes[np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, side="right")] = b_ids + np.where(b_more, 0, 2 * size)
    return _gathered(flat, firsts[codes], sizes[codes]).tobytes(), np.cumsum(sizes[codes])


def _packed(numbers: np.ndarray) -> bytes:
    """Sorted numbers below 2**32 as their steps, byte plane by byte plane, which compresses well."""
    return np.diff(numbers, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view("<u4").ravel(), dtype=np.int64)


COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
BLOCKS = f"{COUNTED}, block long, links binary, pairs array<struct<pair: long, n: long>>"


def aligned_blocks(docs: DataFrame, byte_path: str, pattern: str, piece_path: str, digest: bool = False) -> DataFrame:
    """BLOCKS: what one text tells by itself, its links by their place among the block's pairs.

    ``pair`` is the A id times 2**32 plus the B id. The pairs of a block, in order, are in its first
    row. ``groups`` is the text `a1,a2|b1;a3|b2,b3`, or with ``digest`` its lower-case SHA-256.
    """

    def rows(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        a = once_per_worker(("byte_tokens", byte_path), lambda: ByteTokens(byte_path, pattern))
        b = piece_model(piece_path)
        top = max(len(a.sizes), len(b.sizes))
        decimals = once_per_worker(("decimals", top), lambda: _decimals(top))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, stop, texts in text_batches(batch, "text", BLOCK):
                out, links, (pairs, times) = _block(texts, a, b, decimals, digest)
                n = stop - start
                offsets = np.full(n + 1, len(pairs))
                offsets[0] = 0
                held = pa.StructArray.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])
                first = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), held)
                columns = [batch.column("doc_id").slice(start, n), *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4])]
                columns += [pa.repeat(pa.scalar(block, pa.int64()), n), pa.array(links, pa.binary()), first]
                yield pa.record_batch(columns, names=_names(COUNTED) + ["block", "links", "pairs"])
                block += 1

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(rows, BLOCKS)


def _block(texts: list[bytes], a: ByteTokens, b, decimals, digest: bool):
    """(n_a, n_b, n_groups, n_links, groups) of the texts, their packed links, the block's pairs."""
    n = len(texts)
    a_ids = [a.plain(" " + t.decode()).astype(np.int64) if t else np.zeros(0, np.int64) for t in texts]
    b_ids, _, _, bounds = b.encode_batch(texts)
    b_ids = [b_ids[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    whole = b"".join([b" " + t if t else b"" for t in texts])
    # a text of which either makes other bytes has no tokens
    for ids, kind in ((a_ids, (a.flat, a.firsts, a.sizes)), (b_ids, (b.out_bytes, b.out_firsts, b.out_sizes))):
        each = np.concatenate(ids)
        if _gathered(kind[0], kind[1][each], kind[2][each]).tobytes() != whole:
            for k, t in enumerate(texts):
                if t and _gathered(kind[0], kind[1][ids[k]], kind[2][ids[k]]).tobytes() != b" " + t:
                    a_ids[k] = b_ids[k] = np.zeros(0, np.int64)
            whole = b"".join([b" " + t if len(i) else b"" for t, i in zip(texts, a_ids, strict=True)])
    a_tops, b_tops = (np.cumsum([0] + [len(i) for i in ids]) for ids in (a_ids, b_ids))
    a_ids, b_ids = np.concatenate(a_ids), np.concatenate(b_ids)
    a_ends, b_ends = np.cumsum(a.sizes[a_ids]), np.cumsum(b.out_sizes[b_ids])
    a_group, b_group = groups_of(a_ends, b_ends)
    lasts = b_group == np.arange(len(b_group))
    n_groups = np.diff(np.concatenate([[0], np.cumsum(lasts)])[b_tops])
    text, ends = _written(a_ids, a_group, b_ids, b_group, decimals)
    edges = np.concatenate([[0], ends])[a_tops + b_tops].tolist()
    groups = [text[i : max(i, j - 1)] for i, j in zip(edges[:-1], edges[1:], strict=True)]
    groups = [hashlib.sha256(g).hexdigest() if digest and g else g.decode() for g in groups]
    in_a, in_b = links_of(a_ends, b_ends)
    pairs, place, times = np.unique(a_ids[in_a] << 32 | b_ids[in_b], return_inverse=True, return_counts=True)
    tops = np.searchsorted(in_a, a_tops)
    place = np.sort(np.repeat(np.arange(n) << 32, np.diff(tops)) | place) & ((1 << 32) - 1)
    links = [_packed(place[i:j]) for i, j in zip(tops[:-1], tops[1:], strict=True)]
    return (np.diff(a_tops), np.diff(b_tops), n_groups, np.diff(tops), groups), links, (pairs, times)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count, best: the links of each pair in all texts; whether no A id of the B id has more.

    A B id has as many pairs as the first vocabulary has ids at most.
    """
    pairs = blocks.select(F.inline("pairs"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    piece = F.col("pair").bitwiseAND((1 << 32) - 1)
    highest = counts.groupBy(piece.alias("piece")).agg(F.max("count").alias("highest"))
    return counts.withColumn("piece", piece).join(highest, "piece").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


RESULT = f"{COUNTED}, n_best long, count_sum long"


def aligned_documents(docs: DataFrame, byte_path: str, pattern: str, piece_path: str, digest: bool = False) -> DataFrame:
    """RESULT, one row per row of ``docs``.

    A tokens are those of the byte-level file for a blank and the text, B tokens those of the piece
    model for the text, without special tokens. Groups are cut where both end. Links are the pairs
    of overlapping tokens; ``count_sum`` adds the corpus-wide counts of their id pairs, ``n_best``
    counts links whose count is the highest of their B id, ties included. A text that is null, empty
    or of which either tokenizer makes other bytes has no tokens: zeros and empty ``groups``. Texts
    of any length are aligned whole, one above BLOCK bytes by itself. Repeated rows count each and
    null ids are kept; other columns are left aside. An empty table gives no rows.
    """
    blocks = stored(aligned_blocks(docs, byte_path, pattern, piece_path, digest), "aligned")
    known = stored(pair_counts(blocks), "pairs")
    asked = blocks.select("block", F.inline("pairs")).select("block", "pair")
    told = asked.join(known, "pair").select("block", "pair", "count", "best")
    names = _names(COUNTED)

    def rows(left, right):
        import pyarrow as pa

        order = np.argsort(right.column("pair").to_numpy())
        count, best = (right.column(c).to_numpy()[order].astype(np.int64) for c in ("count", "best"))
        links = [_unpacked(x) for x in left.column("links").to_pylist()]
        sums = [pa.array([int(of[i].sum()) for i in links], pa.int64()) for of in (best, count)]
        return pa.table([*(left.column(c) for c in names), *sums], names=_names(RESULT))

    texts = blocks.select(*names, "block", "links").toDF(*names, "block", "links")
    return texts.groupBy("block").cogroup(told.toDF(*told.columns).groupBy("block")).applyInArrow(rows, RESULT)

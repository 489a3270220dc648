"""A bigram language model by deleted interpolation, trained on and scoring whole documents.

    P(w | u) = L(u) * c(u, w) / c(u) + (1 - L(u)) * (c(w) + 1) / (N + V + 1)

L depends on how frequent the context u is: contexts are put in buckets by the logarithm of their
count, and each bucket's weight is learned by expectation-maximisation on held-out counts. Words
that training has not seen share the one extra type of the lower order.

Documents are put in blocks. A block asks for the counts of its distinct n-grams, all blocks'
requests meet by hash range, and the answers go back to the block, which then scores its texts. So
what is shuffled are distinct n-grams of blocks and each text once, and no task holds a table of
the whole corpus. The weights come from the held-out bigrams of part B of the training documents
and the exact counts of part A, which the same answers carry; scores use both parts.
"""

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BYTES, mixed, slices, stored, text_batches, word_hashes

#: Text of a block, on average, and n-grams that one task counts.
BLOCK_BYTES = 4 << 20
GRAMS = 800_000
#: Contexts by log2 of their count; ratios of the two estimates in steps of 1/32 octave.
BUCKETS, STEP, RATIOS = 48, 32, 4096
ROUNDS = 60

_END = np.uint64(0x1F0E3DC2B5A49687)
_START = np.uint64(0x7A3D91C05EB2F846)
_JOIN = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens and of what comes before each, and where each text's tokens begin.

    The tokens of a text are its words and one end. Texts are hashed a slice at a time, which
    bounds the memory that is needed beside the tokens.
    """
    found = [word_hashes(texts[a:b]) for a, b in slices(list(map(len, texts)), TEXT_BYTES)]
    words = np.concatenate([w for w, _ in found] or [np.zeros(0, dtype=np.uint64)])
    counts = np.concatenate([np.diff(b) for _, b in found] or [np.zeros(0, dtype=np.int64)])
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    n = len(texts)
    bounds = bounds + np.arange(n + 1)
    tokens = np.empty(bounds[-1], dtype=np.uint64)
    is_end = np.zeros(len(tokens), dtype=bool)
    is_end[bounds[1:] - 1] = True
    tokens[is_end] = _END
    tokens[~is_end] = words
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = _START
    return tokens, before, bounds


def pairs_of(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(before * _JOIN + tokens)


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, high bytes together, so that shuffles compress them."""
    gaps = np.diff(hashes, prepend=np.uint64(0))
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    """Counts as bytes: low bytes together, so that shuffles compress them."""
    return counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _large(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _parts(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    """doc_id, text, part: 0 not learned from, 1 counts (A), 2 held-out counts (B)."""
    away = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_out, F.lit(False))
    part = F.when(away, 0).when(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(5)) == 0, 2).otherwise(1)
    return docs.withColumn("part", part.cast("int"))


def _block(docs: DataFrame, size: int) -> Column:
    """The block of a row: its file, or none, cut by hash."""
    files = max(1, len(docs.inputFiles()))
    parts = max(1, -(-size // (files * BLOCK_BYTES)))
    return F.xxhash64(F.input_file_name(), F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(parts)))


REQUEST = "block long, kind int, range int, grams binary, a binary, b binary"


def _requests(docs: DataFrame, ranges: int) -> DataFrame:
    """REQUEST rows: a block's distinct words (kind 1) and bigrams (kind 2) of a hash range.

    ``a`` and ``b`` count them in parts A and B.
    """

    def rows(batches):
        import pyarrow as pa

        waiting, size = {}, 0

        def flush():
            for block, (texts, parts) in waiting.items():
                yield from asked(block, texts, np.array(parts))
            waiting.clear()

        def asked(block, texts, parts):
            tokens, before, bounds = token_hashes(texts)
            part = np.repeat(parts, np.diff(bounds))
            starts = np.full(len(parts), _START, dtype=np.uint64)
            pairs = pairs_of(before, tokens)
            out = {k: [] for k in ("block", "kind", "range", "grams", "a", "b")}
            for kind, grams, of in ((1, np.concatenate([tokens, starts]), np.concatenate([part, parts])), (2, pairs, part)):
                unique, place = np.unique(grams, return_inverse=True)
                a = np.bincount(place[of == 1], minlength=len(unique))
                b = np.bincount(place[of == 2], minlength=len(unique))
                edges = np.searchsorted((unique >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))
                for r in range(ranges):
                    i, j = int(edges[r]), int(edges[r + 1])
                    if i == j:
                        continue
                    for name, value in zip(out, (block, kind, r, _packed(unique[i:j]), _small(a[i:j]), _small(b[i:j])), strict=False):
                        out[name].append(value)
            yield pa.record_batch(
                [pa.array(out["block"], pa.int64()), pa.array(out["kind"], pa.int32()), pa.array(out["range"], pa.int32())]
                + [pa.array(out[k], pa.binary()) for k in ("grams", "a", "b")],
                names=list(out),
            )

        for batch in batches:
            blocks, parts = batch.column("block").to_pylist(), batch.column("part").to_pylist()
            for a, b, texts in text_batches(batch, "text"):
                for k, text in zip(range(a, b), texts, strict=True):
                    held = waiting.setdefault(blocks[k], ([], []))
                    held[0].append(text)
                    held[1].append(parts[k])
                    size += len(text)
                if size > 2 * BLOCK_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("block", "text", "part").mapInArrow(rows, REQUEST)


ANSWER = "block long, kind int, range int, totals binary, held binary, tokens long, types long, tokens_a long, types_a long"


def _answers(requests: DataFrame) -> DataFrame:
    """ANSWER rows: for each block the training counts of its n-grams of a range, in order.

    ``held`` has the counts in part A of those that the block has in part B, in order. Rows without
    a block hold what the range adds to N and V, of both parts and of part A alone.
    """

    def rows(key, table):
        import pyarrow as pa

        kind, r = (k.as_py() for k in key)
        blocks = table.column("block").to_numpy()
        grams = [_unpacked(g.as_py()) for g in table.column("grams")]
        a = np.concatenate([_large(x.as_py()) for x in table.column("a")])
        b = [_large(x.as_py()) for x in table.column("b")]
        unique, place = np.unique(np.concatenate(grams), return_inverse=True)
        in_a = np.bincount(place, weights=a, minlength=len(unique)).astype(np.int64)
        total = in_a + np.bincount(place, weights=np.concatenate(b), minlength=len(unique)).astype(np.int64)
        out = []
        order = np.argsort(blocks, kind="stable")
        edges = np.flatnonzero(np.diff(blocks[order], prepend=blocks[order[:1]] - 1)).tolist() + [len(order)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            of, held = [grams[k] for k in order[i:j]], [grams[k][b[k] > 0] for k in order[i:j]]
            mine, held = (x[0] if len(x) == 1 else np.unique(np.concatenate(x)) for x in (of, held))
            counts = (_small(n[np.searchsorted(unique, x)]) for n, x in ((total, mine), (in_a, held)))
            out.append((int(blocks[order[i]]), kind, r, *counts, None, None, None, None))
        if kind == 1:
            real = unique != _START
            sums = [int(f(n[real])) for n in (total, in_a) for f in (np.sum, np.count_nonzero)]
            out.append((None, kind, r, None, None, *sums))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4)
        names = ("block", "kind", "range", "totals", "held", "tokens", "types", "tokens_a", "types_a")
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))

    return requests.groupBy("kind", "range").applyInArrow(rows, ANSWER)


def _in_order(answered, column: str) -> dict[int, np.ndarray]:
    """Counts of a block's words (1) and bigrams (2) from its answers, in order of their hashes."""
    held = {1: [], 2: []}
    answered = answered.sort_by([("kind", "ascending"), ("range", "ascending")])
    for kind, counts in zip(answered.column("kind").to_pylist(), answered.column(column), strict=True):
        held[kind].append(_large(counts.as_py()))
    return {kind: np.concatenate(counts) for kind, counts in held.items()}


def _cells(docs: DataFrame, answers: DataFrame, n: int, v: int) -> DataFrame:
    """(cell, times): how many held-out bigrams have which context bucket and ratio of estimates.

    The estimates are those of part A, of ``n`` tokens and ``v`` types. Only texts of part B are read.
    """

    def rows(key, texts, answered):
        import pyarrow as pa

        cells = times = np.zeros(0, dtype=np.int64)
        if texts.num_rows:
            tokens, before, _ = token_hashes([t.as_py() or b"" for t in texts.column("text").cast(pa.large_binary())])
            counts = _in_order(answered, "held")
            unique, first, b = np.unique(pairs_of(before, tokens), return_index=True, return_counts=True)
            words = np.unique(np.concatenate([tokens, _START.reshape(1)]))
            c, context = (counts[1][np.searchsorted(words, x[first])] for x in (tokens, before))
            both = counts[2]
            low = (c + 1) / (n + v + 1)
            with np.errstate(divide="ignore"):
                ratio = np.log2(both) - np.log2(np.maximum(context, 1) * low)
            step = np.where(both > 0, np.clip(np.rint(ratio * STEP) + RATIOS // 2, 1, RATIOS - 1), 0).astype(np.int64)
            cells, at = np.unique(_bucket(context) * RATIOS + step, return_inverse=True)
            times = np.bincount(at, weights=b).astype(np.int64)
        return pa.table({"cell": pa.array(cells, pa.int64()), "times": pa.array(times, pa.int64())})

    held = docs.where("part = 2").select("block", "text").groupBy("block")
    answers = answers.select("block", "kind", "range", "held").groupBy("block")
    return held.cogroup(answers).applyInArrow(rows, "cell long, times long")


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)


def mixture_weights(cells: dict[int, float]) -> np.ndarray:
    """L of every context bucket by EM on held-out counts by cell (bucket, step of the ratio).

    A held-out bigram with ratio r of its two estimates belongs to the higher order with odds
    L * r to 1 - L. The mean of that over a bucket's counts is its next L.
    """
    weights = np.zeros(BUCKETS)
    for bucket in range(BUCKETS):
        mine = {c % RATIOS: n for c, n in cells.items() if c // RATIOS == bucket}
        n = np.array(list(mine.values()), dtype=float)
        if not n.sum():
            continue
        step = np.array(list(mine))
        ratio = np.where(step > 0, np.exp2((step - RATIOS // 2) / STEP), 0.0)
        weight = 0.5
        for _ in range(ROUNDS):
            weight = float((n * weight * ratio / (weight * ratio + 1 - weight)).sum() / n.sum())
        weights[bucket] = min(weight, 0.999)
    # a bucket without held-out counts takes the weight of the one below
    for bucket in range(1, BUCKETS):
        if not any(c // RATIOS == bucket for c in cells):
            weights[bucket] = weights[bucket - 1]
    return weights


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(docs: DataFrame, answers: DataFrame, n: int, v: int, weights: np.ndarray) -> DataFrame:
    """SCORE of every row: each block's texts with the answers to its requests."""

    def rows(key, texts, answered):
        import pyarrow as pa

        parts = texts.column("part").to_numpy()
        data = [t.as_py() or b"" for t in texts.column("text").cast(pa.large_binary())]
        tokens, before, bounds = token_hashes(data)
        pairs = pairs_of(before, tokens)
        totals = _in_order(answered, "totals")
        words = np.unique(np.concatenate([tokens, _START.reshape(1)]))
        c = totals[1][np.searchsorted(words, tokens)]
        context = totals[1][np.searchsorted(words, before)]
        both = totals[2][np.searchsorted(np.unique(pairs), pairs)]
        low = (c + 1) / (n + v + 1)
        weight = np.where(context > 0, weights[_bucket(context)], 0.0)
        p = weight * both / np.maximum(context, 1) + (1 - weight) * low
        sums = lambda x: np.add.reduceat(x, bounds[:-1])
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "held_out": pa.array(parts == 0),
                "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                "n_known": pa.array(sums((c > 0).astype(np.int64)), pa.int64()),
                "base_score": pa.array(sums(np.log10(low))),
                "score": pa.array(sums(np.log10(p))),
            }
        )

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rows, SCORE)


def document_scores(docs: DataFrame, folds: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows whose crc32(doc_id as text) mod ``folds`` is not ``held_out``; a null id
    is learned from. Tokens are words (runs of bytes other than white space, A-Z in lower case)
    and one end. A null or empty text is one end. n_known counts tokens that training has; the
    base score adds log10((c + 1) / (N + V + 1)), the score the model's log10 probabilities.
    Repeated rows are learned from and scored as often as they occur. Other columns are left
    aside. An empty table gives no rows. n-grams are told apart by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = _parts(docs, folds, held_out)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.withColumn("block", _block(docs, size))
    ranges = max(1, math.ceil(size / 8 / GRAMS))
    answers = stored(_answers(_requests(docs, ranges)), "answers")
    sums = answers.agg(*(F.sum(c) for c in ("tokens", "types", "tokens_a", "types_a"))).first()
    n, v, n_a, v_a = (int(x or 0) for x in sums)
    given = answers.where("block is not null")
    # at most BUCKETS * RATIOS numbers
    cells = _cells(docs, given, n_a, v_a).groupBy("cell").agg(F.sum("times").alias("times"))
    weights = mixture_weights(dict(cells.collect()))
    given = given.select("block", "kind", "range", "totals")
    return _scores(docs, given, n, v, weights).withColumn("train_tokens", F.lit(n).cast("long"))

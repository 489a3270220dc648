"""Hard negatives by zone maps over blocks of vectors in Hilbert order.

Vectors are sorted by label and by their place on a Hilbert curve through the dimensions that vary
most, and written as Parquet in blocks of neighbours. Each block has a zone map: the least and the
greatest value of every dimension, and its labels. For an anchor, interval arithmetic over a zone map
bounds every inner product inside the block. A first search, of the file the anchor lies in, gives a
score that its positives reach; blocks of its label that cannot reach it are not read. The scores of
the positives set the windows for negatives; blocks whose bounds meet no window are not read either.
What is read is scored exactly, best bound first, and stops at the score already reached.
"""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors in a block, blocks in a file (what one task scores), anchors that a task scores.
BLOCK, FILE, ANCHORS = 512, 16, 1024
#: Zone maps that one task compares with its anchors.
ZONES = 4096
#: Dimensions of the curve, and bits of each.
CURVE, BITS = 15, 4
SCALE = 256


def whole_rows(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, dims, v): floor(scale * x) of the rows that take part, repeated ones once."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fine, F.lit(False)))
    wide = F.exists("embedding", lambda c: F.abs(c) * float(scale) >= float(1 << 31))
    error = F.raise_error(F.lit("a component is too large for exact 64-bit scores"))
    v = F.transform(F.when(wide, error).otherwise(F.col("embedding")), lambda c: F.floor(c * float(scale)).cast("long"))
    return rows.select("vec_id", "label", F.size("embedding").alias("dims"), v.alias("v")).distinct()


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows; in floating point where every sum is exact in it."""
    most = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * left.shape[1]
    if most < 1 << 53:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        raise OverflowError("inner products do not fit 64 bits")
    return left @ right.T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector in each box."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def hilbert(codes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of ``codes`` (unsigned, ``bits`` each)."""
    x = codes.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            swap = (x[0] ^ x[i]) & (q - 1)
            flip = (x[i] & q) != 0
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= np.where(flip, 0, swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | x[i] >> bit & 1
    return place


def _spread(rows: DataFrame) -> dict:
    """For each number of dimensions: the curve's dimensions, their means and deviations."""

    def sums(batches):
        import pyarrow as pa

        found = {}
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                v = _matrix(batch.column("v").filter(pa.array(dims == d))).astype(np.float64)
                found[d] = found.get(d, 0) + np.stack([np.full(d, len(v)), v.sum(axis=0), (v * v).sum(axis=0)])
        yield pa.record_batch({"dims": pa.array(list(found), pa.int32()), "s": pa.array([s.ravel().tolist() for s in found.values()], pa.list_(pa.float64()))})

    at = F.posexplode("s").alias("at", "x")
    parts = rows.select("dims", "v").mapInArrow(sums, "dims int, s array<double>").select("dims", at)
    wide = parts.groupBy("dims", "at").agg(F.sum("x").alias("x")).groupBy("dims").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("s"))
    out = {}
    for row in wide.collect():  # one row per number of dimensions
        n, total, squares = np.array([x for _, x in row["s"]]).reshape(3, -1)
        mean = total / n
        deviation = np.sqrt(np.maximum(squares / n - mean**2, 0))
        use = np.sort(np.argsort(-deviation, kind="stable")[:CURVE])
        out[row["dims"]] = use, mean[use], np.maximum(deviation[use], 1e-9)
    return out


BLOCKS = "dims int, file long, block long, vec_id long, label long, v array<long>, low array<long>, high array<long>, least long, most long"


def hilbert_blocks(rows: DataFrame) -> DataFrame:
    """BLOCKS: the rows of ``whole_rows`` in blocks of neighbours on the curve, in curve order.

    The first row of a block holds its zone map: low, high (of every dimension), least and most label.
    """
    spread = _spread(rows)
    order = ["dims", "label", "place", "vec_id"]

    def placed(batches):
        import pyarrow as pa

        for batch in batches:
            dims, place = batch.column("dims").to_numpy(), np.zeros(batch.num_rows, dtype=np.int64)
            for d in np.unique(dims).tolist():
                use, mean, deviation = spread[d]
                here = dims == d
                v = _matrix(batch.column("v").filter(pa.array(here)))[:, use]
                codes = np.floor((v - mean) / deviation * (1 << BITS - 2)) + (1 << BITS - 1)
                place[here] = hilbert(np.clip(codes, 0, (1 << BITS) - 1).astype(np.int64), BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        count, held = 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows > BLOCK:
                n = _same(held.column("dims").to_numpy()[:BLOCK])
                yield _block(held.slice(0, n), first, count)
                held, count = held.slice(n).combine_chunks(), count + 1
        while held is not None and held.num_rows:
            n = _same(held.column("dims").to_numpy()[:BLOCK])
            yield _block(held.slice(0, n), first, count)
            held, count = held.slice(n), count + 1

    keyed = rows.mapInArrow(placed, "vec_id long, label long, dims int, v array<long>, place long")
    parts = max(1, -(-rows.count() // (BLOCK * FILE * 4)))
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(cut, BLOCKS)


def _same(values: np.ndarray) -> int:
    """How many of the first values are alike."""
    other = np.flatnonzero(values != values[0])
    return int(other[0]) if len(other) else len(values)


def _block(table, first: int, count: int):
    import pyarrow as pa

    n, v, label = table.num_rows, _matrix(table.column("v")), table.column("label").to_numpy()
    rest = [None] * (n - 1)
    columns = [
        table.column("dims").combine_chunks(), pa.array(np.full(n, first + count // FILE)), pa.array(np.full(n, first + count)),
        *(table.column(c).combine_chunks() for c in ("vec_id", "label", "v")),
        *(pa.array([x.tolist(), *rest], pa.list_(pa.int64())) for x in (v.min(axis=0), v.max(axis=0))),
        *(pa.array([int(x), *rest], pa.int64()) for x in (label.min(), label.max())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCKS.split(", ")])


#: What a search asks: the rows wanted are of the anchor's label or not, with scores in a window.
ASKED = ["dims", "part", "vec_id", "label", "v", "asks"]


def chosen_blocks(asked: DataFrame, zones: DataFrame, same: bool) -> DataFrame:
    """(dims, part, file, block, vec_id): the blocks that each anchor must read.

    ``asks`` holds the windows (low, high) of scores; a block is read if its bounds meet one of them
    and its labels allow. Zone maps are compared in groups of ZONES, anchors in parts.
    """

    def rows(key, left, right):
        import pyarrow as pa

        found = pa.table({"file": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64())})
        if left.num_rows and right.num_rows:
            least, most = bounds(_matrix(left.column("v")), _matrix(right.column("low")), _matrix(right.column("high")))
            label = left.column("label").to_numpy()[:, None]
            first, last = (right.column(c).to_numpy()[None, :] for c in ("least", "most"))
            allowed = (first <= label) & (label <= last) if same else (first != label) | (last != label)
            meets = np.zeros(allowed.shape, dtype=bool)
            for i, windows in enumerate(left.column("asks").to_pylist()):
                for w in windows:
                    meets[i] |= (most[i] >= w["low"]) & (least[i] <= w["high"])
            at, of = np.nonzero(allowed & meets)
            take = pa.array(of)
            found = pa.table({"file": right.column("file").take(take), "block": right.column("block").take(take), "vec_id": left.column("vec_id").take(pa.array(at))})
        keys = {k: pa.repeat(pa.scalar(key[i].as_py(), t), found.num_rows) for i, (k, t) in enumerate((("dims", pa.int32()), ("part", pa.int64())))}
        return pa.table({**keys, **{c: found.column(c) for c in found.column_names}})

    groups = zones.groupBy("dims").agg(F.ceil(F.count("*") / ZONES).alias("groups"))
    parts = asked.groupBy("dims").agg(F.max("part").alias("parts"))
    zones = zones.join(groups, "dims").join(parts, "dims")
    zones = zones.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), "parts")))
    zones = zones.withColumn("group", F.pmod(F.xxhash64("block"), "groups"))
    zones = zones.select("dims", "part", "group", "file", "block", "low", "high", "least", "most")
    left = asked.join(groups, "dims").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    left = left.select(*ASKED, "group")
    keys = ["dims", "part", "group"]
    left, zones = left.toDF(*left.columns), zones.toDF(*zones.columns)
    return left.groupBy(*keys).cogroup(zones.groupBy(*keys)).applyInArrow(rows, "dims int, part long, file long, block long, vec_id long")


HITS = "anchor_id long, anchor_label long, ask long, low long, high long, score long, vec_id long"


#: Below every score.
_NONE = -(1 << 63) + 1


def _file_hits(left, right, same: bool, k: int) -> list[np.ndarray]:
    """Columns of HITS: the best ``k`` of one file for each window of one part's anchors."""
    anchors, label, own = _matrix(left.column("v")), left.column("label").to_numpy(), left.column("vec_id").to_numpy()
    v, ids, labels = _matrix(right.column("v")), right.column("vec_id").to_numpy(), right.column("label").to_numpy()
    names, of = np.unique(right.column("block").to_numpy(), return_inverse=True)
    wanted = np.zeros((len(own), len(names)), dtype=bool)
    for i, blocks in enumerate(left.column("blocks").to_pylist()):
        wanted[i, np.searchsorted(names, blocks)] = True
    asks = [(i, w["ask"], w["low"], w["high"]) for i, windows in enumerate(left.column("asks").to_pylist()) for w in windows]
    owner, ask, low, high = (np.array(c, dtype=np.int64) for c in zip(*asks, strict=True))
    score, vec_id = np.full((len(asks), k), _NONE), np.full((len(asks), k), np.iinfo(np.int64).max)
    reached = low.copy()
    inside = [np.flatnonzero(of == b) for b in range(len(names))]
    boxes = [np.stack([f(v[at], axis=0) for at in inside]) for f in (np.min, np.max)]
    least, most = bounds(anchors, *boxes)
    # blocks of the highest bounds first, so that later ones are left out more often
    for b in np.argsort(-most.max(axis=0), kind="stable").tolist():
        at = inside[b]
        open_ = np.flatnonzero(wanted[owner, b] & (most[owner, b] >= reached) & (least[owner, b] <= high))
        if not len(open_):
            continue
        some, place = np.unique(owner[open_], return_inverse=True)
        fit = ((labels[at] == label[some, None]) == same) & (ids[at] != own[some, None])
        each = np.where(fit, products(anchors[some], v[at]), _NONE)[place]
        fits = (each >= reached[open_, None]) & (each <= high[open_, None])
        for r in np.flatnonzero(fits.any(axis=1)).tolist():
            w = open_[r]
            scores = np.concatenate([score[w], each[r, fits[r]]])
            others = np.concatenate([vec_id[w], ids[at[fits[r]]]])
            order = np.lexsort((others, -scores))[:k]
            score[w], vec_id[w] = scores[order], others[order]
            reached[w] = max(low[w], score[w, -1])
    w, rank = np.nonzero(score != _NONE)
    return [own[owner[w]], label[owner[w]], ask[w], low[w], high[w], score[w, rank], vec_id[w, rank]]


def _searched(asked: DataFrame, blocks: DataFrame, chosen: DataFrame, same: bool, k: int) -> DataFrame:
    """HITS: the best ``k`` of each file for each window, from the chosen blocks."""

    def rows(key, left, right):
        import pyarrow as pa

        found = [np.zeros(0, dtype=np.int64)] * 7
        if left.num_rows and right.num_rows:
            found = _file_hits(left, right, same, k)
        return pa.table({c.split()[0]: pa.array(x, pa.int64()) for c, x in zip(HITS.split(", "), found, strict=True)})

    read = blocks.join(chosen.select("dims", "part", "file", "block").distinct(), ["dims", "file", "block"])
    read = read.select("dims", "part", "file", "block", "vec_id", "label", "v")
    per = chosen.groupBy("dims", "part", "file", "vec_id").agg(F.collect_list("block").alias("blocks"))
    left = asked.join(per, ["dims", "part", "vec_id"]).select(*ASKED, "file", "blocks")
    keys = ["dims", "part", "file"]
    left, read = left.toDF(*left.columns), read.toDF(*read.columns)
    return left.groupBy(*keys).cogroup(read.groupBy(*keys)).applyInArrow(rows, HITS)


def _first(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` hits of each window, ranked; each file's best are merged before the shuffle."""
    order = Window.partitionBy("anchor_id", "anchor_label", "ask").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE
) -> DataFrame:
    """RESULT: for each anchor and positive its hardest negatives inside the window, exactly.

    Anchors are the rows whose vec_id is divisible by ``every``. Scores are inner products of
    floor(scale * x) in 64-bit integers. An anchor's positives are the best ``positives`` rows of
    its label and another id; the negatives of a positive are the best ``negatives`` rows of other
    labels with low * p <= 100 * score <= high * p. Ties go to the smaller vec_id; where fewer rows
    fit, all are given; a positive without any gives no row.

    Rows with a null vec_id or label, a null or empty vector, or a null or non-finite component take
    no part. Vectors of different length do not meet. Repeated rows count once; rows of one vec_id
    that differ are rows of their own, but never partners of each other. A component of 2**31 or
    more after scaling raises an error. Other columns are left aside; an empty table gives no rows.
    """
    rows = stored(whole_rows(vectors, scale), "whole")
    blocks = stored(hilbert_blocks(rows), "blocks")
    zones = blocks.where("low is not null").select("dims", "file", "block", "low", "high", "least", "most")
    anchors = blocks.where(F.col("vec_id") % every == 0).drop("low", "high", "least", "most")
    parts = anchors.groupBy("dims").agg(F.ceil(F.count("*") / ANCHORS).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id", "label"), "parts")
    anchors = stored(anchors.join(parts, "dims").withColumn("part", part).drop("parts"), "anchors")
    ask = lambda a, b: F.array(F.struct(F.lit(0).cast("long").alias("ask"), a.alias("low"), b.alias("high")))
    far = 1 << 62

    # positives: the anchor's own file first, then what can reach the score found there
    any_score = ask(F.lit(-far), F.lit(far))
    near = zones.alias("z").join(anchors.select("dims", "part", "vec_id", "label", "file").distinct().alias("a"), ["dims", "file"])
    near = near.where("z.least <= a.label and a.label <= z.most").select("dims", "part", "file", "block", "vec_id").distinct()
    columns = ["dims", "part", "vec_id", "label", "v"]
    own = _searched(anchors.select(*columns, any_score.alias("asks")), blocks, near, True, positives)
    own = stored(own, "own")
    reached = _first(own, positives).groupBy("anchor_id", "anchor_label").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    reached = reached.where(F.col("n") >= positives).select(F.col("anchor_id").alias("vec_id"), F.col("anchor_label").alias("label"), "least")
    asked = anchors.join(reached, ["vec_id", "label"], "left")
    asked = asked.select(*columns, ask(F.coalesce("least", F.lit(-far)), F.lit(far)).alias("asks"))
    chosen = chosen_blocks(asked, zones, True).join(near, ["dims", "part", "file", "block", "vec_id"], "left_anti")
    more = _searched(asked, blocks, stored(chosen, "chosen"), True, positives)
    best = stored(_first(own.union(more).distinct(), positives), "positives")

    # negatives: a window per positive
    windows = best.where("score >= 0").groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_label").alias("label"))
    lowest = F.expr(f"({low} * score + 99) div 100")
    windows = windows.agg(F.collect_list(F.struct(F.col("rank").cast("long").alias("ask"), lowest.alias("low"), F.expr(f"({high} * score) div 100").alias("high"))).alias("asks"))
    asked = anchors.join(windows, ["vec_id", "label"]).select(*columns, "asks")
    chosen = stored(chosen_blocks(asked, zones, False), "chosen")
    hits = _first(_searched(asked, blocks, chosen, False, negatives), negatives)
    hits = hits.select("anchor_id", "anchor_label", "ask", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = best.select("anchor_id", "anchor_label", F.col("rank").cast("long").alias("ask"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = hits.join(of, ["anchor_id", "anchor_label", "ask"])
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

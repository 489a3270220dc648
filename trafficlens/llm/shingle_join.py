"""Similarity join of documents on word shingles, by prefixes of adaptive length.

Two documents of Jaccard similarity ``t`` or more share many shingles. When every document orders
its shingles alike (rare ones first), two such documents share at least L of their first
``n - ceil(t * n) + L`` ones. A larger L lengthens the prefix a little and asks for L shared
shingles before a pair is verified, so chance meetings are not verified at all. Each document
picks L by an estimated cost; for a pair the smaller L holds.

Steps

1. One row a document: size and digest of its set. Equal sets are one class.
2. A table of fixed size counts shingles by hash bucket; it gives the order and the estimated cost.
3. Prefix shingles are dealt by shingle. Those that several classes hold are kept as postings.
4. Stars: in each list of a shingle, every member is paired with two centres. Pairs that share
   some shingles are verified on their whole sets, and links unite components. Most components are
   found here at two rows a posting.
5. Lists that still hold several components are compared in full. Classes that share lists form
   blocks; two blocks that share enough shingles form a cell, and a task computes the exact overlap
   of all classes of a cell that are in two components.

Members of one component need not meet again: what is asked for are the components, and links
inside one can't change them. Pairs are never rows of a table, so thousands of near copies, and
thousands of texts that are almost similar enough, cost rows in proportion to their number.
"""

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, key_filter, maybe_in, shingle_hashes, stored, text_batches

SHINGLE = 5
PERCENT = 75
#: Buckets of the counting table: a fixed size (2 MB), sent to every task.
BUCKETS = 1 << 18
#: L that a document may pick, and the cost of verifying one shingle against reading a posting.
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
VERIFY_COST = 0.05
#: Half the centres that the lists of one group pick for stars; classes in a block at most, on average.
CENTRES, BLOCK = 8, 128


def _sets(batches, make):
    """Run ``make(rows, sets)`` over shingle sets of slices of the batches."""
    for batch in batches:
        for a, b, texts in text_batches(batch, "text"):
            yield from make(batch.slice(a, b - a), shingle_hashes(texts, SHINGLE))


def _digest(shingles: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _class_key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def set_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, cls, digest) of every row; cls and digest are null for an empty set."""

    def rows(batches):
        import pyarrow as pa

        def make(batch, sets):
            digests = [_digest(s) if len(s) else None for s in sets]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "cls": pa.array([d and _class_key(d) for d in digests], pa.int64()),
                    "digest": pa.array(digests, pa.binary()),
                }
            )

        yield from _sets(batches, make)

    schema = "doc_id long, n_shingles long, cls long, digest binary"
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many shingles fall in each hash bucket; a batch counts equal sets once."""

    def rows(batches):
        import pyarrow as pa

        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            known = set()
            for _, _, texts in text_batches(batch, "text"):
                new = {_digest(s): s for s in shingle_hashes(texts, SHINGLE) if len(s)}
                new = [s for digest, s in new.items() if digest not in known and not known.add(digest)]
                if new:
                    bucket = np.concatenate(new) % np.uint64(BUCKETS)
                    counts += np.bincount(bucket.astype(np.int64), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.record_batch({"bucket": pa.array(used, pa.int64()), "n": pa.array(counts[used], pa.int64())})

    sums = docs.select("text").mapInArrow(rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # at most BUCKETS rows
    table = np.zeros(BUCKETS, dtype=np.int64)
    table[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return table


def prefix_of(
    shingles: np.ndarray, counts: np.ndarray, usual: float, percent: int = PERCENT
) -> tuple[np.ndarray, int]:
    """The prefix of one set, shingles of emptier buckets first, and its L.

    ``counts`` are those of the shingles' buckets, functions of the shingle alone, so all documents
    order alike. What is above the ``usual`` count is taken for the shingle's own frequency. The
    cost of L is that of reading the prefix's lists and of verifying the sets that can meet L
    times in them.
    """
    n = len(shingles)
    order = np.lexsort((shingles, counts))
    least = -(-percent * n // 100)
    load = np.cumsum(np.maximum(counts[order] - usual, 0) + 1.0)
    best, cost = 1, math.inf
    for match in MATCHES:
        if match > least:
            break
        size = n - least + match
        now = load[size - 1] * (1 + VERIFY_COST * n / match)
        if now < cost:
            best, cost = match, now
    return shingles[order[: n - least + best]], best


def prefixes(docs: DataFrame, counts: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(cls, n, need, shingles): the prefix of every set, one row per set and batch."""
    spark = docs.sparkSession
    usual = float(counts.mean() + math.sqrt(counts.mean()))
    shared = spark.sparkContext.broadcast(counts)

    def rows(batches):
        import pyarrow as pa

        table = shared.value
        for batch in batches:
            known = set()
            for _, _, texts in text_batches(batch, "text"):
                out = {"cls": [], "n": [], "need": [], "shingles": []}
                for s in shingle_hashes(texts, SHINGLE):
                    if not len(s):
                        continue
                    digest = _digest(s)
                    if digest in known:
                        continue
                    known.add(digest)
                    prefix, need = prefix_of(s, table[(s % np.uint64(BUCKETS)).astype(np.int64)], usual, percent)
                    out["cls"].append(_class_key(digest))
                    out["n"].append(len(s))
                    out["need"].append(need)
                    out["shingles"].append(prefix.view(np.int64))
                yield pa.record_batch(
                    {
                        "cls": pa.array(out["cls"], pa.int64()),
                        "n": pa.array(out["n"], pa.int32()),
                        "need": pa.array(out["need"], pa.int32()),
                        "shingles": pa.array(out["shingles"], pa.list_(pa.int64())),
                    }
                )

    return docs.select("text").mapInArrow(rows, "cls long, n int, need int, shingles array<long>")


def set_arrays(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, shingles) of the given classes: whole sets, sorted, as bytes of 64-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(classes, "cls"))

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            known = set()
            for _, _, texts in text_batches(batch, "text"):
                sets = [s for s in shingle_hashes(texts, SHINGLE) if len(s)]
                keys = np.array([_class_key(_digest(s)) for s in sets], dtype=np.int64)
                keep = []
                for i in np.flatnonzero(maybe_in(shared.value, keys)).tolist():
                    if keys[i] not in known:
                        known.add(keys[i])
                        keep.append(i)
                yield pa.record_batch(
                    {
                        "cls": pa.array(keys[keep], pa.int64()),
                        "shingles": pa.array([sets[i].tobytes() for i in keep], pa.binary()),
                    }
                )

    found = docs.select("text").mapInArrow(rows, "cls long, shingles binary")
    # the batches of a class that many texts have each give it once
    return found.join(classes, "cls", "left_semi").groupBy("cls").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left = arrays.select(F.col("cls").alias("a"), F.col("shingles").alias("of_a"))
    right = arrays.select(F.col("cls").alias("b"), F.col("shingles").alias("of_b"))
    met = pairs.join(right, "b").join(left, "a")

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column("of_a"), batch.column("of_b")
            keep = []
            for i in range(batch.num_rows):
                x = np.frombuffer(a[i].as_buffer(), dtype=np.uint64)
                y = np.frombuffer(b[i].as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch({k: batch.column(k).filter(keep) for k in ("a", "b")})

    return met.select("a", "b", "of_a", "of_b").mapInArrow(rows, "a long, b long")


def _fits(percent: int) -> str:
    """Sizes that allow the similarity, in columns n and m."""
    return f"100L * least(n, m) >= {percent}L * greatest(n, m)"


def postings(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(shingle, cls, n, need) of prefix shingles that two classes or more hold."""
    prefix = prefixes(docs, bucket_counts(docs), percent)
    lists = prefix.select("cls", "n", "need", F.explode("shingles").alias("shingle"))
    one = Window.partitionBy("shingle")
    held = lists.withColumns({"lo": F.min("cls").over(one), "hi": F.max("cls").over(one)}).where("lo <> hi")
    return held.select("shingle", "cls", "n", "need").dropDuplicates(["shingle", "cls"])


def _star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """In each list, every member with two centres.

    A hash picks the centres: the lists of one group of near copies pick some of ``2 * CENTRES``
    members, so a member that is unlike one centre meets others.
    """
    centres = [
        F.min(F.struct(F.xxhash64("cls", F.lit(turn), F.pmod("shingle", F.lit(CENTRES))), "cls", "n", "need"))
        for turn in range(2)
    ]
    per = lists.groupBy("shingle").agg(F.array_distinct(F.array(*centres)).alias("centres"))
    met = lists.join(per, "shingle").withColumn("centre", F.explode("centres")).where("cls <> centre.cls")
    met = met.withColumn("m", F.col("centre.n")).where(_fits(percent))
    return met.select(
        F.least("cls", "centre.cls").alias("a"),
        F.greatest("cls", "centre.cls").alias("b"),
        F.expr(f"(least(need, centre.need) + {CENTRES} - 1) div {CENTRES}").alias("need"),
    )


def _enough(pairs: DataFrame) -> DataFrame:
    """Pairs that share as many prefix shingles as they must."""
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("hits"), F.min("need").alias("need"))
    return shared.where("hits >= need").select("a", "b")


def _blocks(lists: DataFrame) -> DataFrame:
    """(cls, block): classes that share much come into one block, ``BLOCK`` of them or fewer.

    Each list names its class of smallest hash. A class takes as its label the one that its lists
    name most often, if that is as often as half its L; else it is alone. Equal labels are cut by
    hash into blocks. The choice of blocks never decides whether a pair meets.
    """
    near = F.struct(F.xxhash64("cls").alias("hash"), "cls")
    per = lists.groupBy("shingle").agg(F.min(near)["cls"].alias("near"))
    of = lists.join(per, "shingle").groupBy("cls", "near").agg(F.count("*").alias("times"), F.max("need").alias("need"))
    of = of.where("2 * times >= need and times > 1 or cls = near")
    of = of.groupBy("cls").agg(F.max(F.struct("times", "near"))["near"].alias("label"))
    of = lists.select("cls").distinct().join(of, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    sizes = of.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("cls", F.lit(7)), F.col("parts"))
    return of.join(sizes, "label").select("cls", F.xxhash64("label", part).alias("block"))


def _cells(lists: DataFrame) -> DataFrame:
    """(x, y): pairs of blocks, x <= y, that may hold a pair of classes to be verified.

    Two classes in two components that share L prefix shingles put L shingles in their blocks'
    cell, so a cell with fewer than its smallest L holds none.
    """
    comps = lists.groupBy("shingle", "block").agg(
        F.min("need").alias("need"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    )
    other = comps.toDF("shingle", *(f"{c}_y" for c in comps.columns[1:]))
    met = comps.join(other, "shingle").where("block <= block_y")
    met = met.where("least(lo, lo_y) <> greatest(hi, hi_y)")
    cells = met.groupBy(F.col("block").alias("x"), F.col("block_y").alias("y"))
    cells = cells.agg(F.count("*").alias("hits"), F.min(F.least("need", "need_y")).alias("need"))
    return cells.where("hits >= need").select("x", "y")


def forest(n: int, left, right) -> list[int]:
    """Positions of the links that a spanning forest of ``n`` nodes takes, in order."""
    root = list(range(n))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    taken = []
    for k, (i, j) in enumerate(zip(left, right, strict=True)):
        i, j = top(i), top(j)
        if i != j:
            root[max(i, j)] = min(i, j)
            taken.append(k)
    return taken


def similar_in_cell(sets: list[np.ndarray], comp: np.ndarray, percent: int = PERCENT):
    """Index pairs of similar sets in two components: exact overlaps, column block by block."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    of = np.repeat(np.arange(len(sets)), n)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.bincount(column, minlength=len(values))
    number = np.cumsum(held > 1) - 1
    keep = held[column] > 1
    of, column = of[keep], number[column[keep]]
    by = np.argsort(column, kind="stable")
    of, column = of[by], column[by]
    overlap = np.zeros((len(sets), len(sets)), dtype=np.float32)
    wide = 4096
    for at in range(0, int((held > 1).sum()), wide):
        a, b = np.searchsorted(column, [at, at + wide])
        has = np.zeros((len(sets), wide), dtype=np.float32)
        has[of[a:b], column[a:b] - at] = 1
        overlap += has @ has.T
    both = np.rint(overlap).astype(np.int64)
    similar = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    return np.nonzero(np.triu(similar & (comp[:, None] != comp[None, :]), 1))


def _verified_cells(cells: DataFrame, members: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, found by comparing all members of each cell."""
    sides = cells.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    held = sides.join(members, "block").select("x", "y", "cls", "comp").join(arrays, "cls")

    def rows(key, table):
        import pyarrow as pa

        sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in table.column("shingles")]
        i, j = similar_in_cell(sets, table.column("comp").to_numpy(), percent)
        taken = forest(len(sets), i.tolist(), j.tolist())
        cls = table.column("cls").to_numpy()
        return pa.table({"a": cls[i[taken]], "b": cls[j[taken]]})

    return held.groupBy("x", "y").applyInArrow(rows, "a long, b long")


def linked_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Verified links (a, b) of classes, enough of them to tie all that any links would tie."""
    every = stored(postings(docs, percent), "postings")
    # stars: cheap, and enough for most components
    alone = every.withColumn("comp", F.col("cls"))
    pairs = stored(_enough(_star_pairs(alone, percent)), "pairs")
    members = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    links = stored(_verified(pairs, set_arrays(docs, members), percent), "verified")
    # all that is left between components
    of = components(links, "a", "b").withColumnsRenamed({"node": "cls", "component": "comp"})
    lists = every.join(of, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    ends = lists.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    lists = stored(lists.join(ends.where("lo <> hi").select("shingle"), "shingle"), "open")
    blocks = stored(_blocks(lists), "blocks")
    cells = stored(_cells(lists.join(blocks, "cls")), "cells")
    sides = cells.select(F.explode(F.array("x", "y")).alias("block")).distinct()
    members = lists.select("cls", "comp").distinct().join(blocks, "cls").join(sides, "block")
    members = stored(members, "members")
    arrays = set_arrays(docs, members.select("cls"))
    return links.union(_verified_cells(cells, members, arrays, percent))


def similar_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs of bytes other than white space, A-Z in lower case; shingles are five words.
    Two documents link when their sets' Jaccard similarity is ``percent`` / 100 or more, by exact
    arithmetic on whole sets of 64-bit shingle hashes. component_id is the smallest doc_id that
    links lead to. A null or wordless text has an empty set and links with nothing. A row with a
    null doc_id takes part in no link and has a null component. Rows with one doc_id are one node:
    each keeps its own n_shingles. Other columns are left aside. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = stored(set_sizes(docs), "sizes")
    named = sizes.where("doc_id is not null and digest is not null")
    firsts = named.groupBy("n_shingles", "digest", "cls").agg(F.min("doc_id").alias("first_id"))
    copies = named.join(firsts, ["n_shingles", "digest", "cls"]).select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
    links = linked_classes(docs.where("doc_id is not null"), percent)
    names = firsts.select("cls", "first_id")
    named_links = (
        links.join(names.withColumnRenamed("cls", "a"), "a")
        .withColumnRenamed("first_id", "x")
        .join(names.withColumnRenamed("cls", "b"), "b")
        .select(F.col("x").alias("a"), F.col("first_id").alias("b"))
    )
    of = components(copies.union(named_links), "a", "b")
    out = sizes.join(of.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))

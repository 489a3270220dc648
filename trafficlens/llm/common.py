"""Helpers the operators share: tables in the shared folder, bounded filters, links to components."""

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.session import shared_folder

#: Python classes and constants of one task, kept while its worker lives.
_WORKER = {}


def once_per_worker(key, make):
    """What ``make`` gives, made once in each Python worker."""
    if key not in _WORKER:
        _WORKER[key] = make()
    return _WORKER[key]


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; set on the session if nothing named one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = shared_folder(spark)
        spark.sparkContext.setCheckpointDir(f"{folder}/checkpoints")
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` for columns of any name, those with dots too."""
    names = df.columns

    def rows(batches):
        import pyarrow as pa

        return function(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(rows, schema)


def named(names) -> list[Column]:
    """Columns by their names, which may hold dots."""
    return [F.col(f"`{name}`") for name in names]


def slices(sizes, limit: int):
    """Ranges of rows whose sizes add up to ``limit`` at most (or one larger row each)."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


# --- a filter of fixed size ------------------------------------------------------------------

#: Bits of a filter: 2 MB on the driver and in each worker, whatever the number of keys.
FILTER_BITS = 1 << 24


def _filter_bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = keys.view(np.uint64)
    mask = np.uint64(FILTER_BITS - 1)
    return keys & mask, (keys >> np.uint64(24)) & mask


def key_filter(keys: DataFrame, key: str) -> np.ndarray:
    """A Bloom filter (two bits a key) of the 64-bit hashes in column ``key``.

    It has a fixed size, so it may be sent to every task. With very many keys it lets more rows
    through; it never holds back a row whose key is in ``keys``.
    """
    k = F.col(key)
    mask = FILTER_BITS - 1
    both = F.array(k.bitwiseAND(mask), F.shiftrightunsigned(k, 24).bitwiseAND(mask))
    bits = keys.select(F.explode(both).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")
    )
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    rows = words.toArrow()
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return table


def maybe_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; false is certain."""
    hit = np.ones(len(keys), dtype=bool)
    for bit in _filter_bits(keys):
        word = table[(bit >> np.uint64(6)).astype(np.int64)].view(np.uint64)
        hit &= (word >> (bit & np.uint64(63)) & np.uint64(1)) == 1
    return hit


def without_keys(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is not among ``keys`` (distinct, not null); null ones stay.

    Only rows that a filter of fixed size can't rule out are shuffled for the exact join.
    """
    table = rows.sparkSession.sparkContext.broadcast(key_filter(keys.select(F.xxhash64(column).alias("key")), "key"))
    names = rows.columns

    def part(hits):
        def chosen(batches):
            import pyarrow as pa

            for batch in batches:
                found = maybe_in(table.value, batch.column(len(names)).to_numpy())
                kept = batch.filter(pa.array(found == hits))
                yield pa.record_batch(kept.columns[:-1], names=names)

        return chosen

    marked = rows.withColumn("key of the row", F.xxhash64(column))
    sure, open_ = (mapped(marked, part(hits), rows.schema) for hits in (False, True))
    return sure.unionByName(open_.join(keys.select(column), column, "left_anti").select(named(names)))


# --- components ------------------------------------------------------------------------------


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node with a link to another; component is the smallest node.

    Alternates two rounds until nothing changes: every larger neighbour is tied to the smallest
    one, then every smaller neighbour too. The links shrink to one star a component in a number
    of rounds that grows with the logarithm of the longest path. Each round is written, so a
    lost executor costs one round. A node that is tied to millions of others is a large key of
    joins that adaptive execution splits, and of aggregates that combine before the shuffle.
    """
    a, b = F.col(left), F.col(right)
    links = stored(
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    seen = _fingerprint(links)
    while seen[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.min("v").alias("m"))
        nearest = nearest.select("u", F.least("u", "m").alias("m"))
        larger = both.where("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = stored(larger.distinct(), "stars")
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(smaller.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _fingerprint(links)
        if now == seen:
            break
        seen = now
    least = links.groupBy("u").agg(F.min("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return least.select(F.col("u").alias("node"), "component").union(roots)


def _fingerprint(links: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    return tuple(links.agg(F.count("*"), total).first())


# --- words -----------------------------------------------------------------------------------

#: A word is a run of bytes other than these; A to Z count as a to z.
WHITE = b" \t\n\x0b\x0c\r"
WORDS_SQL = r"[^\x20\x09-\x0D]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True
#: Random odd 64-bit values for bytes and a base; fixed by the seed, alike in every worker.
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * 2 + 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bytes of text that are worked on at once; a longer text is worked on alone.
TEXT_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values so that every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _WORKER.get("powers")
    if have is None or len(have[0]) < n:
        n = max(n, TEXT_BYTES + (1 << 18))
        both = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = tuple(both)
        if n <= 8 * TEXT_BYTES:
            _WORKER["powers"] = have
    return have


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and where each text's words begin (and end).

    Equal words have equal hashes in every task. Two given words differ but for odds near 2**-60.
    """
    _, _, _, hashes, bounds = word_places(texts)
    return hashes, bounds


def word_places(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, begins and ends of their words in them, and what word_hashes gives."""
    whole = b"\n".join(texts) + b"\n"
    joined = np.frombuffer(whole, dtype=np.uint8)
    lower = _LOWER[joined]
    white = _IS_WHITE[joined]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(joined) + 1)
    sums = np.empty(len(joined) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[lower] * up[: len(joined)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    return whole, starts, ends, hashes, np.searchsorted(starts, first)


def shingle_hashes(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words.

    A text of fewer words has one: the whole of it. A text without words has none.
    """
    words, bounds = word_hashes(texts)
    runs = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        runs = runs * np.uint64(_BASE) + words[k : k + len(runs)]
    runs = mixed(runs + np.uint64(size))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            whole = 0
            for w in words[a:b].tolist():
                whole = (whole * _BASE + w) % (1 << 64)
            out.append(mixed(np.array([(whole + b - a) % (1 << 64)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def text_batches(batch, column: str, limit: int = TEXT_BYTES):
    """Ranges of an Arrow batch and their texts as bytes; null texts are empty."""
    import pyarrow as pa

    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1])
    for a, b in slices(sizes.tolist(), limit):
        yield a, b, [t or b"" for t in texts.slice(a, b - a).to_pylist()]


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % folds

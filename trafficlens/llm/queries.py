"""The registered queries of this package: each applies one operator to its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_bpe import encoded_documents
from .content_archive import parsed_records, read_archive, write_archive
from .hard_negatives import hard_negatives
from .interpolated_lm import document_scores
from .kd_search import top_inner_products
from .packing import packed_sequences
from .piece_spans import digests, encoded_spans
from .quality_rank import quality_scores
from .shingle_join import similar_documents
from .surrogates import replace_entities
from .token_alignment import aligned_documents
from .url_filter import Rule, judged_urls
from .vector_links import linked_vectors

#: Upper-case base32 of the SHA-1 in hex column h, for the checking SQL.
_SQL_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {s}) & 31)::INTEGER, 1)"
    for k in range(8)
    for s in (15, 10, 5, 0)
)

QUERIES = {}
ORACLES = {}


def _query(name, oracle=None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    "op1_vector_links",
    oracle="""
    WITH RECURSIVE v AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))
            AND list_bool_or(list_transform(embedding, lambda c: c <> 0))),
    links AS (
        SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id
        WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
    reach(vec_id, other) AS (
        SELECT vec_id, vec_id FROM embeddings
        UNION
        SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
    comp AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
    SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
    FROM comp c LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = c.vec_id
    """,
)
def op1_vector_links(spark, sf_dir):
    """Near copies among all embeddings of one label: cosine 0.93 or more."""
    return linked_vectors(_table(spark, sf_dir, "embeddings"))


#: Configured rules of the registered URL query.
URL_RULES = [
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
]


@_query("op2_url_filter")
def op2_url_filter(spark, sf_dir):
    """A verdict on every page's url: by rule, else by trees trained on the ruled urls."""
    return judged_urls(_table(spark, sf_dir, "pages"), URL_RULES)


@_query("op3_interpolated_lm")
def op3_interpolated_lm(spark, sf_dir):
    """log10 probabilities of all documents under a bigram model of six sevenths of them."""
    return document_scores(_table(spark, sf_dir, "documents"))


@_query("op4_quality_rank")
def op4_quality_rank(spark, sf_dir):
    """Quality of every document, learned from preferences between labelled ones."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query(
    "op5_content_archive",
    oracle=f"""
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    d AS (
        SELECT page_id, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS first_id,
            {_SQL_BASE32} AS payload_digest
        FROM p)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
        CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM d
    """,
)
def op5_content_archive(spark, sf_dir):
    """A record per page written to a content-addressed archive and read back."""
    records = read_archive(spark, write_archive(_table(spark, sf_dir, "pages")))
    return parsed_records(records).drop("target_uri")


@_query(
    "op6_kd_search",
    oracle="""
    WITH v AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
        FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))),
    s AS (
        SELECT q.vec_id AS query_id, v.vec_id,
            list_sum(list_transform(list_zip(q.x, v.x), lambda z: z[1] * z[2]))::BIGINT AS score
        FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
        vec_id, score
    FROM s QUALIFY rank <= 5
    """,
)
def op6_kd_search(spark, sf_dir):
    """The 5 best partners by inner product of every 50th embedding, among all."""
    return top_inner_products(_table(spark, sf_dir, "embeddings"))


@_query("op7_packing")
def op7_packing(spark, sf_dir):
    """All documents in sequences of 2048 ids."""
    docs = _table(spark, sf_dir, "documents")
    return packed_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@_query(
    "op8_shingle_join",
    oracle=r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, s FROM (
            SELECT doc_id, unnest(CASE
                WHEN len(w) >= 5
                THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
                ELSE []::VARCHAR[] END) AS s
            FROM words)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    links AS (
        SELECT p.a, p.b FROM (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n
            FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
            GROUP BY ALL) p
        JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b
        WHERE 100 * both_n >= 75 * (m.n + n.n - both_n)),
    reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM documents
        UNION
        SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
    SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
    FROM documents d JOIN reach r USING (doc_id) LEFT JOIN sizes s USING (doc_id)
    GROUP BY d.doc_id
    """,
)
def op8_shingle_join(spark, sf_dir):
    """Components of near copies among all documents: five-word shingles, Jaccard 0.75."""
    return similar_documents(_table(spark, sf_dir, "documents"))


#: The key of surrogates in the registered queries; in production it is a secret.
SURROGATE_KEY = "registered-queries"


@_query("op9_surrogates")
def op9_surrogates(spark, sf_dir):
    """All documents with personal data and secrets replaced, and how many entities were."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, SURROGATE_KEY, count="n_replaced")


@_query("op10_chunk_bpe")
def op10_chunk_bpe(spark, sf_dir):
    """Digests of the ids of all documents, and of the texts decoded from them."""
    return encoded_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query(
    "op11_hard_negatives",
    oracle="""
    WITH v AS (
        SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))),
    s AS (
        SELECT a.vec_id AS anchor_id, a.label = v.label AS alike, v.vec_id,
            list_sum(list_transform(list_zip(a.x, v.x), lambda z: z[1] * z[2]))::BIGINT AS score
        FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id,
        (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike
        AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
    """,
)
def op11_hard_negatives(spark, sf_dir):
    """Hard negatives of every 100th embedding; every seventh has its label moved on by one."""
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))


@_query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    """How the tokens of two vocabularies overlap in all documents; groups as digests."""
    docs = _table(spark, sf_dir, "documents")
    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    return aligned_documents(docs, *paths, digest=True).withColumnRenamed("groups", "groups_sha256")


@_query("op13_piece_spans")
def op13_piece_spans(spark, sf_dir):
    """Digests of the piece ids of all documents, of their source spans and of the decoded texts."""
    return digests(encoded_spans(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))

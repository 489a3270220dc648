"""Operators on embeddings and pages against brute force; the pipeline; whole queries."""

import base64
import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trafficlens.llm import common, content_archive, kd_search, url_filter, vector_links
from trafficlens.llm.queries import QUERIES, URL_RULES
from trafficlens.llm.surrogates import replace_entities

FLOATS = "vec_id long, embedding array<float>, label int, block string"


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(9)
    rows = []
    for i in range(300):
        base = np.random.default_rng(i // 6).normal(size=16)
        rows.append((i, (base + 0.12 * draw.normal(size=16)).astype(np.float32).tolist(), i % 2, "x"))
    rows += [
        (300, rows[0][1], 0, "x"), (301, rows[0][1], 1, "x"), (301, rows[0][1], 1, "x"), (302, None, 0, "x"), (303, [0.0] * 16, 0, "x"),
        (304, [float("nan")] * 16, 0, "x"), (305, [None] * 16, 0, "x"), (306, [float("inf")] * 16, 0, "x"), (307, rows[0][1], None, "x"),
        (None, rows[0][1], 0, "x"), (308, [1.0, 2.0], 0, "x"), (309, [], 0, "x"), (350, [2.0, 1.0], 0, "x"),
    ]
    return rows


def fine(x):
    return x is not None and all(c is not None and math.isfinite(c) for c in x)


def test_vector_links_by_brute_force(spark, vectors):
    table = spark.createDataFrame(vectors, FLOATS)
    got = vector_links.linked_vectors(table).collect()
    use = [(i, np.array(x, float), y) for i, x, y, _ in vectors if i is not None and y is not None and fine(x) and any(x)]
    cosine = lambda p, q: p @ q / np.sqrt((p @ p) * (q @ q)) if len(p) == len(q) else -1
    links = collections.defaultdict(list)
    for a, (i, p, y) in enumerate(use):
        for b, (j, q, z) in enumerate(use):
            if a != b and y == z and cosine(p, q) >= 0.93:
                links[i].append(j)
    root = {i: i for i, *_ in vectors if i is not None}
    for _ in range(20):
        for i, others in links.items():
            root[i] = min([root[i], *(root[j] for j in others)])
    want = collections.Counter((i, len(links[i]), root[i], root[i] == i) if i is not None else (None, 0, None, False) for i, *_ in vectors)
    assert collections.Counter(map(tuple, got)) == want
    assert vector_links.linked_vectors(table.where("false")).count() == 0


def links_by_matrix(x, y, least=0.93):
    near = x @ y.T >= least
    return near & ~np.eye(len(x), dtype=bool) if x is y else near


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("noise", [0.02, 0.1, 0.2])
def test_meetings_find_the_links(noise):
    """Groups of eight, tight and loose; one shard with itself and two with each other."""
    draw = np.random.default_rng(4)
    x = unit(np.repeat(draw.normal(size=(150, 32)), 8, axis=0) + noise * draw.normal(size=(1200, 32)))
    ones = np.ones(1200, dtype=int)
    graph = vector_links.SmallWorld(x, np.arange(1200))
    meeting = vector_links.Meeting(graph, graph, 0.93)
    links, _, ties = meeting.links(ones, ones)
    true = links_by_matrix(x, x)
    assert meeting.found >= 0.99 * meeting.audited > 0
    assert 0.98 * true.sum() <= links.sum() and (links <= true.sum(axis=1)).all()
    assert all(true[i, j] or i == j for i, j in ties)
    a, b = (vector_links.SmallWorld(x[k::2], np.arange(600)) for k in (0, 1))
    of_a, of_b, _ = vector_links.Meeting(a, b, 0.93).links(ones[:600], ones[:600])
    assert of_a.sum() == of_b.sum() >= 0.98 * links_by_matrix(x[0::2], x[1::2]).sum()


def test_a_large_group_is_a_few_vertices():
    draw = np.random.default_rng(6)
    x = unit(np.concatenate([draw.normal(size=(300, 16)), draw.normal(size=16) + 0.02 * draw.normal(size=(4000, 16))]))
    graph = vector_links.SmallWorld(x, np.arange(4300))
    assert len(graph.vertices) < 400
    links, _, ties = vector_links.Meeting(graph, graph, 0.93).links(np.full(4300, 2), np.full(4300, 2))
    assert (links == 2 * links_by_matrix(x, x).sum(axis=1)).all() and len(ties) < 4300


def test_a_failed_audit_compares_all(monkeypatch):
    """A graph whose neighbours were cut off finds nothing; no link is lost for that."""
    draw = np.random.default_rng(7)
    x = unit(np.repeat(draw.normal(size=(40, 16)), 4, axis=0) + 0.15 * draw.normal(size=(160, 16)))
    graph = vector_links.SmallWorld(x, np.arange(160))
    graph.levels = [{i: [] for i in level} for level in graph.levels]
    meeting = vector_links.Meeting(graph, graph, 0.93)
    assert meeting.exact
    links, _, _ = meeting.links(np.ones(160, int), np.ones(160, int))
    assert (links == links_by_matrix(x, x).sum(axis=1)).all()


def test_shards_meet_and_report_their_recall(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "SHARD", 50)
    draw = np.random.default_rng(3)
    x = np.repeat(draw.normal(size=(60, 12)), 5, axis=0) + 0.1 * draw.normal(size=(300, 12))
    table = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    _, classes, found = vector_links.found_links(table)
    assert classes.select("label", "shard").distinct().count() == 6
    reports = vector_links.audits(found).collect()
    assert len(reports) == 12 and all(r.recall >= 0.99 or r.audited == 0 for r in reports)
    got = {r.vec_id: r.n_links for r in vector_links.linked_vectors(table).collect()}
    u = unit(x)
    near = (u @ u.T >= 0.93) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2) & ~np.eye(300, dtype=bool)
    assert sum(got.values()) >= 0.99 * near.sum() and all(got[i] <= n for i, n in enumerate(near.sum(axis=1)))


def test_top_products_by_brute_force(spark, vectors):
    table = spark.createDataFrame(vectors, FLOATS)
    use = {(i, tuple(math.floor(256 * c) for c in x)) for i, x, _, _ in vectors if i is not None and fine(x)}
    want = []
    for i, q in use:
        if i % 50 == 0:
            hits = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in use if j != i and len(v) == len(q))
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(hits[:5])]
    for shard in (8192, 40):  # one shard, and many
        old, kd_search.SHARD = kd_search.SHARD, shard
        got = kd_search.top_inner_products(table).collect()
        kd_search.SHARD = old
        assert sorted(map(tuple, got)) == sorted(want)
    assert kd_search.top_inner_products(table.where("false")).count() == 0


def test_tree_prunes_and_stays_exact():
    draw = np.random.default_rng(7)
    v = draw.integers(-300, 300, (3000, 3))
    tree = kd_search.KdTree(v, np.arange(3000))
    for q in draw.integers(-300, 300, (20, 3)):
        want = sorted(zip((-(v @ q)).tolist(), range(3000), strict=True))[:5]
        assert [(-s, i) for s, i in tree.search(q, -1, 5, None)] == want
        assert [(-s, i) for s, i in tree.search(q, -1, 5, -want[4][0])] == want


PAGES = [
    (1, "http://a.org/x", "<p>é</p>"), (2, "http://a.org/y", "<p>é</p>"), (3, None, None), (4, "", ""), (5, "http://b.com/\r\nX: y", "<p>once</p>"),
    (5, "http://b.com/\r\nX: y", "<p>once</p>"), (None, "http://c.net", "<p>é</p>"), (None, "http://c.net", "lonely"), (7, "http://d", "a\r\n\r\nb"),
]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string").repartition(2)
    archive = content_archive.write_archive(pages)
    assert spark.read.table(archive.payloads).count() == len({p[2] or "" for p in PAGES})
    records = content_archive.read_archive(spark, archive)
    largest = {}
    for i, _, html in PAGES:
        largest[html or ""] = max(-1 if i is None else i, largest.get(html or "", -1))
    want = collections.Counter()
    for i, url, html in PAGES:
        body = (html or "").encode()
        first = largest[html or ""]
        revisit = first != -1 and i != first
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want[i, len(body), digest, "revisit" if revisit else "response", first if revisit else None,
             (url or "").replace("\r", "%0D").replace("\n", "%0A")] += 1
    assert collections.Counter(map(tuple, content_archive.parsed_records(records).collect())) == want
    for row in content_archive.record_bytes(records).collect():
        head, _, rest = bytes(row["record"]).partition(b"\r\n\r\n")
        length = int(head.rpartition(b"Content-Length: ")[2])
        assert head.startswith(b"WARC/1.1\r\n") and rest[length:] == b"\r\n\r\n"
    small = content_archive.parsed_records(content_archive.read_archive(spark, content_archive.write_archive(pages, min_bytes=9)))
    assert {r["record_type"] for r in small.where("payload_bytes < 9").collect()} == {"response"}
    assert content_archive.read_archive(spark, content_archive.write_archive(pages.where("false"))).count() == 0


def test_damaged_payload_is_noticed(spark):
    archive = content_archive.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    rows = spark.read.table(archive.payloads).selectExpr("address", "cast('other' as binary) as payload")
    name = f"{archive.payloads}_damaged"
    rows.write.saveAsTable(name)
    with pytest.raises(Exception, match="payload damaged"):
        content_archive.read_archive(spark, content_archive.Archive(name, archive.records)).collect()


URLS = [
    (1, "http://X.ORG/a", "x.org", "/a", "org/", "allow"),
    (2, "https://www.example.org/es/1", "www.example.org", "/es/1", "example.org/es/", "block"),
    (3, "https://example.org/en/12?q#f", "example.org", "/en/12", "example.org/en/1", "block"),
    (4, "https://notexample.org/en/12", "notexample.org", "/en/12", "org/", "allow"),
    (5, "ftp://a.com/fr/x://y", "a.com", "/fr/x://y", "com/fr/", "allow"),
    (6, "http://a.com/de/#x", "a.com", "/de/", "com/de/", "block"),
    (7, None, "", "", None, None),
    (8, "a.com/de/", "", "", None, None),
    (9, "http://org", "org", "", None, None),
    (10, "http://b.net/en/1", "b.net", "/en/1", None, None),
    (11, "", "", "", None, None),
    (None, "http://a.com?x=://b", "a.com", "", None, None),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(u[0], u[1], "x", "y") for u in URLS * 2], "page_id long, url string, host string, label string")
    got = url_filter.judged_urls(pages, URL_RULES).collect()
    assert len(got) == 2 * len(URLS)
    want = {u[0]: u[2:] for u in URLS}
    for r in got:
        host, path, rule, verdict = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_filter.judged_urls(pages.where("false"), URL_RULES).count() == 0
    one = url_filter.judged_urls(pages.where("page_id in (2, 10)"), URL_RULES)
    assert {r["verdict"] for r in one.collect()} == {"block"}


def test_trees_learn_from_ruled_urls(spark, small):
    # judge half of the ruled urls without their rules
    pages = spark.read.parquet(f"{small}/pages.parquet")
    more = pages.selectExpr("page_id + 100000 as page_id", "replace(replace(url, 'http://', 'http//'), 'https://', 'https//') as url")
    assert url_filter.judged_urls(pages.select("page_id", "url").union(more), URL_RULES).where("rule is null and verdict is null").count() == 0
    assert url_filter.lexical_features("") == [0.0] * len(url_filter.LEXICAL)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(500, 500)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_filter_holds_back_no_key(spark):
    keys = [hash((i, 1)) for i in range(500)]
    table = common.key_filter(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert common.maybe_in(table, np.array(keys, dtype=np.int64)).all()
    assert common.maybe_in(table, np.arange(1000, dtype=np.int64) * 7919 + 3).mean() < 0.05


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = common.stored(stages["quality"](spark, docs, small), "q")
    single = common.stored(stages["near_copies"](spark, kept, small), "n")
    new = common.stored(stages["surrogates"](spark, single, small), "s")
    assert kept.columns == single.columns == new.columns == docs.columns
    assert kept.count() > single.count() == new.count() > 0
    rows = stages["packing"](spark, new, small)
    assert {r["doc_id"] for r in rows.select("doc_id").collect()} == {r["doc_id"] for r in new.collect()}
    whole = corpus_pipeline.run(spark, small).select("doc_id", "piece", "ids_crc32")
    assert sorted(whole.collect()) == sorted(rows.select("doc_id", "piece", "ids_crc32").collect())


def test_pipeline_keeps_one_row_of_a_repeated_id(spark, small):
    rows = [(1, "a b c d e f", 11), (1, "a b c d e f", 11), (2, "a b c d e f", 11), (3, "", 0), (3, "", 0), (None, "x", 1), (4, "other words", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, small)
    assert got.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect())
    assert ids == [(False, 1), (False, 3), (False, 3), (False, 4), (True, 0)]


def test_pipeline_keeps_unrelated_texts_of_one_id(spark, small):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "red orange yellow green blue indigo")
    rows = [(2, a, "p"), (1, a, "q"), (1, b, "r"), (2, c, "s"), (2, c, "s"), (None, b, "t"), (None, "x " + c, "u"), (7, None, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").withColumn("row", F.lit(5))
    got = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, small)
    assert got.columns == docs.columns
    assert sorted(r["a.b"] for r in got.collect()) == ["q", "r", "s", "t", "u", "v"]


def test_stages_take_columns_with_dots(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60).withColumn("a.b", F.col("doc_id") * 2)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "surrogates"):
        got = stages[name](spark, docs, small)
        assert got.columns == docs.columns and got.where("`a.b` <> 2 * doc_id").count() == 0
    with pytest.raises(ValueError, match="there already"):
        replace_entities(docs, "key", count="lang")


def test_every_operator_has_one_query():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14))

"""Hard negatives, token alignment and piece spans against brute force and the libraries."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trafficlens.llm import hard_negatives, piece_spans, token_alignment
from trafficlens.llm.queries import QUERIES

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "▁", "▁▁ a", "\n", "a ", "  a  b  ", "  x", "tab\tand\r\nline", "ﬁ Ａ①½ｶﾞ é ​", "漢字 😀😀 👩‍👩‍👧",
    "nul\0byte", "<s></s><unk><0x41><|endoftext|>", " ", "﻿x", "�", "x" * 3000, " " * 500, "▁" * 40, "é" * 700,
]


def odd_texts(n, seed=3):
    draw = random.Random(seed)
    parts = list("abcXYZ019 .,-\n\t▁éßя漢😀 　ﬁ①") + [" the", " of ", "tion", "  ", "</s>", " ing", "2024-", "http://"]
    return ODD + ["".join(draw.choice(parts) for _ in range(draw.randint(1, 60))) for _ in range(n)]


# --- pieces ----------------------------------------------------------------------------------


def model_with(rule=None, **flags):
    """The model file with the character map of another rule set."""
    with open(PIECES, "rb") as file:
        proto = file.read()
    fields = [(k, v) for k, v in piece_spans._fields(proto) if k != 3]
    spec = b"".join(piece_spans._field({"prefix": 3, "squeeze": 4, "escape": 5}[k], v) for k, v in flags.items())
    if rule:
        of = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
        spec = piece_spans._field(2, dict(piece_spans._fields(of))[2]) + spec
    return b"".join(piece_spans._field(k, v) for k, v in fields) + piece_spans._field(3, spec)


@pytest.mark.parametrize(
    "proto",
    [
        model_with(prefix=1, squeeze=0), model_with(prefix=1, squeeze=1), model_with("nmt_nfkc", prefix=1, squeeze=0),
        model_with("nmt_nfkc", prefix=1, squeeze=1), model_with("nmt_nfkc_cf", prefix=0, squeeze=1), model_with("nfkc", prefix=1, squeeze=1, escape=0),
    ],
)
def test_ids_spans_and_decoded_texts_are_the_librarys(proto):
    model = piece_spans.PieceModel(proto=proto)
    texts = odd_texts(600)
    ids, begins, ends, bounds = model.encode_batch([t.encode() for t in texts])
    decoded = model.decode_batch(ids, bounds)
    for k, text in enumerate(texts):
        want = model.library.encode(text, return_type="proto").pieces
        i, j = bounds[k], bounds[k + 1]
        assert [(int(x), int(y), int(z)) for x, y, z in zip(ids[i:j], begins[i:j], ends[i:j], strict=True)] == [(p.id, p.begin, p.end) for p in want]
        assert decoded[k].decode() == model.library.decode([p.id for p in want])


def test_longest_rule_wins_and_broken_bytes_become_signs():
    model = piece_spans.PieceModel(proto=model_with("nmt_nfkc", prefix=0, squeeze=0))
    assert model.normalised("ｶﾞx".encode()) == ("ガx".encode(), pytest.approx([0, 0, 0, 6, 7]))
    assert model.normalised("é".encode())[0] == "é".encode()
    for rule in (None, "nmt_nfkc"):
        model = piece_spans.PieceModel(proto=model_with(rule, prefix=0, squeeze=0))
        whole, places = model.normalised(b"a\xffb\xe2\x82c")
        assert whole == "a�b��c".encode()
        assert places.tolist() == [0, 1, 1, 1, 2, 3, 3, 3, 4, 4, 4, 5, 6]
    with pytest.raises(ValueError):
        piece_spans.PieceModel(proto=model_with() + piece_spans._field(1, piece_spans._field(1, b"{own}") + piece_spans._field(3, 4)))


def test_encoded_spans_of_a_table(spark):
    texts = [*odd_texts(40), None, ODD[5], "word " * 300_000]
    rows = [(i if i else None, t, "x", i) for i, t in enumerate(texts)] + [(3, ODD[3], "x", 9)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, ids long")
    encoded = piece_spans.encoded_spans(docs, PIECES)
    got = collections.Counter((r.doc_id, bytes(r.ids), r.decoded, r.n_tokens) for r in encoded.collect())
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want[doc_id, np.array(ids, "<u4").tobytes(), library.decode(ids), len(ids)] += 1
    assert got == want
    one = encoded.where("doc_id = 10")
    pieces = piece_spans.piece_rows(one, PIECES).orderBy("at").collect()
    text = texts[10].encode()
    assert (pieces[0].piece, pieces[-1].piece, pieces[-1].begin) == ("<s>", "</s>", len(text))
    assert b"".join(text[p.begin : p.end] for p in pieces) == text
    assert piece_spans.encoded_spans(docs.where("false"), PIECES).count() == 0


def test_piece_query_digests(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_piece_spans"](spark, small).collect()}
    for doc_id, text in docs:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id] == (len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest())


# --- alignment -------------------------------------------------------------------------------


def plain_alignment(texts):
    """What aligned_documents gives, by a walk over both rows of tokens."""
    a_file, b_file = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_file.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in a_file.get_vocab().items() if i < 50256}
    docs, count = [], collections.Counter()
    for text in texts:
        a = a_file.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_file.encode(text) if text else []
        b_bytes = [bytes([int(p[3:5], 16)]) if b_file.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_file.id_to_piece(i)]]
        a_bytes = [bytes_of[i] for i in a]
        if not text or not (b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode()):
            a, b, a_bytes, b_bytes = [], [], [], []
        groups, links, i, j, at_a, at_b, group = [], [], 0, 0, 0, 0, ([], [])
        while i < len(a):
            links.append((a[i], b[j]))
            end_a, end_b = at_a + len(a_bytes[i]), at_b + len(b_bytes[j])
            if end_a <= end_b:
                group[0].append(str(a[i]))
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                group[1].append(str(b[j]))
                j, at_b = j + 1, end_b
            if end_a == end_b:
                groups.append(",".join(group[0]) + "|" + ",".join(group[1]))
                group = ([], [])
        count.update(links)
        docs.append((len(a), len(b), groups, links))
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(n, m, len(g), len(k), ";".join(g), sum(count[x] == most[x[1]] for x in k), sum(count[x] for x in k)) for n, m, g, k in docs]


def test_alignment_by_a_walk(spark):
    texts = [*odd_texts(150), None, "word " * 200_000, "ab" * 40_000]
    texts += texts[20:24]
    rows = [(i if i != 30 else None, t, "x", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, block int")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    paths = (BYTES, public_tokenizers.PATTERN, PIECES)
    got = token_alignment.aligned_documents(docs.repartition(3), *paths).select(names).collect()
    want = collections.Counter((i, *row) for (i, *_), row in zip(rows, plain_alignment(texts), strict=True))
    assert collections.Counter(map(tuple, got)) == want
    assert token_alignment.aligned_documents(docs.where("false"), *paths).count() == 0


def test_alignment_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in QUERIES["op12_token_alignment"](spark, small).collect()}
    for (doc_id, _), (*four, groups, n_best, count_sum) in zip(docs, plain_alignment([t for _, t in docs]), strict=True):
        assert got[doc_id] == (*four, hashlib.sha256(groups.encode()).hexdigest() if groups else "", n_best, count_sum)


def test_pointers_jump_to_the_end_of_long_chains():
    # A ends at even places, B at odd ones: one chain through all tokens
    a, b = np.arange(2, 40_002, 2), np.append(np.arange(1, 40_000, 2), 40_000)
    of_a, of_b = token_alignment.groups_of(a, b)
    assert set(of_a.tolist()) == set(of_b.tolist()) == {len(b) - 1}
    assert [x.tolist() for x in token_alignment.groups_of(np.array([2, 3, 5]), np.array([3, 4, 5]))] == [[0, 0, 2], [0, 2, 2]]
    assert [len(x) for x in token_alignment.groups_of(np.zeros(0, int), np.zeros(0, int))] == [0, 0]


def test_packed_numbers_come_back():
    for numbers in ([], [0], [5, 5, 70_000, 2**31], list(range(1000))):
        assert token_alignment._unpacked(token_alignment._packed(np.array(numbers, dtype=np.int64))).tolist() == numbers


# --- hard negatives --------------------------------------------------------------------------


def test_hilbert_curve_visits_neighbours():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        place = hard_negatives.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_bounds_hold_every_product():
    draw = np.random.default_rng(2)
    v = draw.integers(-300, 300, (500, 8))
    low, high = hard_negatives.bounds(v[:20], v.min(axis=0)[None], v.max(axis=0)[None])
    scores = hard_negatives.products(v[:20], v)
    assert (low <= scores).all() and (scores <= high).all()
    huge = np.array([[1 << 30, -(1 << 30)]])
    assert hard_negatives.products(huge, huge).tolist() == [[1 << 61]]
    with pytest.raises(OverflowError):
        hard_negatives.products(huge * 8, huge * 8)


def plain_negatives(rows, every, positives, negatives):
    use = {
        (i, y, tuple(math.floor(256 * c) for c in x))
        for i, x, y, *_ in rows
        if i is not None and y is not None and x and all(c is not None and math.isfinite(c) for c in x)
    }
    out = collections.Counter()
    for i, y, q in use:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v, strict=True)), j, z) for j, z, v in use if j != i and len(v) == len(q)]
        for p, j, _ in sorted(s for s in scored if s[2] == y)[:positives]:
            fit = sorted((s, n) for s, n, z in scored if z != y and 30 * -p <= 100 * -s <= 90 * -p)[:negatives]
            out.update((i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(fit, 1))
    return out


def test_hard_negatives_by_brute_force(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(40, 12))
    rows = [(i, (0.1 * (centres[i % 40] + 0.7 * draw.normal(size=12))).tolist(), 0 if i % 3 else i % 7, "x") for i in range(2600)]
    rows += [
        (3000, None, 1, "x"), (3001, [None] * 12, 1, "x"), (3002, [float("nan")] * 12, 1, "x"), (3003, [float("inf")] * 12, 1, "x"), (None, rows[0][1], 1, "x"),
        (3004, rows[0][1], None, "x"), (3100, [0.0] * 12, 3, "x"), (3200, [0.5, 0.25], 1, "x"), (3201, [0.5, 0.25], 1, "x"), (3202, [0.25, 0.25], 2, "x"),
        (3300, [], 1, "x"), (3400, rows[8][1], 88, "x"), (200, rows[9][1], 4, "x"), (3500, rows[8][1], 2, "x"), (3501, rows[8][1], 2, "x"), (3502, rows[8][1], 5, "x"),
    ]
    rows += rows[:30]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, `a.b` string")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = hard_negatives.hard_negatives(table.withColumn("block", table.label)).select(names).collect()
    want = plain_negatives(rows, 100, 5, 10)
    assert len(want) > 500 and collections.Counter(map(tuple, got)) == want
    assert hard_negatives.hard_negatives(table.where("false")).count() == 0
    assert hard_negatives.hard_negatives(table.where("label = 0")).count() == 0


def test_zone_maps_leave_blocks_unread(spark):
    """Clusters apart from each other: an anchor reads its own and those its windows meet."""
    draw = np.random.default_rng(8)
    rows = []
    for i in range(6000):
        x = np.full(8, -0.2)
        x[i % 6] = 1.0
        rows.append((i, (x + 0.01 * draw.normal(size=8)).tolist(), i % 6))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    blocks = hard_negatives.hilbert_blocks(hard_negatives.whole_rows(table)).cache()
    zones = blocks.where("low is not null")
    assert blocks.count() == 6000 and zones.count() >= 12
    asked = blocks.where("vec_id = 600").selectExpr("dims", "0L AS part", "vec_id", "label", "v", "array(named_struct('ask', 0L, 'low', 60000L, 'high', 90000L)) AS asks")
    read = hard_negatives.chosen_blocks(asked, zones, True).join(blocks, "block")
    assert {r.label for r in read.select("label").distinct().collect()} >= {0}
    assert hard_negatives.chosen_blocks(asked, zones, False).count() <= 2 < zones.count()
    blocks.unpersist()


def test_too_large_components_raise(spark):
    table = spark.createDataFrame([(1, [1e300, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        hard_negatives.hard_negatives(table).count()

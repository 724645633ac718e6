"""Filter audit, packing and hard negatives against brute force on small fixtures with awkward rows."""

import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trialspark.llm import filter_audit, hard_negatives, packing
from trialspark.llm._memo import bpe_library

WORDS = re.compile("[^\x20\x09-\x0D]+")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "The", "ther", "tion", " ", "  ", "\n", " ", "'s", "don't", "'", "ing", "1", "23", "é", "ß", "İ", "Σ", "!!", "***", "日本", "🙂", "\t", "xxxxx", " .", "<|endoftext|>", "<|start", "\x1c", " ", " ", "\x0b", "a1b2", "\x00", "x_y"]
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.choice([0, 3, 40, 300]))) for _ in range(n)]


# filter audit


def audit_documents():
    rng = random.Random(4)
    made = []
    for _ in range(60):
        words = [rng.choice(["foo", "Bar", "BAZ", "a%b", "x$", f"w{rng.randint(0, 400)}"]) for _ in range(rng.choice([0, 5, 199, 200, 201, 400]))]
        made.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(words))
    made = [*made, *made[:20], None, None, "", " ", "ß " * 250, "A" * 3 + "b" * 147]
    rows = [(i if i % 17 else None, t, "en", [None, "", "s1", "s2"][i % 4], 0) for i, t in enumerate(made)]
    return [*rows, *rows[:3], (5, "clash", "en", "s1", 0)]


def plain_audit(rows, labels):
    marks = {}
    for i, quality, toxic in labels:
        a, b = marks.get(i, (0, 0))
        marks[i] = (max(a, quality == 1), max(b, toxic == 1))
    docs = []
    for i, text, _, source, _ in rows:
        text = text or ""
        words = WORDS.findall(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows),
        }
        docs.append((source or "", fails, *marks.get(i, (0, 0))))
    out, sums = {}, {}
    for part in {d[0] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            n = {x: sum(d[1][x] for d in left) for x in "ABCDE"}
            alone = {x: sum(d[1][x] and sum(d[1].values()) == 1 for d in left) for x in "ABCDE"}
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                out[part, order, step] = [len(left), len(gone), n[x] - len(gone), alone[x], sum(d[2] for d in gone), sum(d[3] for d in gone)]
                sums[part, x] = sums.get((part, x), 0) + len(gone)
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rows = audit_documents()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 90, 2)] + [(4, 1, None), (6, None, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit(1) for c in ("mask", "part", "n", "words")})
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r[0], r[1], r[2]): tuple(r[3:]) for r in got.collect()}
    assert found == plain_audit(rows, [(i, q, t) for i, q, t in labels if i is not None])
    assert got.dtypes[3:] == [(c, "bigint") for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]


def test_filter_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], FIELDS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(None, None, None, None, None)], FIELDS)
    rows = filter_audit.filter_audit(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}
    assert all(r.removed == (r.filter_order[r.step - 1] == "A") for r in rows)  # no words; the other filters need some


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_shapley_weights_are_the_average_over_orders(n):
    rng = random.Random(n)
    v = [0, *(rng.randint(-50, 50) for _ in range((1 << n) - 1))]
    want = [Fraction(0)] * n
    for order in itertools.permutations(range(n)):
        s = 0
        for i in order:
            want[i] += v[s | 1 << i] - v[s]
            s |= 1 << i
    assert [sum(c * x for c, x in zip(row, v, strict=True)) for row in filter_audit.shapley_weights(n)] == want


# packing


def sequences(rows, capacity):
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(used)


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(capacity - s)
    return len(rooms)


@pytest.mark.parametrize("capacity", [7, 64, 1024])
def test_pack_places_every_id_once(spark, capacity):
    texts = [*random_texts(80, 1), None, "", " ", "x" * 3000, " " * 900, "a1'b" * 700, "don't " * 500, *random_texts(5, 1)]
    rows = [(i if i % 13 else None, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows = [*rows, *rows[:2]]
    docs = spark.createDataFrame(rows, FIELDS).withColumns({c: F.lit("x") for c in ("key", "length", "sequence_id", "piece")})
    got = packing.pack(docs, BYTE, capacity=capacity).collect()
    sequences(got, capacity)
    library = bpe_library(BYTE)
    want = []
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= capacity else (len(ids) - 1) % capacity + 1
        edges = [0, *range(first, len(ids) + 1, capacity)]
        want += [(str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(edges))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_pack_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], FIELDS), BYTE).count() == 0
    (row,) = packing.pack(spark.createDataFrame([(3, None, None, None, None)], FIELDS), BYTE).collect()
    assert (row.doc_id, row.piece, row.start, row.length, row.offset) == (3, 0, 0, 1, 0)


@pytest.mark.parametrize("kind", ["even", "small", "equal", "large", "mixed"])
def test_best_fit_opens_few_sequences(spark, kind):
    rng = random.Random(kind)
    sizes = {
        "even": [rng.randint(1, 1023) for _ in range(1500)],
        "small": [rng.randint(1, 60) for _ in range(1500)],
        "equal": [400] * 301,
        "large": [rng.randint(513, 1023) for _ in range(200)],
        "mixed": [rng.randint(500, 600) for _ in range(200)] + [rng.randint(1, 30) for _ in range(900)],
    }[kind]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "key long, size long")
    counts = []
    for range_rows in (1 << 17, 100):  # one range and many: the sweep across ranges gives the same matches
        rows = packing.best_fit(pieces, 1024, range_rows=range_rows).collect()
        used = {}
        for r in rows:
            used[r.sequence_id] = used.get(r.sequence_id, 0) + sizes[r.key]
        assert sorted(r.key for r in rows) == list(range(len(sizes))) and max(used.values()) <= 1024
        counts.append(len(used))
    assert counts[0] == counts[1]
    assert counts[0] <= math.ceil(1.01 * plain_best_fit(sizes, 1024)) + 2


def test_brackets_match_like_a_stack():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 400):
        kind = rng.integers(0, 2, n)
        stack, want = [], []
        for i, k in enumerate(kind):
            if k == 0:
                stack.append(i)
            elif stack:
                want.append((stack.pop(), i))
        assert sorted(zip(*(x.tolist() for x in packing.brackets(kind)), strict=True)) == sorted(want)


def test_ranges_match_like_one():
    rng = np.random.default_rng(1)
    for _ in range(30):
        left = [(p, int(rng.integers(0, 5)), int(rng.integers(0, 5))) for p in range(8)]
        found = packing.matched_ranges(left)
        places = {k: {m + j: (p, a + j) for p, a, n, m in found[k] for j in range(n)} for k in (0, 1)}
        stack, want = [], set()
        for p, pieces, rooms in left:
            for r in range(rooms):
                if stack:
                    want.add((stack.pop(), (p, r)))
            stack += [(p, k) for k in reversed(range(pieces))]
        assert {(places[0][m], places[1][m]) for m in places[0]} == want


# hard negatives


def plain_negatives(rows, anchor, n_positives=5, n_negatives=3, low=50, high=95):
    rows = [(i, y, v) for i, y, v in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(256 * float(x)) for x in v] for _, _, v in rows]
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=False))
    place = lambda s, i: (-s, i is None, i or 0)
    out = []
    for a, (i, y, _) in enumerate(rows):
        if i is None or not anchor(i):
            continue
        near = sorted((place(score(a, b), r[0]) + (r[0],) for b, r in enumerate(rows) if b != a and r[1] == y), key=lambda t: t[:3])[:n_positives]
        for negative, _, _, p in near:
            band = sorted((place(s, r[0]) + (r[0],) for b, r in enumerate(rows) if r[1] != y and low * -negative <= 100 * (s := score(a, b)) <= high * -negative), key=lambda t: t[:3])[:n_negatives]
            out += [(i, p, k, j, -negative, -s) for k, (s, _, _, j) in enumerate(band, 1)]
    return sorted(map(repr, out))


def embedding_rows(dims=9, n=150, seed=2):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 3), [rng.gauss(0.1, 0.3) for _ in range(dims)]) for i in range(n)]
    rows += [(n, None, [0.1] * dims), (n + 1, 1, None), (n + 2, 1, [None] * dims), (n + 3, 1, [float("nan")] * dims), (n + 4, 2, [float("inf")] * dims), (None, 1, [0.5] * dims), (None, 2, [0.4] * dims), (n + 5, 2, []), (n + 6, 1, [0.9] * (dims - 2)), (-10, 1, [-0.7] * dims)]
    return [*rows, *rows[:12], *(rows[20:23] * 2)]


def test_hard_negatives(spark):
    rows = embedding_rows()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit(1) for c in ("row", "vector", "group", "part", "score")})
    held = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    for options in ({}, {"n_positives": 2, "n_negatives": 7, "low": 10, "high": 100}):
        got = hard_negatives.hard_negatives(df, df["vec_id"] % 10 == 0, **options)
        assert sorted(repr(tuple(r)) for r in got.collect()) == plain_negatives(held, lambda i: i % 10 == 0, **options)


def test_hard_negatives_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PART_CELLS", 9 * 20)
    monkeypatch.setattr(hard_negatives, "TILE_CELLS", 64)
    df = spark.createDataFrame(embedding_rows(), "vec_id long, label int, embedding array<float>")
    held = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    got = hard_negatives.hard_negatives(df, df["vec_id"] % 3 == 0)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_negatives(held, lambda i: i % 3 == 0)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame(embedding_rows(), "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(df, df["vec_id"] == 77777).count() == 0
    none = df.where("vec_id = 88888")
    assert hard_negatives.hard_negatives(none, none["vec_id"] % 2 == 0).count() == 0
    with pytest.raises(ValueError, match="too large"):
        big = spark.createDataFrame([(0, 1, [3e30]), (1, 1, [1.0])], "vec_id long, label int, embedding array<float>")
        hard_negatives.hard_negatives(big, big["vec_id"] == 0)


@pytest.mark.parametrize(("dims", "most"), [(1, 5), (64, 300), (64, 2**29), (1500, 40000), (3000, 2)])
def test_residue_products_are_exact(dims, most):
    rng = np.random.default_rng(dims)
    a, b = rng.integers(-most, most + 1, (7, dims)), rng.integers(-most, most + 1, (11, dims))
    a[0], b[0], b[1] = most, most, -most
    bound = int(max((x.astype(object) ** 2).sum() for x in (*a, *b)))
    if bound >= 1 << 60:
        a, b = a // 256, b // 256
        bound = int(max((x.astype(object) ** 2).sum() for x in (*a, *b)))
    primes = hard_negatives.moduli(bound, dims)
    assert math.prod(primes) > 4 * bound and all(p % q for p in primes for q in range(2, p))
    got = hard_negatives.products(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
    assert (got == (a.astype(object) @ b.T.astype(object)).astype(np.int64)).all()


def test_order_of_scores_beyond_the_keys():
    scores = np.array([[5, 2**59, 2**59, -(2**59), 5], [1, 1, 1, 1, 1]])
    out = np.array([[False] * 5, [False, True, False, False, False]])
    keys, first, column = hard_negatives.ordered(scores, out)
    assert column(keys[0]).tolist()[::-1] == [1, 2, 0, 4, 3]
    assert column(keys[1][1:]).tolist()[::-1] == [0, 2, 3, 4]
    assert (keys[0] >= first(np.array([2**59]))[0]).sum() == 2


def test_empty_arrow_block():
    assert pa.schema(hard_negatives._whole(pa.table({"vec_id": pa.array([1])}), pa.table({"vec_id": pa.array([], pa.int64())}), "score").schema).names == ["anchor_row", "anchor_id", "score", "vec_id"]

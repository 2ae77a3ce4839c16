"""Vector codes and centroid clusters against brute force in whole numbers."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from remedia.llm import clustering, vector_codes, vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def whole(vector, factor):
    return [max(-vectors.LIMIT, min(vectors.LIMIT, math.floor(factor * x) if math.isfinite(factor * x)
                                    else (vectors.LIMIT if x > 0 else -vectors.LIMIT))) for x in vector]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def lloyd(points, centres, rounds):
    """Assignments and centres after ``rounds`` updates, in Python integers."""
    def nearest():
        return [min(range(len(centres)), key=lambda c: (squared(p, centres[c]), c)) for p in points]

    for _ in range(rounds):
        at = nearest()
        for c in range(len(centres)):
            own = [p for p, a in zip(points, at, strict=True) if a == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return nearest(), centres


def brute_codes(rows, entries, rounds, parts=4):
    kept = [(i, whole(e, 1024), label) for i, e, label in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    out = {n: ["", 0] for n in range(len(kept))}
    books = []
    for p in range(parts):
        cut = slice(p * width, (p + 1) * width)
        at, book = lloyd([v[cut] for _, v, _ in kept], [v[cut] for _, v, _ in order[:entries]], rounds)
        books.append(book)
        for n, (a, (_, v, _)) in enumerate(zip(at, kept, strict=True)):
            out[n] = [out[n][0] + f"{a:02x}", out[n][1] + squared(v[cut], book[a])]
    shown = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), label, code, min(error, vectors.LONG_MAX), shown)
                  for (i, _, label), (code, error) in zip(kept, out.values(), strict=True))


def codes_of(spark, rows, entries=8, rounds=3):
    found = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), entries=entries, rounds=rounds).collect()
    return sorted((str(r["vec_id"]), r["label"], r["code"], r["error"], r["codebooks_sha256"]) for r in found), found


def clouds(n, dim, seed=3, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (5, dim))
    return [[float(x) for x in centres[i % 5] + rng.normal(0, spread, dim)] for i in range(n)]


def test_codes_match_brute_force(spark):
    rows = [(i * 3, v, i % 3 or None) for i, v in enumerate(clouds(60, 8))]
    got, found = codes_of(spark, rows)
    assert got == brute_codes(rows, 8, 3)
    for label in (None, 1, 2):
        own = [r for r in found if r["label"] == label]
        assert {r["label_error"] for r in own} == {sum(r["error"] for r in own)}


def test_repeats_ties_and_null_ids(spark):
    rows = [(1, [0.5, 0.25, 0.0, 0.0], 1)] * 4 + [(None, [0.1, 0.2, 0.3, 0.4], None)] * 3 + [(2, [0.0] * 4, 1), (3, [0.5, 0.0, 0.0, 0.0], 2)]
    assert codes_of(spark, rows, entries=4, rounds=2)[0] == brute_codes(rows, 4, 2)


@pytest.mark.parametrize("size", [40_000.0, 1e9, 1e300])
def test_large_components_stay_exact(spark, size):
    rows = [(i, [size * ((i * k) % 7 - 3) + k for k in range(4)], 0) for i in range(20)]
    assert codes_of(spark, rows, entries=4, rounds=2)[0] == brute_codes(rows, 4, 2)


def test_what_is_dropped(spark):
    good = [(i, [float(i), 1.0, 2.0, 3.0], 0) for i in range(5)]
    bad = [(10, None, 0), (11, [1.0, None, 2.0, 3.0], 0), (12, [math.nan, 0.0, 0.0, 0.0], 0), (13, [math.inf, 0.0, 0.0, 0.0], 0),
           (14, [-math.inf, 0.0, 0.0, 0.0], 0), (15, [1.0] * 8, 0), (16, [1.0, 2.0], 0), (17, [], 0)]
    assert codes_of(spark, good + bad)[0] == brute_codes(good, 8, 3)
    assert codes_of(spark, bad[:5])[0] == []
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns(spark):
    rows = [(i, v, 0, "x", 1, 2) for i, v in enumerate(clouds(12, 4))]
    wide = spark.createDataFrame(rows, SCHEMA + ", code string, error int, ints int")
    assert sorted(r["code"] for r in vector_codes.compress(wide, entries=4).collect()) == [
        c[2] for c in sorted(brute_codes([r[:3] for r in rows], 4, 4), key=lambda c: c[2])]
    named = spark.createDataFrame([r[:5] for r in rows], "vec_id long, embedding array<double>, label int, cells string, cluster int")
    assert clustering.cluster(named, k=3, dim=4).count() == 12


def test_decode(spark):
    kept, dim = vector_codes.prepare(spark.createDataFrame([(i, v, 0) for i, v in enumerate(clouds(30, 8))], SCHEMA))
    books = vector_codes.train(kept, dim, entries=6)
    coded = vector_codes.decode(vector_codes.encode(kept, books, dim), books)
    both = coded.join(kept.select("vec_id", kept["ints"].alias("was")), "vec_id").collect()
    assert len(both) == 30 and all(squared(r["ints"], r["was"]) == r["error"] for r in both)


@settings(deadline=None, max_examples=40)
@given(st.integers(1, 120), st.integers(0, 5), st.integers(1, 60), st.sampled_from([3, 50, 10**7, 10**12]))
def test_tree_finds_the_same_entries(n, seed, spread, scale):
    rng = np.random.default_rng(seed)
    kind = vectors.number_type(spread * scale, 4)
    points = (rng.integers(-spread, spread + 1, (n, 4)).astype(object) * scale).astype(kind)
    rows = (rng.integers(-spread, spread + 1, (50, 4)).astype(object) * scale).astype(kind)
    at, best = vector_codes.Gnat(points).nearest(rows)
    want = vectors.squared(rows, points)
    assert (at == want.argmin(1)).all() and (best == want.min(1)).all()


def test_tree_leaves_out_subtrees():
    points = np.floor(1000 * np.array(clouds(256, 4, spread=0.005)))
    tree = vector_codes.Gnat(points)
    tree.nearest(points)
    assert tree.scored < 0.6 * points.shape[0] ** 2


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, whole(e, 256)) for i, e in rows if e is not None and len(e) == dim]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    at, centres = lloyd([v for _, v in kept], [list(v) for _, v in order[:k]], rounds)
    far = [squared(v, centres[a]) for (_, v), a in zip(kept, at, strict=True)]
    own = [sum(d for d, a in zip(far, at, strict=True) if a == c) for c in range(len(centres))]
    most = vectors.LONG_MAX
    return sorted((str(i), a, min(d, most), min(own[a], most), min(sum(far), most),
                   hashlib.sha256(",".join(map(str, centres[a])).encode()).hexdigest())
                  for (i, _), a, d in zip(kept, at, far, strict=True))


def clusters_of(spark, rows, k, rounds, dim, bits=clustering.BITS):
    table = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    found = clustering.cluster(table, k, rounds, dim, bits=bits).collect()
    return sorted((str(r["vec_id"]), *r[1:]) for r in found)


@pytest.mark.parametrize("bits", [2, 4, 7])
def test_clusters_match_brute_force(spark, bits):
    rows = list(enumerate(clouds(70, 6, spread=0.1))) + [(500, None), (501, [1.0] * 5)]
    assert clusters_of(spark, rows, 7, 3, 6, bits) == brute_clusters(rows, 7, 3, 6)


def test_cluster_repeats_and_extremes(spark):
    rows = [(1, [0.5, 0.5])] * 5 + [(None, [0.0, 0.0])] * 2 + [(2, [1e300, -1e300]), (3, [40_000.0, 3e9]), (4, [0.5, 0.5])]
    assert clusters_of(spark, rows, 4, 2, 2) == brute_clusters(rows, 4, 2, 2)
    assert clusters_of(spark, [], 4, 2, 2) == []
    assert clusters_of(spark, [(1, [math.nan, 0.0]), (2, None)], 4, 2, 2) == []


def test_cells_spare_full_vectors():
    rows = np.floor(256 * np.array(clouds(300, 16))).astype(np.int64)
    starts = [sorted({int(x) for x in np.linspace(c.min(), c.max() + 1, 65)[:-1]}) for c in rows.T]
    marks = clustering.Grid(starts, [int(c.max()) for c in rows.T])
    cells = np.stack([np.searchsorted(s, c, "right") - 1 for s, c in zip(starts, rows.T, strict=True)], 1)
    packed = clustering.pack(cells, 6)
    assert len(packed[0]) == 12 and (clustering.unpack(pa.array(packed), 16, 6) == cells).all()
    assigner = clustering.Assigner(rows[:5].tolist(), marks, 6)
    at = assigner.nearest(pa.array(packed, pa.binary()), pa.array(list(rows)))
    assert (at == vectors.squared(rows, rows[:5]).argmin(1)).all()
    assert assigner.fetched < 30

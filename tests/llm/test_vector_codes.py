from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from triptopics.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def plain(rows, dim, entries=vc.ENTRIES):
    """Every distance to every entry, in plain integers."""
    kept = [(i, [int(np.floor(1024.0 * float(np.float32(x)))) for x in e], lab) for i, e, lab in rows
            if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = dim // 4
    x = np.array([r[1] for r in kept]).reshape(len(kept), 4, w)
    books = [x[:entries, p].copy() for p in range(4)]

    def assign():
        d = [((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(4)]
        return [m.argmin(1) for m in d], sum(m.min(1) for m in d)

    for _ in range(4):
        codes, _ = assign()
        for p in range(4):
            for k in range(len(books[p])):
                mine = x[codes[p] == k, p]
                if len(mine):
                    books[p][k] = mine.sum(0) // len(mine)
    codes, err = assign()
    digest = sha256(",".join(str(v) for b in books for e in b for v in e.tolist()).encode()).hexdigest()
    by = defaultdict(int)
    for r, e in zip(kept, err, strict=True):
        by[r[2]] += int(e)
    return [(r[0], "".join(f"{codes[p][i]:02x}" for p in range(4)), int(err[i]), by[r[2]], digest) for i, r in enumerate(kept)]


def got(df):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("spread", [0.05, 1.0, 300.0])
def test_nearest_equals_all_distances(spread):
    rng = np.random.default_rng(3)
    for n, width in ((256, 16), (70, 5), (1, 2), (256, 1)):
        entries = np.floor(rng.normal(0, spread * 1024, (n, width))).astype(np.int64)
        entries[n // 2:] = entries[:n - n // 2]                     # equal entries: ties
        points = np.floor(rng.normal(0, 2 * spread * 1024, (700, width))).astype(np.int64)
        code, dist = vc.SliceIndex(entries).nearest(points)
        d = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (dist == d.min(1)).all()


def test_cube_masks_hold_the_entries_of_the_cube():
    rng = np.random.default_rng(4)
    entries, points = rng.integers(-50, 50, (130, 3)), rng.integers(-60, 60, (40, 3))
    radius = rng.integers(0, 60, 40)
    masks = vc.SliceIndex(entries).cube(points, radius)
    bits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(bool)
    assert (bits == (np.abs(points[:, None] - entries[None]).max(2) <= radius[:, None])).all()


def test_codes_equal_plain_form(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(0, 0.2, 8).tolist(), int(i) % 5 if i % 7 else None) for i in rng.permutation(900)]
    rows += [(5, rows[0][1], 1), (5, rows[0][1], 1), (None, rows[1][1], None), (1000, [0.0] * 8, 2), (1001, [-0.0] * 8, 2), (1002, [100.5, -100.5] * 4, 3)]
    bad = [(2000, None, 1), (2001, [], 1), (2002, [None] + [0.1] * 7, 1), (2003, [float("nan")] + [0.1] * 7, 1),
           (2004, [0.1] * 7 + [float("-inf")], 1), (2005, [0.1] * 4, 1), (2006, [0.1] * 7, 1)]
    out = vc.vector_codes(frame(spark, rows + bad).repartition(4))
    assert got(out) == Counter(plain(rows, 8))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_fewer_vectors_than_entries(spark):
    rows = [(i, [float(i), 1.0, -2.0, 0.25 * i], None) for i in range(9)]
    assert got(vc.vector_codes(frame(spark, rows))) == Counter(plain(rows, 4))


def test_hot_copies(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [0.5, 0.5, 0.5, 0.5], 1) for i in range(400)] + [(400 + i, rng.normal(0, 1, 4).tolist(), i % 2) for i in range(600)]
    assert got(vc.vector_codes(frame(spark, rows))) == Counter(plain(rows, 4))


def test_decoded_components_and_large_components(spark):
    rows = [(i, [float(i), 0.0, 0.0, 0.0], None) for i in range(5)]
    kept, size = vc.integer_vectors(frame(spark, rows))
    books = vc.train(kept, size)
    assert all((books.decoded(r.code)[0], r.error) == (1024 * r.vec_id, 0) for r in vc.encode(kept, books).collect())
    with pytest.raises(Exception, match="in size"):
        vc.vector_codes(frame(spark, [(1, [2.0 ** 20] * 4, None)])).collect()


def test_empty(spark):
    out = vc.vector_codes(frame(spark, []))
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]

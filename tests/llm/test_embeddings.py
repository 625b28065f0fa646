"""Whitening and vector codes against numpy."""

import hashlib
import math

import numpy as np
import pytest

from gaugeworks.llm import qdwh, vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [
    (900, None, 1),
    (901, [1.0] * 15 + [None], 1),
    (902, [float("nan")] + [0.0] * 15, 2),
    (903, [float("inf")] + [0.0] * 15, 2),
    (904, [0.5, 0.5], 2),
    (905, [], None),
]


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def vectors(seed, n=300, length=16):
    rng = np.random.default_rng(seed)
    mixed = rng.standard_normal((n, length)) * np.linspace(0.05, 0.6, length) @ rng.standard_normal((length, length))
    return (mixed + 3 * rng.standard_normal(length)).astype(np.float32)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64])
def test_eigenvectors_are_those_of_the_matrix(n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((3 * n, n)) * np.geomspace(1e-3, 10, n)
    v = x.T @ x
    values, found = qdwh.leading_eigenvectors(v, 5)
    want, basis = np.linalg.eigh(v)
    assert np.allclose(values, want[::-1][:5], rtol=1e-12, atol=1e-13 * want[-1])
    assert np.allclose(np.abs((found * basis[:, ::-1][:, :5]).sum(axis=0)), 1, atol=1e-10)


@pytest.mark.parametrize("values", [[1, 1, 1], [3, 3, 1, 1, 0], [0, 0], [1e12, 1, 1e-6], [5, 4, 3, 2, 1, 0, -1]])
def test_equal_and_extreme_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values), len(values))))
    a = q @ np.diag(np.array(values, float)) @ q.T
    found, basis = qdwh.leading_eigenvectors(a, len(values))
    assert np.allclose(found, sorted(values, reverse=True), atol=1e-12 * max(values + [1]))
    assert np.allclose(basis.T @ basis, np.eye(len(values)), atol=1e-12)
    assert np.allclose(basis * found @ basis.T, a, atol=1e-12 * max(values + [1]))


def test_polar_factor_is_orthogonal_and_splits_signs():
    a = np.diag([1e6, 1.0, 1e-9, -1e-9, -2.0])
    assert np.allclose(qdwh.polar_factor(a), np.diag([1, 1, 1, -1, -1]), atol=1e-12)


def whitened_by_numpy(x):
    n = len(x)
    centred = x - x.mean(axis=0)
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    return e[::-1], u[:, ::-1], cov


def test_whitening_equals_numpy(spark):
    v = vectors(2)
    rows = [(i, [float(c) for c in x], i % 3) for i, x in enumerate(v)] + [(None, [float(c) for c in v[0]], 0)] + ODD
    found = whitening.whiten(table(spark, rows), components=6).collect()
    x = np.floor(64 * np.vstack([v, v[:1]]).astype(float)).astype(np.int64) + 1_000_000
    n = len(x)
    assert len(found) == 6 * n and {r.n for r in found} == {n}
    e, u, cov = whitened_by_numpy(x - 1_000_000.0)
    got = {(r.vec_id, r.component): r for r in found}
    for k in range(6):
        want = (x - x.mean(axis=0)) @ u[:, k] / np.sqrt(e[k])
        own = np.array([got[i, k + 1].whitened for i in range(len(v))])
        sign = np.sign(own @ want[: len(v)])
        assert np.allclose(own, sign * want[: len(v)], atol=1e-6)
        assert math.isclose(got[0, k + 1].explained, e[k] / np.trace(cov), rel_tol=1e-9)
        assert got[None, k + 1].whitened == got[0, k + 1].whitened
    sums = x.sum(axis=0).tolist()
    for i in (0, 7, 299):
        assert got[i, 1].deviation == sum((n * a - s) ** 2 for a, s in zip(x[i].tolist(), sums))
    assert max(r.identity_error for r in found) < 1e-9


def test_whitening_of_little_and_of_constant_tables(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, ODD[:4])).collect() == []
    assert whitening.whiten(table(spark, [ODD[5]])).collect() == []
    same = [(i, [0.25, 0.5], 0) for i in range(5)]
    assert whitening.whiten(table(spark, same)).collect() == []
    # one dimension of three varies: one component
    line = [(i, [0.25, i / 64, 0.0], 0) for i in range(5)]
    found = whitening.whiten(table(spark, line)).collect()
    assert len(found) == 5 and {r.component for r in found} == {1}
    assert sorted(round(abs(r.whitened), 9) for r in found)[0] == 0 and found[0].identity_error < 1e-12


def test_whitening_reads_its_columns_only_and_bounds_huge_entries(spark):
    schema = SCHEMA + ", vector string, n int, whitened string"
    rows = [(i, [math.sin(i), math.cos(i)], 0, "x", 1, "y") for i in range(20)]
    assert whitening.whiten(table(spark, rows, schema)).count() == 40
    huge = [(i, [3e38 if i else -3e38, 0.0], 0) for i in range(4)]
    found = whitening.whiten(table(spark, huge)).collect()
    assert len(found) == 4 and {r.deviation for r in found} == {None}


def codes_by_brute_force(ids, v, parts, entries, rounds):
    whole = np.floor(256 * v.astype(float)).astype(np.int64)
    bounds = vector_codes.part_bounds(v.shape[1], parts)
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, v[i].tolist()))[:entries]
    books = [whole[order, a:b] for a, b in zip(bounds, bounds[1:])]

    def nearest():
        out = []
        for book, a, b in zip(books, bounds, bounds[1:]):
            d = ((whole[:, None, a:b] - book[None]) ** 2).sum(axis=2)
            out.append((d.argmin(axis=1), d.min(axis=1)))
        return out

    for _ in range(rounds):
        found = nearest()
        for p, (entry, _) in enumerate(found):
            a, b = bounds[p], bounds[p + 1]
            for e in range(len(books[p])):
                own = whole[entry == e, a:b]
                if len(own):
                    books[p] = books[p].copy()
                    books[p][e] = [math.floor(s / len(own)) for s in own.sum(axis=0).tolist()]
    found = nearest()
    codes = ["".join(f"{entry[i]:02x}" for entry, _ in found) for i in range(len(ids))]
    text = ",".join(str(x) for book in books for x in book.ravel().tolist())
    return codes, sum(d for _, d in found), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("seed", "n", "length", "parts", "entries"), [(1, 200, 16, 4, 16), (2, 90, 10, 4, 64), (3, 40, 6, 8, 64)])
def test_codes_equal_brute_force(spark, seed, n, length, parts, entries):
    v = vectors(seed, n, length)
    v[5:25] = v[3]
    ids = [i * 7 % 101 for i in range(n - 2)] + [None, None]
    labels = [None if i % 4 == 0 else i % 3 for i in range(n)]
    rows = [(i, [float(c) for c in x], y) for i, x, y in zip(ids, v, labels)] + ODD
    found = vector_codes.compress(table(spark, rows), parts, entries).collect()
    codes, errors, sha = codes_by_brute_force(ids, v, parts, entries, 2)
    by_label = {y: sum(int(e) for e, z in zip(errors, labels) if z == y) for y in set(labels)}
    want = [(i, c, int(e), by_label[y]) for i, c, e, y in zip(ids, codes, errors, labels)]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in found), key=key) == sorted(want, key=key)
    assert {r.codebooks_sha256 for r in found} == {sha}


@pytest.mark.parametrize(("width", "remembered"), [(1, 4), (8, 1 << 16), (100, 7), (10**6, 1)])
def test_memory_and_grid_do_not_change_the_nearest_entry(width, remembered):
    rng = np.random.default_rng(4)
    entries = rng.integers(-90, 90, (32, 4))
    entries[20:] = entries[:12]  # ties
    parts = rng.integers(-120, 120, (3000, 4))
    cells = vector_codes.Cells(entries, width, remembered)
    for at in range(0, 3000, 500):
        own = parts[at : at + 500]
        entry, distance = cells.nearest(own)
        d = ((own[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (entry == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        assert len(cells.place) <= max(remembered, 1)


def test_cells_spare_most_evaluations():
    rng = np.random.default_rng(5)
    entries = rng.integers(-90, 90, (64, 4))
    cells = vector_codes.Cells(entries)
    parts = rng.integers(-100, 100, (20_000, 4))
    cells.nearest(parts)
    assert cells.evaluated < len(parts) * 64 / 3


def test_codes_of_nothing_and_of_clashing_columns(spark):
    assert vector_codes.compress(table(spark, [])).collect() == []
    assert vector_codes.compress(table(spark, ODD[:4])).collect() == []
    assert [r.code for r in vector_codes.compress(table(spark, [ODD[5]])).collect()] == ["00" * 16]
    schema = SCHEMA + ", vector string, code int, _salt int, _label string, error string"
    rows = [(i, [float(i)] * 32, None, "x", 1, 2, "y", "z") for i in range(3)]
    found = vector_codes.compress(table(spark, rows, schema)).collect()
    assert sorted(r.code for r in found) == ["00" * 16, "01" * 16, "02" * 16] and {r.label_error for r in found} == {0}
    huge = [(i, [3e38 * (-1) ** i] * 16, 1) for i in range(4)]
    assert vector_codes.compress(table(spark, huge)).count() == 4

"""Whitening and near duplicates of vectors against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import cross_polytope, whitening
from lattica.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, n long, x int, component_id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 5, 6, "other") for i, v in rows], SCHEMA).repartition(3)


def plain_whitening(rows, wanted=16):
    """id -> (deviation, whitened), explained, by a library's eigenvalues."""
    usable = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    base = np.array(fit, float) - np.array(sums, float) / n
    covariance = base.T @ base / n
    values, columns = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:wanted]
    out = []
    for i, x in usable:
        z = (np.array(x, float) - np.array(sums, float) / n) @ columns[:, order] / np.sqrt(values[order])
        out.append((i, sum((n * c - s) ** 2 for c, s in zip(x, sums)), z))
    return n, out, values[order] / np.trace(covariance)


def compare(got, rows, wanted=16):
    n, want, explained = plain_whitening(rows, wanted)
    k = len(explained)
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    assert len(got) == k * len(want)
    signs = None
    for i, deviation, z in want:
        found = by_id[i, deviation]
        assert sorted(found) == list(range(1, k + 1)) and {r.n for r in found.values()} == {n}
        values = np.array([found[c].whitened for c in sorted(found)])
        if signs is None and np.abs(z).min() > 1e-3:
            signs = np.sign(z * values)
        assert np.allclose(np.abs(values), np.abs(z), atol=1e-6)
        assert signs is None or np.allclose(values * signs, z, atol=1e-6)
        assert np.allclose([found[c].explained for c in sorted(found)], explained, rtol=1e-9)
        assert all(r.identity_error <= 1e-9 for r in found.values())


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    got = QUERIES["op11_whitening"].build(spark, SF_DIR).collect()
    assert all(r.identity_error == got[0].identity_error for r in got)
    compare(got, rows)


def test_whitening_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [(3, rows[3][1]), (3, rows[4][1])]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [math.nan] * 6), (203, [1.0, math.inf, 0.0, 0.0, 0.0, 0.0]), (204, [1.0]), (205, [])]
    got = whitening.whiten(vectors(spark, rows + bad)).collect()
    compare([r for r in got if r.vec_id < 200], rows)
    assert not [r for r in got if r.vec_id >= 200]
    assert len(whitening.whiten(vectors(spark, [(None, v) for _, v in rows])).collect()) == 6 * len(rows)


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None)])).collect() == []
    got = whitening.whiten(vectors(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])).collect()
    assert {(r.component, r.n, r.deviation, r.whitened, r.explained) for r in got} == {(1, 1, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)} and len(got) == 4


def test_deviations_are_exact_and_null_beyond_a_long():
    model = whitening.Whitening(3_000_000_000, (3_000_000_000 * 7 + 5, 11), np.zeros(0), np.zeros((2, 0)), 0.0)
    x = np.array([[7, 0], [8, 1], [107, 0]])
    exact = [sum((model.n * int(c) - s) ** 2 for c, s in zip(row, model.sums)) for row in x]
    assert model.deviations(x) == [e if e < 2**63 else None for e in exact]
    assert exact[0] < 2**63 < exact[1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1e-3, 1.0, 1.0 + 1e-9, 5.0, 80.0, 1e6]) | st.floats(0, 100), min_size=1, max_size=24), st.integers(0, 5))
def test_eigenvectors_by_divide_and_conquer(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.components(a, 16)
    scale = max(np.linalg.norm(a), 1e-300)
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-12
    assert np.abs(e - np.sort(np.linalg.eigvalsh(a))[::-1][: len(e)]).max() <= 1e-12 * scale
    assert np.linalg.norm(a @ v - v * e) <= 1e-12 * scale


@pytest.mark.parametrize("n", [1, 2, 7, 64])
def test_polar_factor_of_a_symmetric_matrix(n):
    a = np.random.default_rng(n).standard_normal((n, n))
    a = a + a.T
    u = whitening.polar(a)
    values, columns = np.linalg.eigh(a)
    assert np.allclose(u, columns @ np.diag(np.sign(values)) @ columns.T, atol=1e-10)


def plain_near_duplicates(rows, threshold=0.95):
    """Rows of id, links and smallest id reachable, from all cosines."""
    whole = [v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    units = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if w else None for w, (_, v) in zip(whole, rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if whole[i] and whole[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold - 1e-12:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (x, _) in enumerate(rows):
        known = least.setdefault(find(i), x)
        least[find(i)] = x if known is None else known if x is None else min(x, known)
    return sorted([(x, links[i], least[find(i)], x == least[find(i)]) for i, (x, _) in enumerate(rows)], key=repr)


def around(rng, centre, cosine):
    """A vector whose cosine with `centre` is about `cosine`."""
    unit = centre / np.linalg.norm(centre)
    turn = rng.standard_normal(len(centre))
    turn -= (turn @ unit) * unit
    return (cosine * unit + math.sqrt(1 - cosine**2) * turn / np.linalg.norm(turn)).tolist()


def grouped_vectors(seed, width):
    """Crowds of near copies, some on the edge of the threshold, chains, copies, multiples, and vectors apart."""
    rng = np.random.default_rng(seed)
    rows = []
    for cosine in (0.999, 0.99, 0.985, 0.976, 0.96):
        centre = rng.standard_normal(width)
        rows += [around(rng, centre, cosine) for _ in range(45)]
    rows += [rows[5]] * 12 + [[3.0 * c for c in rows[7]], [0.25 * c for c in rows[50]]]
    chain = rng.standard_normal(width)
    for _ in range(12):
        chain = np.array(around(rng, chain, 0.957))
        rows.append(chain.tolist())
    rows += [rng.standard_normal(width).tolist() for _ in range(80)]
    order = rng.permutation(len(rows))
    return [(int(i) + 3, rows[i]) for i in order]


@pytest.mark.parametrize("seed,width", [(1, 64), (2, 20)])
def test_near_duplicates_of_groups(spark, seed, width):
    rows = grouped_vectors(seed, width)
    rows += [(900, None), (901, [0.0] * width), (902, [math.nan] * width), (903, [None] * width), (904, []), (905, [1.0] * (width + 1)), (906, [1.0] * (width + 1)), (None, rows[0][1]), rows[1], rows[1]]
    got = cross_polytope.near_duplicates(vectors(spark, rows)).collect()
    want = plain_near_duplicates(rows)
    assert [tuple(r) for r in sorted(got, key=lambda r: repr(tuple(r)))] == want
    assert sum(r[1] for r in want) > 45 * 44 * 2


def test_few_dimensions_lose_hardly_a_link(spark):
    rows = grouped_vectors(3, 3)
    got = {r.vec_id: r for r in cross_polytope.near_duplicates(vectors(spark, rows)).collect()}
    want = {r[0]: r for r in plain_near_duplicates(rows)}
    assert all(got[i].n_links <= want[i][1] for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.999 * sum(r[1] for r in want.values())


def test_near_duplicates_of_nothing(spark):
    assert cross_polytope.near_duplicates(vectors(spark, [])).collect() == []
    got = cross_polytope.near_duplicates(vectors(spark, [(4, None), (None, [0.0, 0.0])])).collect()
    assert sorted(map(tuple, got), key=repr) == [(4, 0, 4, True), (None, 0, None, True)]
    assert cross_polytope.near_duplicates(vectors(spark, [(4, [2.0])])).first() == (4, 0, 4, True)


def test_near_duplicates_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    got = QUERIES["op12_cross_polytope"].build(spark, SF_DIR).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: repr(tuple(r)))] == plain_near_duplicates(rows)


def test_crowds_are_counted_and_not_paired(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    frame = vectors(spark, [(i, around(rng, centre, 0.995)) for i in range(500)])
    rows, usable = cross_polytope.read(frame, "vec_id", "embedding")
    classes = cross_polytope.classes_of(usable, cross_polytope.planned(64, 500))
    core, centres = cross_polytope.cores(classes, 0.95)
    assert core.count() == 500 and cross_polytope.candidates(classes, core, centres, 0.95).count() == 0
    got = cross_polytope.near_duplicates(frame).collect()
    assert {(r.n_links, r.component_id, r.kept) for r in got} == {(499, 0, False), (499, 0, True)}


@pytest.mark.parametrize("width", [1, 2, 8, 64])
def test_rotations_keep_lengths_and_plans_meet_the_threshold(width):
    x = np.random.default_rng(1).standard_normal((5, width))
    hasher = cross_polytope.Hasher(width, cross_polytope.Plan(2, 2, 4))
    turned = hasher._rotated(hasher._padded(x), hasher.turns[0][0])
    assert np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(x, axis=1))
    assert [cross_polytope.planned(width, n).k for n in (10, 10**12)] == sorted(cross_polytope.planned(width, n).k for n in (10, 10**12))

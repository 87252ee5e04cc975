"""The forest against all pairs."""

from __future__ import annotations

import numpy as np

from txquality.llm import tree_forest

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def cloud(seed=0, n=300, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    near = x[:40].repeat(3, 0) + rng.normal(size=(120, d)) * rng.uniform(0.02, 0.35, (120, 1))
    tight = x[0] + rng.normal(size=(80, d)) * 0.01
    return np.concatenate([x, near, tight, x[5:7].repeat(4, 0)]).astype(np.float32)


def all_pairs(x, threshold=0.9):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    linked = u @ u.T >= threshold
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(x)).min(1))
        if (new == label).all():
            return linked.sum(1), label
        label = new


def test_links_and_components(spark):
    x = cloud()
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], SCHEMA)
    n, label = all_pairs(x)
    found = {r.vec_id: r for r in tree_forest.near_duplicates(df, leaf_rows=60, block=16).collect()}
    got = np.array([found[i].n_links for i in range(len(x))])
    assert (got <= n).all() and got.sum() >= 0.99 * n.sum()
    assert np.mean([found[i].component_id == label[i] for i in range(len(x))]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())


def test_blocks_change_nothing(spark):
    x = cloud(3)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    a, b = ({tuple(r) for r in tree_forest.near_duplicates(df, leaf_rows=100, block=k).collect()} for k in (7, 512))
    assert a == b


def test_all_in_one_leaf_is_exact(spark):
    x = cloud(4, 100)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    n, label = all_pairs(x)
    found = {r.vec_id: (r.n_links, r.component_id) for r in tree_forest.near_duplicates(df, block=16).collect()}
    assert found == {i: (int(n[i]), int(label[i])) for i in range(len(x))}


def test_trees_follow_a_bounded_sample():
    x = tree_forest.unit(cloud(5, 2000))
    forest = tree_forest.grow(x, 100)
    lists = forest.leaves_of(x)
    assert forest.leaves > 5 * tree_forest.TREES and all(len(leaves) >= tree_forest.TREES for leaves in lists)
    assert all(leaves == sorted(set(leaves)) for leaves in lists)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 3.0], 0), (5, [1.0, float("nan"), 3.0], 0), (6, [float("inf"), 1.0, 1.0], 0),
        (7, v, 0), (8, v, 1), (8, v, 1), (9, [2.0, 4.0, 6.0], 0), (10, [1.0, 2.0], 0), (None, v, 0), (11, [-1.0, -2.0, -3.0], None),
    ]
    found = [tuple(r) for r in tree_forest.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(found) == len(rows)
    by = {r[0]: r[1:] for r in found}
    assert all(by[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11))
    assert by[7] == (2, 7, True) and by[8] == (2, 7, False) and by[9] == (2, 7, False) and by[None] == (0, None, True)
    assert tree_forest.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_each_length_has_its_own_forest(spark):
    long, short = cloud(6, 80, 16), cloud(7, 60, 5)
    rows = [(2 * i, v.tolist(), 0) for i, v in enumerate(long)] + [(2 * i + 1, v.tolist(), 0) for i, v in enumerate(short)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in tree_forest.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=32).collect()}
    for x, shift in ((long, 0), (short, 1)):
        n, label = all_pairs(x)
        assert [found[2 * i + shift] for i in range(len(x))] == [(int(n[i]), int(2 * label[i] + shift)) for i in range(len(x))]


def test_spill_grows_with_the_depth_until_the_recall():
    spills = [tree_forest.spill_for(d) for d in (1, 10, 20, 40)]
    assert spills == sorted(spills) and spills[0] < spills[-1]
    for d, spill in zip((1, 10, 20, 40), spills):
        assert (1 - (1 - tree_forest.parted(spill)) ** d) ** tree_forest.TREES <= 1 - tree_forest.RECALL
    rng = np.random.default_rng(2)
    for spill in (0.5, 0.8):  # the bound against pairs at the threshold and splits at the middle of the data
        d = 64
        a = tree_forest.unit(rng.normal(size=(200_000, d)))
        other = rng.normal(size=a.shape)
        other -= (other * a).sum(1, keepdims=True) * a
        b = 0.9 * a + np.sqrt(1 - 0.81) * tree_forest.unit(other)
        margin = spill * np.sqrt(0.2 / d)
        p, q = a[:, 0], b[:, 0]
        measured = np.mean((np.minimum(p, q) < -margin) & (np.maximum(p, q) >= margin))
        assert measured <= tree_forest.parted(spill) * 1.05


def test_recall_of_a_deep_forest(spark):
    """Vectors whose id 20 divides against all vectors, with leaves that are small for the table."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 32))
    near = base.repeat(2, 0) + rng.normal(size=(3000, 32)) * 0.3
    x = np.concatenate([base, near]).astype(np.float32)
    u = tree_forest.unit(x)
    asked = np.arange(0, len(x), 20)
    want = (u[asked] @ u.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    found = {r.vec_id: r.n_links for r in tree_forest.near_duplicates(df, leaf_rows=40).collect()}
    got = np.array([found[i] for i in asked])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() > 100


def test_leaves_are_compared_in_waves_that_change_nothing(spark, monkeypatch, tmp_path):
    """Waves move a bounded number of rows, give what one wave gives, and leave no table of vectors behind."""
    x = cloud(9)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    folder, ranges, links, plain = str(tmp_path / "shared"), [], tree_forest.found_links, tree_forest.waves
    monkeypatch.setattr(tree_forest, "waves", lambda rows, limit: ranges.append((rows, limit, plain(rows, limit))) or ranges[-1][2])
    monkeypatch.setattr("txquality.llm.common.shared_dir", lambda _: folder)
    one = {tuple(r) for r in tree_forest.near_duplicates(df, leaf_rows=60).collect()}
    monkeypatch.setattr(tree_forest, "found_links", lambda *a: links(*a, wave_rows=1))
    many = {tuple(r) for r in tree_forest.near_duplicates(df, leaf_rows=60).collect()}
    assert one == many and len(ranges[0][2]) == 1 < len(ranges[1][2])
    rows, limit, parts = ranges[1]
    assert limit <= len(x) and [n for a, b in parts for n in sorted(rows) if a <= n <= b] == sorted(rows)
    assert all(sum(n for leaf, n in rows.items() if a <= leaf <= b) <= limit for a, b in parts)
    left = {p.name.split("-")[1] for p in (tmp_path / "shared").iterdir()}
    assert left and not left & {"vectors", "placed", "links"}


def test_a_wave_is_kept_by_larger_leaves_alone():
    assert tree_forest.waves({3: 5, 1: 4, 8: 20, 9: 2, 12: 8}, 10) == [(1, 3), (8, 8), (9, 12)]
    assert tree_forest.waves({}, 10) == []


def test_shape_meets_the_recall_with_few_leaves_a_vector():
    for rows in (500, 50_000, 2_500_000, 15_000_000):
        trees, spill = tree_forest.shape_for(rows, 1024)
        side = tree_forest.side_of(spill)
        depth = tree_forest.depth_of(rows, 1024, 1.1 * side)
        assert trees >= tree_forest.TREES and (1 - (1 - tree_forest.parted(spill)) ** depth) ** trees <= 1 - tree_forest.RECALL
        few = tree_forest.TREES
        before = tree_forest.spill_for(tree_forest.depth_of(rows, 1024, 1.1 * tree_forest.side_of(0.75)))
        assert trees * (2 * side) ** depth <= few * (2 * tree_forest.side_of(before)) ** tree_forest.depth_of(rows, 1024, 1.1 * tree_forest.side_of(before))


def test_matches_decide_in_double_precision():
    x = tree_forest.unit(cloud(10, 60))
    cosines = x @ x.T
    for threshold in np.sort(cosines.ravel())[-9000:-200:220]:
        found = tree_forest.matches(x, x, float(threshold))
        rough = cosines.astype(np.float32) >= np.float32(threshold)
        assert np.abs(cosines[found != (cosines >= threshold)] - threshold).max(initial=0) < 1e-15
        assert (found != rough).sum() <= 4


def test_pairs_that_met_before_count_once():
    rng = np.random.default_rng(4)
    lists = [np.unique(rng.integers(0, 40, rng.integers(0, 6))) for _ in range(70)]
    for share in (0.01, 0.9):
        found = rng.random((30, 40)) < share
        want = np.array([[found[i, j] and not set(lists[i]) & set(lists[30 + j]) for j in range(40)] for i in range(30)])
        offsets = np.cumsum([0, *map(len, lists)])
        assert (tree_forest.met_before(found.copy(), np.arange(30), np.arange(30, 70), np.concatenate(lists), offsets) == want).all()


def test_signed_zeros_are_one_vector(spark):
    rows = [(1, [0.0, 1.0], 0), (2, [-0.0, 1.0], 0), (3, [1.0, -0.0], 0)]
    found = {tuple(r) for r in tree_forest.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)}

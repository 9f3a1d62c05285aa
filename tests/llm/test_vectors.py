import numpy as np
import pytest


def test_nearest_lattice_points():
    from pulsegrid.llm.lattice_near_duplicates import nearest_lattice_point, shortest_vectors

    near = shortest_vectors()
    assert near.shape == (240, 8) and np.allclose((near**2).sum(1), 2)
    x = np.random.default_rng(1).normal(0, 3, (500, 8))
    p = nearest_lattice_point(x)
    whole = np.isclose(p, np.rint(p)).all(1)
    assert (whole | np.isclose(p - 0.5, np.rint(p - 0.5)).all(1)).all() and np.allclose(p.sum(1) % 2, 0)
    apart = ((x - p) ** 2).sum(1)
    assert (apart[:, None] <= ((x[:, None] - p[:, None] - near[None]) ** 2).sum(2) + 1e-9).all()


def test_near_duplicate_vectors(spark):
    from pulsegrid.llm.lattice_near_duplicates import near_duplicate_vectors

    r = np.random.default_rng(2)
    base = r.normal(size=(60, 64))
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(base)]
    for i in range(120):
        x = base[i % 40]
        noise = r.normal(size=64)
        rows.append((100 + i, (x + noise * r.uniform(0.05, 0.45)).tolist(), (i % 40) % 3))
    rows += [(300 + i, rows[5][1], rows[5][2]) for i in range(4)]
    rows += [(400, None, 1), (401, [0.0] * 64, 1), (402, [float("nan")] * 64, 1), (403, [float("inf")] + [1.0] * 63, 1), (404, [None] + [1.0] * 63, 1), (405, rows[1][1], None), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1)]
    table = spark.createDataFrame([(a, b, c, 9) for a, b, c in rows], "vec_id long, embedding array<double>, label int, class int")
    found = {x["vec_id"]: x for x in near_duplicate_vectors(table).collect()}
    assert len(found) == len(rows)
    good = [(i, np.array(v, float), l) for i, v, l in rows if v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _, _ in rows}
    for i, x, a in good:
        for j, y, b in good:
            if i != j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[i].add(j)
    total = sum(map(len, links.values()))
    assert all(found[i]["n_links"] <= len(x) for i, x in links.items())
    assert sum(x["n_links"] for x in found.values()) >= 0.97 * total > 200
    assert found[300]["n_links"] >= 4 and found[300]["component_id"] == 5 and found[406]["n_links"] == 1
    for i in range(400, 406):
        assert found[i]["n_links"] == 0 and found[i]["component_id"] == i and found[i]["kept"]
    assert near_duplicate_vectors(table.limit(0)).count() == 0


def test_vectors_without_an_id_and_with_the_same(spark):
    from pulsegrid.llm.lattice_near_duplicates import near_duplicate_vectors

    one, other = [1.0] * 16, [1.0] * 15 + [1.1]
    rows = spark.createDataFrame([(1, one, 0, "k"), (1, other, 0, "k"), (None, one, 0, "k"), (2, one, 0, "k"), (3, [-x for x in one], 0, "k")], "vec_id long, embedding array<double>, label int, class string")
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_duplicate_vectors(rows).collect()), key=repr)
    assert found == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (None, 0, None, True)]


@pytest.mark.parametrize("size", [16, 64, 384])
def test_pairs_at_the_threshold_are_found(size):
    from pulsegrid.llm.lattice_near_duplicates import cells, most_differing_bits, sketches

    r = np.random.default_rng(size)
    x, y = r.normal(size=(2, 3000, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * y
    (own_x, probed_x), (own_y, probed_y) = (cells(z, 4, 1.2, 12, 11) for z in (x, y))
    meet = (own_x == own_y) | (probed_x == own_y[:, :, None]).any(2) | (probed_y == own_x[:, :, None]).any(2)
    differ = np.bitwise_count(sketches(x, 11).view(np.uint64) ^ sketches(y, 11).view(np.uint64)).sum(1)
    assert (meet.any(1) & (differ <= most_differing_bits(0.93))).mean() > 0.98

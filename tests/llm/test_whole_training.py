"""Training-data operators on rows that leave none of the job out."""

import numpy as np

from basalt.llm import embeddings


def test_links_of_a_hot_group_in_few_directions(spark):
    """Near copies that differ in two directions, among vectors that vary in all: many centres fall into the group."""
    rng = np.random.default_rng(3)
    hot = np.zeros((500, 64))
    hot[:, 0] = 1
    hot[:, 1:3] = rng.uniform(-0.4, 0.4, (500, 2))
    x = np.concatenate([hot, rng.normal(size=(700, 64))])
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    expected = (u @ u.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, embeddings.Params(per_cell=20, row_block=50, column_block=90)).collect()}
    assert [got[k] for k in range(len(x))] == expected.tolist()


def test_links_do_not_depend_on_the_number_of_cells(spark):
    """Links along the normals between far centres, at a number of cells above which margins used to be narrower."""
    p = embeddings.Params(per_cell=16)
    wide = [embeddings.margins(np.full((1, n), 1.4), 60.0, p)[0, 0] for n in (2, 64, 65, 5000)]
    assert np.allclose(wide, 0.5 * np.sqrt(2 - 2 * 0.95) * 1.4, rtol=1e-12)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    toward = x[:1500] - (x[:1500] * x[1500:]).sum(1)[:, None] * x[1500:]
    toward /= np.linalg.norm(toward, axis=1)[:, None]
    angle = np.arccos(0.9502)
    every = np.concatenate([x, np.cos(angle) * x[1500:] + np.sin(angle) * toward])
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(every)], "vec_id long, embedding array<double>")
    expected = (every @ every.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, p).collect()}
    assert expected.sum() >= 3000 and [got[k] for k in range(len(every))] == expected.tolist()

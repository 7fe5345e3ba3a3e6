import math

import numpy as np

from fieldloom.operators import spatial
from fieldloom.plans import queries


def written(spark, tmp_path):
    r = np.random.default_rng(2)
    x = r.standard_normal((137, 4))
    rows = [(k, int(k % 3 if k < 130 else 3 + k % 2), v.tolist()) for k, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    groups = {g: [k for k, label, _ in rows if label == g] for g in range(5)}
    return x.astype(np.float32).astype(float)[:, :3], groups


def test_views_over_whole_tables_equal_brute_force(spark, tmp_path):
    x, groups = written(spark, tmp_path)
    pairs, widest = set(), {}
    for g, ids in groups.items():
        for at in np.unique(np.linspace(0, len(ids) - 1, max(1, round(len(ids) * 0.2))).round().astype(int)):
            near = sorted((float(((x[j] - x[ids[at]]) ** 2).sum()), j) for j in ids if j != ids[at])
            pairs |= {tuple(sorted((ids[at], j))) for _, j in near[:3]}
        u = x[ids] / np.linalg.norm(x[ids], axis=1)[:, None]
        widest[g] = math.degrees(math.acos(np.abs(u @ u.T).min()))
        gap = [min(np.linalg.norm(x[i] - x[j]) for j in ids if j != i) for i in ids]
        groups[g] = float(np.median(gap))
    assert {(q.a, q.b) for q in queries.nearest_views_whole(spark, str(tmp_path)).collect()} == pairs
    got = {q.label: q.angle for q in queries.widest_angles_whole(spark, str(tmp_path)).collect()}
    assert got.keys() == widest.keys() and all(abs(got[g] - widest[g]) < 1e-3 for g in got)
    spacing = {q.label: q.spacing for q in queries.camera_spacings(spark, str(tmp_path)).collect()}
    assert spacing.keys() == groups.keys() and all(abs(spacing[g] - groups[g]) < 1e-6 for g in groups)


def test_camera_policies_see_all_rows(spark, tmp_path):
    rows = [(1, 50.0, "R", "F"), (1, 3.0, "N", "F"), (2, 50.0, "R", "F"), (3, 1.0, "R", "O")]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {q.l_suppkey: (q.images, q.consistent, q.fixed) for q in queries.camera_policies_whole(spark, str(tmp_path)).collect()}
    assert got == {1: (2, False, False), 2: (1, True, True), 3: (1, True, False)}


def test_pairs_of_one_view_are_none(spark):
    one = spark.createDataFrame([(1, 0, 1.0)], "i int, g int, x double")
    assert spatial.view_pairs(one, ["g"], "i", "i", ["x"], 0.2, 3).count() == 0 and spatial.camera_spacing(one, "i", ["x"], ["g"]).count() == 0

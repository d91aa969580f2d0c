import math
import random

from latticework import registry

SCHEMA = "vec_id long, embedding array<float>, label int"


def embeddings(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_fixed_cutoff_matches_brute_force_and_ignores_other_frames(spark, tmp_path):
    rng = random.Random(1)
    make = lambda ids, frame: [(i, [rng.uniform(-0.5, 0.5) for _ in range(9)], frame) for i in ids]
    one, other = make(range(150), 0), make(range(1000, 1800), 1)
    query = registry.queries()["fixed_cutoff_pairs"]
    alone = query(spark, embeddings(spark, tmp_path / "a", one)).collect()
    both = query(spark, embeddings(spark, tmp_path / "b", one + other)).collect()
    off = lambda a, b: (d := abs(a - b)) and min(d, 1 - d)
    want = {(u, v) for u, a, _ in one for v, b, _ in one if u < v and math.sqrt(sum(off(x, y) ** 2 for x, y in zip(a[:3], b[:3], strict=True))) <= 0.12}
    assert want and {(r.u, r.v) for r in alone} == want
    assert {(r.u, r.v) for r in both if r.frame_index == 0} == want

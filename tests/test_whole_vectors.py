"""Queries on vectors read all rows and whole vectors: small tables on which a cut would show."""

import math

from tidemark.plans import content, similarity

VECTORS = "vec_id long, embedding array<float>, label int"


def table(spark, folder, rows):
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_histogram_counts_pairs_of_all_labels(spark, tmp_path):
    at = lambda c: [c, math.sqrt(1 - c * c)]
    rows = [(0, at(1.0), 3), (1, at(0.75), 3), (2, at(1.0), 4), (3, at(0.75), 4), (4, at(0.35), 4), (5, at(1.0), None), (6, at(1.0), None), (7, at(1.0), 5)]
    got = {round(r.bin, 1): r.n for r in content.cosine_histogram(spark, table(spark, tmp_path, rows)).collect()}
    assert got == {0.7: 2, 0.3: 1, 0.8: 1}


def test_candidates_are_near_in_all_components(spark, tmp_path):
    """Alike in the first twelve components alone is not near; a null label is no label in common; of many copies ten stay."""
    head, unit = [1.0] * 12, lambda n, i: [float(k == i) for k in range(n)]
    far, own = unit(8, 0), unit(8, 1)
    rows = [(0, head + [9 * x for x in far], 1), (1, head + [9 * x for x in own], 1)]
    rows += [(20, unit(20, 15), None), (21, [0.72 * x + math.sqrt(1 - 0.72**2) * y for x, y in zip(unit(20, 15), unit(20, 16))], None)]
    rows += [(n, unit(20, 18), 2) for n in range(28, 41)]
    got = sorted((r.q, r.s, round(r.cosine, 3), r.band) for r in similarity.recall_candidates(spark, table(spark, tmp_path, rows)).collect())
    assert got == [(20, 21, 0.72, "rejected")] + [(40, n, 1.0, "strong") for n in range(28, 38)]

"""Pruned cosine search against the comparison of all, and an embedder whose vectors follow the words."""

import random

from estatelens.operators import vectors as V
from pyspark.sql import functions as F


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "assessment_id int, entity_type string, entity_id long, vector array<float>")


def clustered(r, n, centres, dims=8, spread=0.05):
    middles = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [[x + r.gauss(0, spread) for x in r.choice(middles)] for _ in range(n)]


def same(a, b):
    plain = lambda df: sorted((x["query_id"], x["rank"], x["entity_type"], x["entity_id"], "none" if x["score"] is None else round(x["score"], 9)) for x in df.collect())
    return plain(a) == plain(b)


def test_cells_give_what_all_pairs_give(spark):
    r = random.Random(6)
    data = [(1, "A", k, v) for k, v in enumerate(clustered(r, 900, 12))] + [(2, r.choice("AB"), k, [r.gauss(0, 1) for _ in range(8)]) for k in range(60)]
    data += [(1, "A", 5000 + k, data[7][3]) for k in range(30)] + [(1, "B", 6000 + k, [0.0] * 8) for k in range(4)] + [(2, "A", 900, [0.0] * 8), (2, "A", 901, None)] + [(3, "A", 1, [1.0] * 8), (3, "A", 2, [0.0] * 8), (3, "B", 2, [0.0] * 8)]
    asked = [(k, a, v) for k, (a, _, _, v) in enumerate(data[::25])] + [(1000, 1, data[7][3]), (1001, 1, [0.0] * 8), (1002, 3, [2.0] + [0.0] * 7), (1003, 3, [0.0] * 8), (1004, 9, [1.0] * 8), (1005, 1, None)]
    queries, vectors = spark.createDataFrame(asked, "query_id long, assessment_id int, vector array<float>"), rows_of(spark, data)
    found, report = V.search_cells(queries, vectors, 5, block=64)
    assert same(found, V.cosine_topk_all(queries, vectors, 5)) and found.count() > 100
    opened = {x["assessment_id"]: (x["opened"], x["pairs"]) for x in report.collect()}
    assert opened[1][0] < 0.4 * opened[1][1] and opened[1][0] > 0
    assert same(V.cosine_topk(queries, vectors, 3, ["B"]), V.cosine_topk_all(queries, vectors, 3, ["B"]))
    assert not V.cosine_topk(queries.limit(0), vectors, 3).collect() and not V.cosine_topk(queries, vectors.limit(0), 3).collect()


def test_embedder_follows_words(spark):
    rows = spark.createDataFrame([(1, "red blue"), (2, "blue  RED"), (3, "red red"), (4, None)], "id long, content_text string")
    found = {x["id"]: x["vector"] for x in V.embed(rows, V.hash_embedder(16)).withColumn("vector", F.col("vector")).collect()}
    assert found[1] == found[2] != found[3] and not any(found[4])

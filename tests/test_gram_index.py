"""The stored gram index against plain contains filters."""

import random

import pytest
from pyspark.sql import functions as F

from pathmere.sources import gram_index


def catalog(spark, names):
    return spark.createDataFrame([(f"/v/{k}/{n}", n) for k, n in enumerate(names)], "path_key string, name string")


def names(seed, n):
    rng = random.Random(seed)
    parts = ["Report", "red", "bolt", "\u00e9t\u00e9", "2026", "x", "a b", "-", "inv", "oice"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(n)]


TERMS = ["bolt", "REDBOLT", "\u00e9t\u00e9", "voi", "none here", "inv", "x-x", "ab"]


def terms(spark):
    return spark.createDataFrame(list(enumerate(TERMS)), "query_id long, term string")


def wanted(held):
    return sorted({(q, n.lower()) for q, t in enumerate(TERMS) for n in held if len(t) > 2 and t.lower() in n.lower()})


def found(spark, folder):
    return sorted((r.query_id, r.name_lower) for r in gram_index.matching_names(spark, folder, terms(spark)).collect())


@pytest.mark.parametrize("pushed", [gram_index.PUSHED, 3])
def test_index_follows_the_catalog(spark, tmp_path, monkeypatch, pushed):
    monkeypatch.setattr(gram_index, "PUSHED", pushed)
    folder = str(tmp_path / "grams")
    held = names(1, 150)
    gram_index.build_index(catalog(spark, held), folder, 4)
    assert found(spark, folder) == wanted(held)
    for version, (gone, new) in enumerate([(held[:40], names(2, 30)), (names(2, 30)[:10], held[:20]), ([], [])], 1):
        held = [n for n in held if n not in gone] + new
        touched = spark.createDataFrame([(n.lower(),) for n in gone + new + held[:5]], "name_lower string")
        for _ in range(2):  # written again, a version replaces itself
            gram_index.update_index(catalog(spark, held), touched, folder, version, 2)
        assert found(spark, folder) == wanted(held)
    gram_index.compact_index(spark, folder, f"{folder}-2", 4)
    assert found(spark, f"{folder}-2") == wanted(held)
    paths = gram_index.substring_search(catalog(spark, held), f"{folder}-2", terms(spark)).select("query_id", "path_key").collect()
    assert sorted(map(tuple, paths)) == sorted((q, f"/v/{k}/{n}") for q, t in enumerate(TERMS) for k, n in enumerate(held) if len(t) > 2 and t.lower() in n.lower())


def test_only_wanted_grams_are_read(spark, tmp_path):
    folder = str(tmp_path / "grams")
    gram_index.build_index(catalog(spark, names(3, 200)), folder, 8)
    one = spark.createDataFrame([(1, "bolt")], "query_id long, term string")
    chosen = gram_index.chosen_grams(spark, folder, one)
    assert sorted(r.gram for r in chosen.collect()) == ["bol", "olt"]
    plan = gram_index._postings(spark, folder, chosen)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1].split("]")[0]
    assert "bol" in pushed and "olt" in pushed and "removed" in plan
    files = spark.read.parquet(f"{folder}/postings/version=0").select(F.col("_metadata.file_path").alias("f"), "gram").groupBy("f").agg(F.min("gram").alias("lo"), F.max("gram").alias("hi")).orderBy("lo").collect()
    assert len(files) > 4 and all(a.hi <= b.lo for a, b in zip(files, files[1:]))

"""Exact top-k where ids repeat, against the registered SQL."""

import random
import re

import pytest

from marram.llm import registry, topk


@pytest.mark.parametrize("shard_rows", [4096, 20])
def test_every_row_counts(spark, monkeypatch, tmp_path, shard_rows):
    import duckdb

    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    rng = random.Random(2)
    rows = [(rng.randrange(90), [rng.gauss(0, 1) for _ in range(8)]) for _ in range(300)]
    rows += rows[:20]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, registry.op4_topk(spark, f"file://{tmp_path}").collect()))
    sql = re.sub(r"\bFROM embeddings\b", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'", registry.ORACLES["op4_topk"])
    assert got == sorted(duckdb.sql(sql).fetchall())

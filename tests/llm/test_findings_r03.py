"""Findings of round 3 on training-data operators: memory that grew with the input, and models that came from samples."""

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from latticework.llm import quality, search


def test_a_task_decodes_few_shards_at_a_time(spark, monkeypatch):
    """However many documents a task lays out, a row group holds a few shards, and so does a batch of a search (F1)."""
    most, sizes, write = [], [], search.materialize

    def watched(df, *rows):
        sizes.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
        out = write(df, *rows)
        if "owners" in out.columns:
            files = [pq.ParquetFile(p).metadata for p in Path(out._latticework_path).glob("*.parquet")]
            most.extend(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups))
        return out

    monkeypatch.setattr(search, "materialize", watched)
    monkeypatch.setattr(search, "SHARD", 16)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.col("id") % 7, "id").alias("text")).coalesce(1)
    assert search.bm25_top_k(docs, docs.where("doc_id < 9"), 3).count() == 27
    assert len(most) > 5 and max(most) <= 4
    assert "8m" in sizes and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_quality_learns_from_every_labelled_document(spark, monkeypatch):
    """Means and threshold are those of all training documents, more than 2,000 of a class, whatever the groups (F9)."""
    monkeypatch.setattr(quality, "GROUP", 300)
    texts = {i: f"the {i % 13} cat sat on mat {i % 7}." if i % 9 else f"BUY {i % 5}!! $$$ now {i % 11}" for i in range(4000)}
    docs = spark.createDataFrame([*texts.items(), (0, texts[0]), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 > 0)) for i in texts], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    own = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sum(i % 9 > 0 for i in own) > 2000
    every = pa.array([texts[i] for i in own])
    assert np.allclose(model.mean, quality.features(every).astype(float).mean(0), atol=1e-9)
    below = model.scores(every) < quality.LEVEL
    assert below.tolist() == [i % 9 == 0 for i in own]

"""Token counts over files: which texts are encoded, and that none of them is shuffled for it."""

from __future__ import annotations

import public_tokenizers

from echolens.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_texts_of_files_are_encoded_where_they_are_read(spark, tmp_path, monkeypatch):
    texts = [None, "", *[f"text {i % 700} of many" for i in range(2100)]]
    path, cache = str(tmp_path / "docs"), str(tmp_path / "cache")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(path)
    docs, plans = spark.read.parquet(path), []
    kind = type(docs)
    plain = kind.mapInArrow

    def seen(self, *args):
        plans.append((self._jdf.queryExecution().executedPlan().toString(), self.count()))
        return plain(self, *args)

    monkeypatch.setattr(kind, "mapInArrow", seen)
    token_counts.token_counts(docs.where("doc_id < 300"), PATH, cache)
    counts = token_counts.token_counts(docs, PATH, cache).collect()
    # Each distinct text once: those of the earlier run, then the others.
    assert [n for _, n in plans] == [299, 402]
    assert all("Exchange hashpartitioning" not in plan for plan, _ in plans)
    assert sorted((r.doc_id, r.n_bytes) for r in counts) == [(i, len((t or "").encode())) for i, t in enumerate(texts)]
    assert spark.read.parquet(cache).select("content").distinct().count() == spark.read.parquet(cache).count() == 701

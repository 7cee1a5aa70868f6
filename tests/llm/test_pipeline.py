"""The pipeline, stage by stage, against what each stage has to do."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from collections import Counter  # noqa: E402

from test_documents import AWKWARD, brute_groups, brute_leaks, check_shards, docs_of, near_copies, quality_rows  # noqa: E402


def test_stages(spark, tmp_path):
    rows, labels = quality_rows(240)
    good = [r for r in rows if r[0] % 4 > 0]
    copies = [(1000 + r[0], r[1].lower(), "en", "st"[r[0] % 2], 0) for r in near_copies(5, families=3, size=10)]
    item = "seven blue foxes were counted at the old mill before the rain came down in sheets"
    leaks = [(3000 + i, f"the house {item} and the river", "en", "s", 0) for i in range(3)]
    every = rows + copies + leaks
    docs_of(spark, every).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels, *[(c[0], 1, 0) for c in copies], (3000, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        seen[name] = (before, docs.collect())
        if name != "shard":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert {tuple(r) for r in seen[name][1]} <= set(before)
    kept = {r.doc_id for r in seen["quality"][1]}
    assert not {r[0] for r in rows if r[0] % 4 == 0} & kept
    assert len({r[0] for r in [*good, *copies, *leaks]} - kept) <= 4
    before, after = seen["near_duplicates"]
    assert sorted(r.doc_id for r in after) == sorted({c for d, n, c in brute_groups(before, 80)})
    before, after = seen["decontaminate"]
    bad = {d for d, _ in brute_leaks(before, [(1, item)])}
    assert bad and {r.doc_id for r in after} == {r[0] for r in before} - bad
    before, after = seen["mix"]
    assert max(Counter(r.doc_id for r in after).values()) <= 2
    total = sum(len(r[1].split()) for r in before)
    assert abs(sum(len(r.text.split()) for r in after) - 1.5 * total) <= 2 * max(len(r[1].split()) for r in before)
    check_shards(*seen["shard"])
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.shard) for r in again) == Counter((r.doc_id, r.shard) for r in seen["shard"][1])


def test_stages_on_awkward_rows(spark, tmp_path):
    """Null ids, repeated rows, blank texts, columns named like inner ones, and
    empty tables."""
    from pyspark.sql import functions as F

    extra = ("size", "key", "target", "taken", "cls", "kept", "shard", "slot", "_row", "_id", "_leaked", "__words", "draw", "log_weight", "class", "check", "_of")
    rows = docs_of(spark, [*AWKWARD, *AWKWARD[-3:]]).select("*", *[F.lit("x").alias(c) for c in extra])
    for name, frame in (("some", rows), ("none", rows.where("false"))):
        folder = tmp_path / name
        frame.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (8, 1, None)] if name == "some" else [], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(1, None), (2, "not in any of them at all")] if name == "some" else [], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        for stage, step in corpus_pipeline.STAGES:
            out = step(spark, frame, str(folder))
            count = out.count()
            assert (count > 0) == (name == "some"), stage
            assert stage == "shard" or out.columns == frame.columns, stage
        assert (corpus_pipeline.run(spark, str(folder)).count() > 0) == (name == "some")

"""Cases that the operators have to bear together: clashing columns, conflicting labels, rows of one id, ties, long texts."""

import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import co_training, common, mixing, near_duplicates, token_output, toxicity


def prose(rng, k):
    return " ".join(rng.choice("aeiou") + "".join(rng.choice("bcdfghjklm") for _ in range(5)) + (" the" if i % 4 == 0 else "") for i in range(k))


def test_clashing_columns_pass_the_pipeline(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, prose(rng, 120), "en", f"s{i % 2}", 5) for i in range(30)]
    rows += [(50, rows[0][1], "en", "s0", 5), (3, rows[3][1], "en", "s1", 6), (None, prose(rng, 90), None, None, None)]
    names = ["_id", "_key", "_twice", "_row", "_hash", "_doc", "key", "row", "node", "root", "source_size", "start", "part", "anchor"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "x"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        assert {r.anchor for r in now.collect()} == {len(names) - 1}, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 20


def test_empty_pipeline(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_an_id_and_text_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", x) for x in (3, 1, 2)], "doc_id long, text string, x int")
    kept = [near_duplicates.kept(docs.orderBy(order)).collect() for order in ("x", "text")]
    assert len(kept[0]) == 1 and kept[0] == kept[1]


def test_conflicting_labels(spark):
    docs = spark.createDataFrame([(i, "glorp me" if i % 2 else "fine day") for i in range(60)], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(60)] + [(2, 1), (3, 0)]
    picked = [toxicity.training(docs, spark.createDataFrame(rows[::step], "doc_id long, toxic int")).groupBy("toxic").count().collect() for step in (1, -1)]
    of = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert [{r.toxic: r["count"] for r in p} for p in picked] == [dict(Counter(1 if i % 2 or i == 2 else 0 for i in of))] * 2


def test_rows_of_one_id_are_spread_and_ordered(spark, tmp_path):
    rng = random.Random(2)
    rows = [(None, prose(rng, 5)) for _ in range(400)] + [(7, None), (7, ""), (7, "long " * 200_000), (-1, "x"), (9, prose(rng, 3))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(token_output.query(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == [None] * 400 + [-1, 7, 7, 7, 9]
    encode = token_output.encoder(token_output.vocabulary(), 1)
    want = Counter((i, zlib.crc32(encode(t))) for i, t in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    parts = token_output.encoded(spark.createDataFrame(rows, "doc_id long, text string"), token_output.vocabulary(), 1, 8).where("doc_id is null").select("part").distinct().count()
    assert parts > 2


def test_ties_in_the_mix(spark):
    rows = [(None, f"w{i % 9} w w", "s") for i in range(900)] + [(1, "a b", "s"), (1, "b a", "s")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [Counter(map(tuple, mixing.stage(spark, docs.repartition(n), "").collect())) for n in (1, 5)]
    assert runs[0] == runs[1]
    shards = mixing.in_shards(
        docs.select("source", mixing.order_key(mixing.Mix()).alias("order_key")),
        spark.createDataFrame([("s", 1, 1.0, 1, 1, 64)], "source string, source_size long, target double, block long, blocks long, n_shards long"),
    )
    assert shards.select("shard").distinct().count() > 5


def test_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "s", "en", 5) for i in range(20)], "doc_id long, text string, source string, lang string, n_chars long")
    out = co_training.classified(docs, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")).collect()
    assert len(out) == 20 and {round(r.score, 6) for r in out} == {0.5}


def test_broadcasts_are_bounded(spark):
    table = common.written(spark.range(10_000))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(common.small(table)) and not hinted(common.small(table, 100_000))
    common.forget(table)
    with pytest.raises(Exception, match="(?i)does not exist|not found|no such"):
        table.collect()

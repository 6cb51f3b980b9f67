import os

import pytest
from pyspark.sql import functions as F

from tessera.streaming import store as st

COLS = "file_id long, path string, language string, text string"


def code(name, *calls):
    return f"class {name} {{ void Run{name}() {{ {' '.join(c + '();' for c in calls)} }} [Fact] void Check() {{ Run{name}(); }} }}"


FIRST = {"a.cs": code("A", "RunB"), "b.cs": code("B"), "c.sql": "SELECT * FROM t", "d.cs": code("D", "RunA", "RunB"), "e.cs": code("E")}
# an edit, a deletion, a rename and a new file
SECOND = {"a.cs": code("A", "RunE"), "c.sql": "SELECT * FROM t", "d2.cs": code("D", "RunA", "RunB"), "e.cs": code("E"), "f.sql": "DELETE FROM t"}


def frame(spark, texts, cols=COLS):
    rows = spark.createDataFrame(list(texts.items()), "path string, text string")
    kind = F.when(F.col("path").endswith(".cs"), "csharp").otherwise("sql")
    return rows.select(F.xxhash64("path").alias("file_id"), "path", kind.alias("language"), "text")


def rows(df):
    return sorted(map(str, df.collect()))


def parsed(spark, texts, tmp_path):
    fresh = st.Store(spark, str(tmp_path / f"fresh{len(os.listdir(tmp_path))}"), st.of_code())
    fresh.sync(frame(spark, texts))
    return {name: rows(fresh.table(name)) for name in ("files", "nodes", "members", "edges", "items")}


def tables(store):
    return {name: rows(store.table(name)) for name in ("files", "nodes", "members", "edges", "items")}


@pytest.fixture
def store(spark, tmp_path):
    return st.Store(spark, str(tmp_path / "store"), st.of_code(), buckets=5)


def test_snapshots(spark, tmp_path, store):
    assert store.table("nodes").count() == 0
    assert store.sync(frame(spark, FIRST)) == 5
    assert tables(store) == parsed(spark, FIRST, tmp_path)
    assert store.sync(frame(spark, SECOND)) == 5  # a, b, d, d2, f
    assert tables(store) == parsed(spark, SECOND, tmp_path)
    assert store.sync(frame(spark, SECOND)) == 0
    assert tables(store) == parsed(spark, SECOND, tmp_path)


def test_changes_and_replay(spark, tmp_path, store):
    store.apply(frame(spark, FIRST), 0)
    gone = frame(spark, {"b.cs": "", "d.cs": ""}).withColumn("text", F.lit(None).cast("string"))
    change = frame(spark, {k: SECOND[k] for k in ("a.cs", "d2.cs", "f.sql")}).unionByName(gone)
    assert store.apply(change, 1) == 5
    want = parsed(spark, SECOND, tmp_path)
    assert tables(store) == want
    assert store.apply(change, 1) == 0 and store.apply(frame(spark, FIRST), 0) == 0
    assert tables(store) == want
    # of several changes of a file the last counts, and one that leaves all as it is moves nothing
    a = frame(spark, {"a.cs": "class Other { }"}).withColumn("seq", F.lit(1)).unionByName(frame(spark, {"a.cs": SECOND["a.cs"]}).withColumn("seq", F.lit(2)))
    before = store.manifest()[1]
    assert store.apply(a, 2) == 0
    assert store.manifest()[1] == before and tables(store) == want


def test_a_change_that_breaks_off_leaves_all_as_it_was(spark, tmp_path, store):
    store.sync(frame(spark, FIRST))
    want = tables(store)
    make = store.tables["items"]
    store.tables["items"] = lambda files, made: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        store.sync(frame(spark, SECOND))
    assert tables(store) == want
    store.tables["items"] = make
    store.sync(frame(spark, SECOND))
    assert tables(store) == parsed(spark, SECOND, tmp_path)


def test_only_touched_buckets_are_written_and_old_ones_deleted(spark, tmp_path, store):
    store.sync(frame(spark, FIRST))
    text = dict(FIRST)
    for i in range(4):
        text["e.cs"] = code("E", f"Call{i}")
        assert store.sync(frame(spark, text)) == 1
    number, generations, _ = store.manifest()
    assert number == 5 and sorted(generations.values())[-1] == 5 and sorted(generations.values())[0] == 1
    held = {g for g in os.listdir(tmp_path / "store" / "nodes")}
    assert held <= {"g=1", "g=4", "g=5"}
    assert len(os.listdir(tmp_path / "store" / "manifest")) == 2


def test_stream(spark, tmp_path, store):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    for texts in (FIRST, {"e.cs": code("E", "RunA")}):
        frame(spark, texts).withColumn("seq", F.lit(len(texts)).cast("long")).write.mode("append").parquet(source)
        st.followed(spark, source, store, checkpoint).awaitTermination(120)
    assert tables(store) == parsed(spark, FIRST | {"e.cs": code("E", "RunA")}, tmp_path)

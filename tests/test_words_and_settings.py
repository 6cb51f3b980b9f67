import json
import random

from tessera.operators import findings as fi
from tessera.sources import files as src


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + row[1:], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def changed(rng, w, n):
    w = list(w)
    for _ in range(n):
        at = rng.randrange(len(w) + 1)
        w[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "b", "xy"[:1]])
    return "".join(w)


def words(rng, n):
    return ["".join(rng.choice("abcAB") for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 20, 22, 23, 24, 25, 26, 27, 40]))) for _ in range(n)]


def test_nearest_words(spark):
    rng = random.Random(1)
    known = sorted(set(words(rng, 120)))
    unknown = sorted({changed(rng, rng.choice(known), rng.randrange(5)) for _ in range(200)} | {"", "zzz"})
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    got = {(r.word, r.suggestion, r.distance) for r in fi.suggestions(frame(unknown), frame(known)).collect()}
    want = set()
    for u in unknown:
        near = [(d, k.lower(), k) for k in known if (d := edits(u.lower(), k.lower())) <= 2]
        if near:
            want.add((u, min(near)[2], min(near)[0]))
    assert got == want


def test_candidates_are_few(spark):
    rng = random.Random(2)
    known = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([9, 10, 11, 40]))) for _ in range(600)})
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    assert fi.near_words(frame([w + "x" for w in known]), frame(known)).count() <= 2 * len(known)


def test_settings_with_comments_and_trailing_commas(spark):
    text = """{ // a comment, with "quotes" and { braces
      "Url": "http://x//y", /* more * of / it */ "Odd": "a,] /* no comment */ \\" //", "List": [1, 2, ], "Empty": {}, "None": [],
      "Deep": { "A": { "B": null, }, }, "On": true, "Price": 1.50,
    }"""
    rows = [(1, text), (2, "{"), (3, ""), (4, None), (5, '"alone"'), (6, "[{}, 7]"), (7, "{} // end")]
    files = spark.createDataFrame(rows, "file_id long, text string")
    got = {(r.file_id, r.path): r.value for r in src.json_leaves(files).collect()}
    assert got == {
        (1, "Url"): "http://x//y", (1, "Odd"): 'a,] /* no comment */ " //', (1, "List:0"): "1", (1, "List:1"): "2", (1, "Deep:A:B"): None, (1, "On"): "true", (1, "Price"): "1.5", (6, "1"): "7",
    }
    assert {r.file_id for r in src.malformed(files).collect()} == {2, 3, 4, 5}


def test_deep_and_long_settings(spark):
    deep = {}
    for i in range(90):
        deep = {f"k{i}": deep or "x"}
    wide = {f"key{i}": "v" * 2000 for i in range(200)}
    got = src.json_leaves(spark.createDataFrame([(1, json.dumps(deep)), (2, json.dumps(wide)), (3, json.dumps({"s": "é\"\\" * 50000}))], "file_id long, text string"))
    assert {r.file_id: r["count"] for r in got.groupBy("file_id").count().collect()} == {1: 1, 2: 200, 3: 1}

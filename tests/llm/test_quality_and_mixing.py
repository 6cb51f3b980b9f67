import re
from collections import Counter

import pytest

from tessera.llm import mixing, quality_rules

TEXTS = [None, "", "a b c", " ".join(f"w{i}" for i in range(30)), "the cat sat on the mat at noon\n" * 9, "x " * 5000, "a\tb\x0bc\x0cd\re # $ |", "é" * 3000, "a b c d e f g h " * 2 + "z a b c d e f g h", "one\n\none\n \none two"]


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = Counter(win)
    cov = {i + k for i, x in enumerate(win) if c[x] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), dup, len(cov)


def test_measures(spark):
    rows = [(i, x, "extra") for i, x in enumerate(TEXTS)] * 2 + [(None, "a b", None)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_stage_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 3, "x"), (2, " ".join(f"de la w{i}" for i in range(20)), "y")], "doc_id long, text string, kept string")
    out = quality_rules.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert [r.doc_id for r in out.collect()] == [2]


def apportion(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda j: (votes[j] / (2 * won[j] + 1), -j))
        won[i] += 1
    return won


@pytest.mark.parametrize(("votes", "seats"), [([5, 3, 1], 9), ([1, 1, 1, 1], 2), ([100] + [1] * 50, 60), ([0, 7, 7], 5), ([3.3, 9.1, 2.2, 80.7], 1000)])
def test_highest_quotients(spark, votes, seats):
    df = spark.createDataFrame([(i, float(v), seats) for i, v in enumerate(votes)], "i int, votes double, seats long")
    got = mixing.sainte_lague(df, [], "votes", "seats", ["i"], "won").orderBy("i").collect()
    assert [r.won for r in got] == apportion(votes, seats)


def test_mix(spark, tmp_path):
    rows = [(i, "w " * (i % 90), f"s{i % 5}" if i % 7 else None) for i in range(2000)]
    rows += [(3, "w w w", "s1")] * 3 + [(None, None, "s2"), (4, "w", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        t = by.setdefault(r.source_size, [r.target, 0])
        t[1] += r.taken
    assert all(abs(t - x) <= 0.01 * t for t, x in by.values())
    total = sum(r.size for r in got)
    assert sum(t for t, _ in by.values()) == pytest.approx(1.5 * total)
    again = mixing.query(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mix = mixing.stage(spark, docs.withColumn("start", docs.doc_id), "")
    assert mix.columns == [*docs.columns, "start"]
    assert sum(len(r.text.split()) for r in mix.collect()) == sum(r.taken for r in got)


def test_a_tiny_source_changes_nothing_for_the_others(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(200 + i % 50)), f"s{i % 3}") for i in range(1500)]
    made = {}
    for name, more in (("plain", []), ("tiny", [(9000, "two words", "zz")])):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string, source string")
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = {r.doc_id: r for r in mixing.query(spark, str(tmp_path / name)).collect()}
        texts = {r.doc_id: [] for r in got.values()}
        for r in mixing.stage(spark, docs, "").collect():
            texts[r.doc_id].append(r.text)
        made[name] = got
        by_id = dict((i, t) for i, t, _ in rows + more)
        # every text of the mix is one piece of its document, and few are cut
        assert all(t in by_id[i] for i, ts in texts.items() for t in ts)
        assert sum(t != by_id[i] for i, ts in texts.items() for t in ts) <= 2 * 3
    tiny = made["tiny"].pop(9000)
    assert tiny.target == 4 and tiny.taken == 4
    for source in ("s0", "s1", "s2"):
        words = [sum(r.taken for r in got.values() if rows[r.doc_id][2] == source) for got in made.values()]
        assert abs(words[0] - words[1]) <= 256


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert mixing.query(spark, str(tmp_path)).count() == 0
    assert quality_rules.query(spark, str(tmp_path)).count() == 0

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import token_output as t

PATH = t.vocabulary()
PLAIN = Tokenizer.from_file(PATH)


def plain(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]


ENCODE = t.Encoder(PATH, 1)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_words_give_the_ids_of_the_whole(text):
    assert ENCODE.by_word
    assert np.frombuffer(ENCODE(text), dtype=np.int32).tolist() == plain(text)


@pytest.mark.parametrize("text", ["a b c", "é ́x", "<|endoftext|> x<|startoftext|>y", "don't  DON'T\t\nit's", "x\x1cy \x85z", "　日本語 ١٢٣", ""])
def test_odd_texts(text):
    assert np.frombuffer(ENCODE(text), dtype=np.int32).tolist() == plain(text)


def test_round_trip(spark, tmp_path):
    rows = [(5, "Hello world"), (None, "first"), (3, None), (3, ""), (9, "x " * 3000), (5, "Hello world")]
    docs = spark.createDataFrame([(i, x, i) for i, x in rows], "doc_id long, text string, part long")
    t.write(docs.select("doc_id", "text"), str(tmp_path / "ids"))
    files = t.read(spark, str(tmp_path / "ids"))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = t.digest(files).orderBy("start").collect()
    start = 0
    for row, (i, x) in zip(got, want, strict=True):
        ids = plain(x)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    stored = files.orderBy("part", "before").collect()
    assert [list(r.ids) for r in stored] == [plain(x) for _, x in want]


def test_empty(spark, tmp_path):
    t.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    assert t.digest(t.read(spark, str(tmp_path / "none"))).count() == 0

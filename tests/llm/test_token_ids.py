import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweave.llm import simple8b
from chronoweave.llm.token_ids import encoder_of, read_id_files, write_id_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 49407), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 70))
def test_round_trip(values, block):
    v = np.array(values, np.uint64)
    words, offsets = simple8b.encode(v, block)
    assert simple8b.decode(words, offsets, len(v), block).tolist() == values


def test_file_blocks():
    v = np.random.default_rng(1).integers(0, 49408, 10_000)
    data = simple8b.pack_file(v, np.array([5]), np.array([10_000]))
    ids, docs, counts = simple8b.unpack_file(data)
    assert (ids == v).all() and docs.tolist() == [5] and counts.tolist() == [10_000]
    assert (simple8b.block_values(data, 1) == v[1024:2048]).all() and (simple8b.block_values(data, 9) == v[9216:]).all()


def test_against_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = {7: "Hello  WORLD's\n\nit's\t naïve  été ́x", 3: None, 5: "", 9: "<|endoftext|> 12 a\x1cb ΟΔΟΣ Σ. don't", 1: "x " * 50_000, 2: "¡¿ \r\n ñ!!"}
    for extra in range(20, 30):
        texts[extra] = texts[7]
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in read_id_files(write_id_files(df, PATH)).collect()}
    at = 0
    for k in sorted(texts):
        ids = np.array([*t.encode(texts[k] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())), k
        at += len(ids)


def test_empty(spark):
    assert read_id_files(write_id_files(spark.createDataFrame([], "doc_id long, text string"), PATH)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abC éÀß'’_-.,12\n\t\x0b\x1c\u00a0Σς<|>İıŉ½²ªe\u0301"), st.sampled_from(["'S ", "'LL", "<|endoftext|>", "don't"])), max_size=40).map("".join))
def test_parts_equal_library(text):
    c = encoder_of(PATH)
    assert c.by_parts and c.encode([text]) == [np.array(c.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def changed(tmp_path, **new):
    """The file with other steps."""
    with open(PATH) as f:
        m = json.load(f)
    m.update(new)
    at = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
    at.write_text(json.dumps(m))
    return str(at)


def test_other_files(spark, tmp_path):
    """Ids are the library's for any file: others than the one known to drop white space are encoded whole."""
    from tokenizers import Tokenizer

    texts = ["Hello  World\n\n don't  stop", " x", "", "a b  ", "İstanbul <|endoftext|> z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with open(PATH) as f:
        added = json.load(f)["added_tokens"]
    files = [PATH, public_tokenizers.path("byte_bpe_50k.json"), changed(tmp_path, normalizer={"type": "NFC"}), changed(tmp_path, added_tokens=[{**t, "rstrip": True} for t in added])]
    for path in files:
        t = Tokenizer.from_file(path)
        got = {r.doc_id: r for r in read_id_files(write_id_files(df, path)).collect()}
        for k, x in enumerate(texts):
            ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
            assert (got[k].n_tokens, got[k].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())), (path, x)
        assert encoder_of(path).by_parts == (path == PATH)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_corpus_equals_library(spark, name):
    c = encoder_of(public_tokenizers.path(name))
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert c.encode(texts) == [np.array(c.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_hot_and_null_ids(spark):
    """Starts follow one another over many files and tasks, a null id first, equal ids apart."""
    rows = [(7, f"word {i} " * 3) for i in range(300)] + [(None, "no id"), (None, "no id"), (9, "last"), (-1, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(read_id_files(write_id_files(df, PATH)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -1, *[7] * 300, 9]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()

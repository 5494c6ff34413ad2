from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweave.llm import wfst

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\tabé▁"), st.sampled_from("the in ration▁ ")), max_size=40)


@pytest.fixture(scope="module")
def machine():
    return wfst.compile_model(PATH)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def model(**changes):
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(PATH, "rb") as f:
        m.ParseFromString(f.read())
    for k, v in changes.items():
        setattr(m.trainer_spec if hasattr(m.trainer_spec, k) else m.normalizer_spec, k, v)
    return m


def saved(m, path):
    import sentencepiece

    path.write_bytes(m.SerializeToString())
    return sentencepiece.SentencePieceProcessor(model_file=str(path)), wfst.compile_model(str(path))


def paths(m, s, before=-1):
    """Every path over a text: (weight, pieces), one by one; missing arcs left out."""
    if not s:
        return [(0.0, ())]
    found, covered = [], False
    for i, p in enumerate(m.pieces):
        if p and s.startswith(p[0]) and (m.kind == wfst.UNIGRAM or m.steps[i] is not None):
            covered |= len(p[0]) == 1
            if m.kind == wfst.UNIGRAM or before < 0 or m.apart(before, i):
                found += [(w + (m.weight[i] if m.kind == wfst.UNIGRAM else 0), (i, *r)) for w, r in paths(m, s[len(p[0]) :], i)]
    if not covered:
        found += [(w + m.byte_cost, (*(m.byte_ids[x] for x in s[0].encode()), *r)) for w, r in paths(m, s[1:])]
    return found


SMALL = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca", "cab", "▁ab", "aa", "aaa", "▁▁"]


def small(kind, scores):
    pieces = [None] + [None] * 256 + [(p, float(w)) for p, w in zip(SMALL, scores, strict=True)]
    return wfst.Machine(pieces, list(range(1, 257)), wfst.Rewrites({}), kind)


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(len(SMALL))), st.text("abcé▁", max_size=9))
def test_one_path_of_merges(scores, s):
    """Of all segmentations one has a finite weight, and it is what merging gives."""
    m = small(wfst.MERGES, scores)
    found = paths(m, s)
    assert len(found) == 1
    parts, _ = wfst.merged(s, m.rank)
    ids = [i for p in parts for i in ([SMALL.index(p) + 257] if p in SMALL else [m.byte_ids[x] for x in p.encode()])]
    assert list(found[0][1]) == ids == m.shortest_path(s)[0]


@settings(max_examples=100, deadline=None)
@given(st.permutations(range(len(SMALL))), st.text("abcé▁", max_size=9))
def test_least_of_all_paths(scores, s):
    m = small(wfst.UNIGRAM, scores)
    ids, w = m.shortest_path(s)
    assert w == pytest.approx(min(w for w, _ in paths(m, s)))
    assert (w, tuple(ids)) in [(pytest.approx(a), b) for a, b in paths(m, s)]


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_equal_library(machine, library, text):
    ids = array("I", machine.encode(text)).tolist()
    assert ids == library.encode(text)
    assert machine.decode(machine.encode(text)) == text.replace("▁", " ")
    assert ids == machine.shortest_path(machine.rewrites(text))[0]  # words one by one, or the whole at once


def test_corpus_equals_library(spark, machine, library):
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toLocalIterator():
        assert array("I", machine.encode(r.text)).tolist() == library.encode(r.text or "")


def test_unigram_equals_library(spark, tmp_path):
    """The same file read as a unigram model. The library adds 32-bit floats, so weights of 10^9 are cut first."""
    proto = model(model_type=1)
    for p in proto.pieces:
        p.score = max(p.score, -40_000)
    lib, m = saved(proto, tmp_path / "m.model")
    byte = set(m.byte_ids)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150).collect()
    texts = [r.text[:400] for r in rows] + ["  two  spaces ", "tab\tnew\nline 漢字 🙂", "a"]
    same = 0
    for t in texts:
        ids, other = array("I", m.encode(t)).tolist(), lib.encode(t)
        cost = lambda x: sum(-lib.get_score(i) for i in x if i not in byte)
        assert cost(ids) == pytest.approx(cost(other)) and lib.decode(ids) == t
        same += ids == other
    assert same >= 0.9 * len(texts)


def test_piece_over_words(tmp_path):
    """With a piece that holds the space's sign inside, texts aren't cut into words."""
    proto = model()
    proto.pieces[-1].piece, proto.pieces[-1].score = "e▁t", -1.5
    lib, m = saved(proto, tmp_path / "m.model")
    assert not m.by_words
    for t in ("the time", "bee tree  e the", " e t", ""):
        assert array("I", m.encode(t)).tolist() == lib.encode(t)
    assert len(proto.pieces) - 1 in lib.encode("bee tree")


def test_normaliser(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as p

    proto, rules = model(), p.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto())
    proto.normalizer_spec.CopyFrom(rules.normalizer_spec)
    lib, m = saved(proto, tmp_path / "m.model")
    for t in ("ﬁne Ⅷ  １２３ ｶﾞ é ①\t\n x ㌔ ﷺ", "  a  b ", " ", "", "　漢 字　", "Å̧"):
        assert array("I", m.encode(t)).tolist() == lib.encode(t), t


def test_refused(tmp_path):
    for proto in (model(byte_fallback=False), model(model_type=3), model(treat_whitespace_as_suffix=True), model(escape_whitespaces=False)):
        (tmp_path / "m.model").write_bytes(proto.SerializeToString())
        with pytest.raises(ValueError):
            wfst.compile_model(str(tmp_path / "m.model"))


def test_documents(spark):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (4, "漢字🙂 " * 20_000), (1, "Hello  world"), (5, "a▁b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as `a.b`", "3 as `N_tokens`")
    enc = wfst.encode_documents(df.drop("N_tokens"), PATH)
    got = wfst.decode_documents(enc, PATH).collect()
    assert [(r.doc_id, r.decoded) for r in got] == [(d, {5: "a b"}.get(d, t or "")) for d, t in rows]
    assert [r.decoded_equal for r in got] == [True] * 5 + [False] and got[1].n_tokens == 0 and got[0].ids_crc32 == got[4].ids_crc32 and got[0]["a.b"] == 2
    assert wfst.encode_documents(df.limit(0), PATH).count() == 0

import math
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from chronoweave.llm import langid as L

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def all_cuts(s, p, unknown):
    """The sum over every segmentation, one by one."""
    if not s:
        return 1.0
    return sum((p.get(s[:k], 0) + (unknown if k == 1 else 0)) * all_cuts(s[k:], p, unknown) for k in range(1, len(s) + 1))


def test_forward_sums_all_segmentations():
    pieces = {x: i for i, x in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "aba"])}
    rng = np.random.default_rng(0)
    m = L.Model(["x", "y"], pieces, rng.random((len(pieces), 2)) / 5, np.array([0.01, 0.02]))
    words = ["a", "abab", "bbc", "ababa", "zz"]
    got = L.forward(m, words)
    for k, w in enumerate(words):
        for i in range(2):
            assert got[k, i] == pytest.approx(math.log(all_cuts("▁" + w, {q: m.weights[j, i] for q, j in pieces.items()}, m.unknown[i])))


def test_expected_counts():
    pieces = {x: i for i, x in enumerate(["▁", "a", "▁a", "aa"])}
    m = L.Model(["x"], pieces, np.full((4, 1), 0.2), np.array([1e-9]))
    m.expected, m.expected_unknown = np.zeros((4, 1)), np.zeros(1)
    L.forward(m, ["aa"], np.array([[3.0]]))
    # ▁|a|a .008, ▁|aa .04, ▁a|a .04
    total = 0.088
    assert m.expected[:, 0] == pytest.approx([3 * 0.048 / total, 3 * (0.016 + 0.04) / total, 3 * 0.04 / total, 3 * 0.04 / total], rel=1e-6)


def exact(word, p, unknown):
    """The logarithm of the sum over all segmentations, in whole fractions."""
    s, sums = "▁" + word, [Fraction(1)]
    p = {k: Fraction(float(v)) for k, v in p.items()}
    for e in range(1, len(s) + 1):
        sums.append(sums[-1] * Fraction(float(unknown)) + sum(sums[e - len(k)] * v for k, v in p.items() if s[:e].endswith(k)))
    z = sums[-1]
    return math.log(z.numerator) - math.log(z.denominator)


def test_words_of_any_length():
    """Long words, runs without spaces, and letters that are no piece: nothing is cut and nothing underflows."""
    pieces = {x: i for i, x in enumerate(["▁", "a", "b", "ab", "▁a", "漢", "漢字", "abababababababababababab", "▁b"])}
    rng = np.random.default_rng(1)
    m = L.Model(["x", "y"], pieces, rng.random((len(pieces), 2)) * 1e-4, np.array([1e-9, 1e-7]))
    words = ["z" * 33, "z" * 34, "z" * 40, "z" * 48, "z" * 49, "z" * 250, "ab" * 120, "漢字" * 150 + "字", "abz" * 20, "ab" * 30, "a"]
    got = L.forward(m, words)
    for k, w in enumerate(words):
        for i in range(2):
            assert got[k, i] == pytest.approx(exact(w, {q: m.weights[j, i] for q, j in pieces.items()}, m.unknown[i]), rel=1e-9)
    assert len({round(x, 3) for x in got[:6, 0]}) == 6
    m.expected, m.expected_unknown = np.zeros_like(m.weights), np.zeros(2)
    assert L.forward(m, words, np.ones((len(words), 2))) == pytest.approx(got)
    # the expected uses of a piece are the derivative of the logarithm by that of its weight
    for q, j in pieces.items():
        up = L.Model(m.languages, pieces, m.weights * np.where(np.arange(len(pieces)) == j, 1 + 1e-6, 1)[:, None], m.unknown)
        assert (L.forward(up, words) - got).sum(axis=0) / 1e-6 == pytest.approx(m.expected[j], rel=1e-3, abs=1e-3), q


def test_whole_vocabulary():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = [lib.id_to_piece(i).lower() for i in range(lib.get_piece_size())]
    assert {p for p in pieces if p.lstrip("▁").isalpha() and p.count("▁") <= 1} <= set(L.vocabulary(MODEL))


def test_many_languages(spark, monkeypatch):
    """Noise in the labels doesn't come to the driver: the languages with most documents are learnt."""
    monkeypatch.setattr(L, "FIT_LANGUAGES", 2)
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)] + [(100 + i, f"noise {i}", f"l{i}") for i in range(50)]
    m = L.fit_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"), MODEL)
    assert m.languages == ["de", "en"]


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    m = L.fit_documents(docs, MODEL)
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "12 !! ² ½", "en"), (-4, "Ünïcode 漢字 " * 3000, None)], "doc_id long, text string, lang string")
    rows = L.predict(docs.union(odd).selectExpr("*", "1 as `a.b`", "2 as LANG_PRED"), m, names=("lang_pred", "doc_score")).collect()
    by = {r.doc_id: r for r in rows}
    assert [by[k].lang_pred for k in (-1, -2, -3)] == ["und"] * 3 and by[-1].doc_score == 0 and by[-4].lang_pred in m.languages
    held = [r for r in rows if r.doc_id >= 0 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.doc_score <= 1 for r in rows)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    m = L.fit_documents(docs, MODEL)
    assert [r.lang_pred for r in L.predict(docs, m).collect()] == ["und", "und"]
    assert L.predict(docs.limit(0), m).count() == 0

import re
import zlib
from array import array
from collections import Counter

import corpus_pipeline as P
import public_tokenizers
import sentencepiece
from chronoweave.llm.langid import fit_documents

from .test_decontaminate import brute as brute_overlaps
from .test_jaccard_join import brute as brute_links


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    model = fit_documents(spark.read.parquet(f"{d}/documents.parquet"), MODEL)
    docs = [r for r, (lang, score) in zip(rows, model.scores([r.text for r in rows])) if lang != "und" and score >= P.LEAST_SCORE]
    pages, seen = Counter(r.source for r in docs), Counter()
    for r in docs:
        seen.update({(r.source, x.strip(" \t\r")) for x in r.text.split("\n") if x.strip(" \t\r")})
    texts = {}
    for r in docs:
        kept = [x for x in r.text.split("\n") if not (seen[r.source, x.strip(" \t\r")] >= 5 and seen[r.source, x.strip(" \t\r")] > 0.1 * pages[r.source])]
        if kept or not r.text:
            texts[r.doc_id] = "\n".join(kept)
    classes = brute_links(list(texts.items()))
    texts = {k: t for k, t in texts.items() if classes[k][0] == k}
    # only items that share four words in a row with a document can overlap it
    grams = {}
    for i, t in bench:
        w = re.findall(r"[^\W_]+", t.lower())
        for a in range(len(w) - 3):
            grams.setdefault(tuple(w[a : a + 4]), set()).add(i)
    leaks = set()
    for k, t in texts.items():
        w = re.findall(r"[^\W_]+", t.lower())
        near = Counter(i for a in range(len(w) - 3) for i in grams.get(tuple(w[a : a + 4]), ()))
        for i in [i for i, n in near.items() if n >= 5]:
            at = next(a for a in range(len(w) - 3) if i in grams.get(tuple(w[a : a + 4]), ()))
            cut = " ".join(w[max(0, at - 80) : at + 160])
            if brute_overlaps([(k, cut)], [(i, dict(bench)[i])]):
                leaks.add(k)
    want = {k: t for k, t in texts.items() if k not in leaks}
    got = {r.doc_id: r for r in P.run(spark, d).collect()}
    assert set(got) == set(want)
    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for k, t in want.items():
        ids = array("I", m.encode(t)).tobytes()
        assert bytes(got[k].ids) == ids and got[k].ids_crc32 == zlib.crc32(ids) and got[k].n_chars == len(t) and got[k].decoded_equal == ("▁" not in t)


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 30_000, "en", "s", 1), (None, "some words of text here", "en", "s", 9), (4, "some words of text here", "en", None, 9), (4, "some words of text here", "en", None, 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as lines_in", "'x' as ids", "2 as node")
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    for name, table in (("a", df), ("b", df.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = P.run(spark, f"{tmp_path}/a").collect()
    assert sorted((str(r.doc_id) for r in got)) == ["3", "4", "None"]
    assert P.run(spark, f"{tmp_path}/b").count() == 0

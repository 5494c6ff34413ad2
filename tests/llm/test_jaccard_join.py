import random
import re

import numpy as np

from chronoweave.llm import jaccard_join as jj


def brute(docs, t=0.8):
    sets = {}
    for d, x in docs:
        w = re.findall(r"[^\W_]+", (x or "").lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = {d: set() for d in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if n >= t * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                    links[a].add(b)
                    links[b].add(a)
    cls = {}
    for d in ids:
        if d not in cls:
            todo = [d]
            while todo:
                x = todo.pop()
                if x not in cls:
                    cls[x] = d
                    todo += links[x]
    return {d: (cls[d], len(links[d])) for d in ids}


def corpus(seed=1, groups=12, size=9):
    r = random.Random(seed)
    vocab = [f"word{i}" for i in range(3000)]
    docs, k = [], 0
    for g in range(groups):
        base = r.choices(vocab, k=r.choice([3, 6, 40, 300]))
        for _ in range(size):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(vocab)
            docs.append((k, " ".join(w).capitalize() + r.choice(["", ".", "!"])))
            k += 3
    r.shuffle(docs)
    return docs


def test_against_brute_force(spark, monkeypatch):
    docs = corpus() + [(1, None), (2, ""), (4, " ... "), (5, "one"), (7, "One!"), (8, "two words")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as node", "1 as links")
    want = brute(docs)
    got = {x.doc_id: (x.class_id, x.n_links) for x in jj.near_duplicates(df).collect()}
    assert got == want


def test_blocks_equal_whole(monkeypatch):
    docs = corpus(4, 6, 30)
    texts = [t for _, t in docs]
    runs, off = jj.shingles(*jj.word_hashes(texts), 5)
    sig = jj._signatures(runs, off, jj._A)[:, jj.BANDS * jj.ROWS :]
    rows = [(sig[k].tobytes(), t) for k, t in enumerate(texts)]

    def run(keyed):
        import pyarrow as pa

        keyed = sorted(keyed, key=lambda x: x[:3])
        b = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*keyed)], [str(i) for i in range(8)])
        n = {}
        for out in jj._link([b], 0.8):
            for node, links, _ in zip(*(c.to_pylist() for c in out.columns)):
                n[node] = n.get(node, 0) + links
        return n

    whole = run([(0, 0, 0, 0, k, 1, s, t) for k, (s, t) in enumerate(rows)])
    m, parts = 3, []
    for k, (s, t) in enumerate(rows):
        for o in range(m):
            i = k % m
            parts.append((0, min(i, o), max(i, o), int(i > o), k, 1, s, t))
    assert run(parts) == whole
    want = brute([(k, t) for k, t in enumerate(texts)])
    assert whole == {k: v[1] for k, v in want.items() if v[1]}


def test_chain_of_other_documents(spark):
    """50,000 texts that share a template, so that bands chain them all, and a few copies among them: clusters are cut to what survives."""
    r, n = random.Random(3), 50_000
    template = [f"t{k}" for k in range(40)]
    docs = [(k, " ".join(template + [f"u{k}x{j}" for j in range(26)])) for k in range(n)]
    for k in range(0, 300, 3):  # near copies, some of them of one another
        docs.append((n + k, docs[7 * (k // 9)][1] + f" end{k}"))
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = {x.doc_id: (x.class_id, x.n_links) for x in jj.near_duplicates(df).collect()}
    want = brute([(d, t) for d, t in docs if d >= n or d in {7 * (k // 9) for k in range(0, 300, 3)}])
    assert {d: got[d] for d in want} == want
    assert all(v == (d, 0) for d, v in got.items() if d not in want)


def test_cut_chains_by_hand(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 4)
    docs = corpus(9, 10, 12)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id: (x.class_id, x.n_links) for x in jj.near_duplicates(df).collect()} == brute(docs)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, None, "z")], "doc_id long, text string, q string")
    df = df.selectExpr("doc_id", "text", "q", "1 as __keep", "2 as `a.b`", "3 as keep", "4 as n", "5 as c0")
    out = jj.keep_first_of_class(df)
    assert out.columns == df.columns and sorted(r.q for r in out.collect()) == ["x", "z"]


def test_pruning_keeps_what_can_reach():
    assert [jj.least_matches(n) for n in (8, 16, 64)] == sorted(jj.least_matches(n) for n in (8, 16, 64))
    assert jj.least_matches(64) < 40


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    docs = [(1, long), (2, long + " tail"), (3, "a b c d e f"), (3, "a b c d e g"), (None, "a b c d e f"), (4, "a b c d e g"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(jj.near_duplicates(df).collect(), key=str)
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 3, 1), (None, None, 0)} and len(got) == 6
    kept = sorted(((r.doc_id, r.text) for r in jj.keep_first_of_class(df).collect()), key=str)
    assert [k[0] for k in kept] == [1, 3, None, None] and kept[1][1] == "a b c d e g"
    assert jj.near_duplicates(df.limit(0)).count() == 0


def test_roots():
    assert jj._roots(6, np.array([5, 4, 1]), np.array([4, 3, 0])).tolist() == [0, 0, 2, 3, 3, 3]

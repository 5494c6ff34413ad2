import random

from chronoweave.llm import decontaminate
from chronoweave.llm.decontaminate import MASKS, contamination, drop_contaminated


def brute(docs, items, cover=0.5, least=8, run=13):
    """Every document over every item at every place, by hand: places with a seed in common, and the run of highest score there."""
    import re

    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, t in docs:
        w = cut(t)
        for i, x in items:
            v, best = cut(x), 0
            masks = [*MASKS, *(["1" * len(v)] if len(v) < max(map(len, MASKS)) else [])]
            for g in range(-len(v), len(w)):
                same = [w[g + k] == v[k] for k in range(len(v)) if 0 <= g + k < len(w)]
                if not any(all(same[a + k] for k, c in enumerate(m) if c == "1") for m in masks for a in range(len(same) - len(m) + 1)):
                    continue
                top, n, row, longest = 0, 0, 0, 0
                for a in range(len(same)):
                    s = 0
                    for z in range(a, len(same)):
                        s += 1 if same[z] else -1
                        if s > top:
                            top, n = s, sum(same[a : z + 1])
                for x_ in same:
                    row = row + 1 if x_ else 0
                    longest = max(longest, row)
                if (n >= min(least, len(v)) and n >= cover * len(v)) or longest >= run:
                    best = max(best, n)
            if v and best:
                out[d, i] = best
    return out


def test_planted(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(4000)]
    item = [" ".join(r.choices(vocab, k=n)) for n in (15, 20, 40, 59)]
    items = [(i, t) for i, t in enumerate(item)] + [(9, "tiny test item"), (10, None), (11, "")]
    docs, want = [], set()
    for d in range(60):
        body = r.choices(vocab, k=r.choice([0, 5, 200]))
        if d % 3 == 0:
            k = d // 3 % 4
            w = item[k].split()
            if d % 2:
                for j in range(5, len(w), 6):  # every sixth word replaced
                    w[j] = "other"
            body[len(body) // 2 : len(body) // 2] = w
            want.add((d, k))
        if d == 7:
            body += "Tiny, TEST item".split()
            want.add((d, 9))
        if d == 8:
            body += item[2].split()[:10]  # a quarter of an item
        docs.append((d, " ".join(body).upper() if d % 5 == 0 else " ".join(body)))
    docs += [(100, None), (101, ""), (102, "tiny"), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as item_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination(df, bench).collect()
    assert {(x.doc_id, x.item_id) for x in rows} == want
    assert len(rows) == len(want) + 1
    kept = {x.doc_id for x in drop_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert contamination(df.limit(0), bench).count() == 0 and drop_contaminated(df, bench.limit(0)).count() == len(docs)


def test_against_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(9, 20)))) for i in range(12)]
    docs = []
    for d in range(40):
        w = r.choices(vocab, k=30)
        v = r.choice(items)[1].split()
        for j in range(len(v)):
            if r.random() < 0.12:
                v[j] = r.choice(vocab)
        docs.append((d, " ".join(w[:10] + v[: r.randint(5, len(v))] + w[10:])))
    got = {(x.doc_id, x.item_id) for x in contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == set(brute(docs, items))


def test_long_items_and_hot_seeds(spark, monkeypatch):
    """Items as long as documents, seeds that all items share and slices of a few cells: nothing is lost, and memory is bounded by CELLS and HITS."""
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    long = r.choices(vocab, k=20_000)
    phrase = "the answer to this question is one of these".split()
    items = [(0, " ".join(long))] + [(k, " ".join(phrase + r.choices(vocab, k=12))) for k in range(1, 400)]
    docs = [(0, " ".join(long[5000:17_000])), (1, " ".join(long[100:112])), (2, " ".join(long[100:113])), (3, " ".join(phrase * 300)), (4, items[7][1]), (5, " ".join(phrase[:8]))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(0, 0): (12_000, 0, 5000), (2, 0): (13, 0, 100), (4, 7): (21, 0, 0)}
    assert {(x.doc_id, x.item_id): (x.matches, x.doc_start, x.item_start) for x in contamination(df, bench).collect()} == want
    index = decontaminate.Index(items)
    whole = [x.tolist() for x in index.overlaps([t for _, t in docs])]
    monkeypatch.setattr(decontaminate, "HITS", 1000)
    monkeypatch.setattr(decontaminate, "CELLS", 5000)
    assert [x.tolist() for x in index.overlaps([t for _, t in docs])] == whole


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None)], "doc_id long, text string").selectExpr("*", "1 as `a.b`", "2 as d", "3 as c0")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    out = drop_contaminated(df, bench)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [2]

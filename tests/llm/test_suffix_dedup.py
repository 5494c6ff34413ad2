import hashlib
import random

import numpy as np
import pytest

from chronoweave.llm import suffix_dedup as S


def brute(docs, w=100):
    """docs: texts in order. Every window by hand."""
    seen, out = set(), []
    for t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - w + 1):
            x = raw[i : i + w]
            if x in seen:
                gone[i : i + w] = True
            seen.add(x)
        n = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), int(gone.sum()), n, hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé ", k=r.randint(2, 8)))
    passage = [" ".join(word() for _ in range(n)) for n in (10, 17, 30, 80)]
    docs = []
    for d in range(90):
        t = " ".join(word() for _ in range(r.choice([0, 5, 60, 200])))
        for _ in range(r.choice([0, 1, 1, 3])):
            p, i = r.choice(passage), r.randrange(len(t) + 1)
            t = t[:i] + p[r.choice([0, 0, 3]) : r.choice([len(p), len(p) - 5])] + t[i:]
        docs.append(t)
    docs += [docs[3], docs[3], "x" * 250, "ab" * 100, "x" * 101, "x" * 100, "x" * 99, None, "", "é" * 50 + "y" + "é" * 50, "\0" * 150, ("q" * 81 + "z") * 4, docs[5] + docs[5]]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    docs = corpus(seed)
    if seed == 2:
        monkeypatch.setattr(S, "BLOCK_BYTES", 300)  # keys of many bytes go in blocks
    df = spark.createDataFrame([(10 * k, t) for k, t in enumerate(docs)], "doc_id long, text string").selectExpr("*", "1 as doc", "2 as start").repartition(7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df).collect()}
    want = brute(docs)
    assert [got[10 * k] for k in range(len(docs))] == want and len(got) == len(docs)


def test_every_period(spark):
    """Texts of every period from 1 to 220, and pages of 80-column lines of which some repeat."""
    r = random.Random(5)
    docs = []
    for period in range(1, 221):
        line = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=period - 1)) + "\n"
        docs.append((line * (2 + 400 // period))[: r.randint(2 * period, 3 * period + 150)])
    line = lambda: "".join(r.choices("abcdefgh ", k=80))
    same = line()
    docs += ["\n".join([same] * 6), "\n".join([line(), same, same, line(), same, same, same]), "\n".join([line() for _ in range(9)] + [same]), ("q" * 80 + "z") * 4]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in S.remove_repeats(df).collect()}
    assert [got[k] for k in range(len(docs))] == brute(docs)


@pytest.mark.parametrize("copies", [1, 3])
def test_periods_about_the_span(spark, copies):
    """A window repeats in its own run up to a period of 81; alone, and in equal segments of several documents."""
    r = random.Random(11)
    docs = []
    for period in (80, 81, 82):
        for size in (99 + period, 100 + period, 181, 3 * period, 4 * period + 7):
            line = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=period - 1)) + "\n"
            docs += [(line * 5)[:size]] * copies
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in S.remove_repeats(df).collect()}
    assert [got[k] for k in range(len(docs))] == brute(docs)


def test_merge_equals_all_pairs():
    r = random.Random(7)
    parts = list({bytes(r.choices(b"ab\0", k=r.randint(12, 40))) for _ in range(60)})
    for shards in (1, 3, 60):
        s, at, block = S.merge_shards(parts, 12, shards)
        got = {}
        for x, y, b in zip(s.tolist(), at.tolist(), block.tolist()):
            got.setdefault(b, set()).add((x, y))
        want = {}
        for x, p in enumerate(parts):
            for y in range(len(p) - 11):
                want.setdefault(p[y : y + 12], set()).add((x, y))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_suffix_array():
    text = b"banana\0bandana\0"  # two circular strings
    ahead = np.concatenate([(np.arange(7) + 1) % 7, (np.arange(8) + 1) % 8 + 7])
    order = S.suffix_order(np.frombuffer(text, np.uint8), ahead, 1, 16)
    turn = lambda i: (text[i:7] + text[:i]) if i < 7 else (text[i:] + text[7:i])
    assert [turn(i) * 3 for i in order] == sorted(turn(i) * 3 for i in range(len(text)))


def test_equal_ids(spark):
    t = "the same long text " * 8
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t + "!"), (1, "z" + t)], "doc_id long, text string")
    got = sorted(((r.doc_id is not None, r.doc_id, r.n_removed) for r in S.remove_repeats(df).collect()), key=str)
    order = [t, t, t, "z" + t, t + "!"]  # null first, then 1 by text, then 2
    want = [w[1] for w in brute(order)]
    assert got == sorted(zip([False, True, True, True, True], [None, 1, 1, 1, 2], want), key=str)
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_kept_text(spark):
    df = spark.createDataFrame([(1, "a" * 120 + "end"), (2, "no repeats here")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in S.remove_repeats(df, with_text=True).collect()}
    assert got == {1: b"aend", 2: b"no repeats here"}

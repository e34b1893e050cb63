import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trellis.llm import fuzzy, golay, history, shingles
from trellis.session import shuffled


def test_golay_lists_meet():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    codes, there = golay.near_codewords(words)
    assert set(there.sum(axis=1)) <= {1, 6}
    for flips in (1, 2):
        other = words.copy()
        for i in range(len(words)):
            for b in rng.choice(23, flips, replace=False):
                other[i] ^= 1 << int(b)
        c2, t2 = golay.near_codewords(other)
        assert all(set(a[x]) & set(b[y]) for a, x, b, y in zip(codes, there, c2, t2))


def test_measure():
    assert shingles.similarity("abcde", "abcdf") == pytest.approx(1 / 3)
    assert shingles.similarity("abc", "abc") == 0.0 and shingles.similarity(None, "abcd") == 0.0
    assert shingles.similarity("abcd", "abcd") == 1.0


def _texts(n, seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4))) for _ in range(300)]
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.5:
            w = rnd.choice(out).split()
            for _ in range(rnd.randint(0, 3)):
                i = rnd.randrange(len(w))
                w[i : i + 1] = rnd.choice([[], [rnd.choice(vocabulary)], [w[i], rnd.choice(vocabulary)], [w[i][::-1]]])
            out.append(" ".join(w))
        else:
            out.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(10, 30))))
    return out


def _norm(t):
    import regex

    return regex.sub(r"[^\p{L}\p{N}]+", " ", t.lower()).strip()


def test_pairs_equal_brute_force(spark):
    texts = _texts(260, 4)
    rows = [("t", i, t) for i, t in enumerate(texts)] + [("t", 0, texts[0]), ("t", 900, None), ("t", 901, "  "), ("t", 902, "ab"), ("t", 903, "ab"), ("t", 904, texts[5].upper() + "!"), ("u", 1, texts[0]), (None, None, "x")]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "rec_table string, id bigint, text string, class_id int")
    known = {(a, b): _norm(c) for a, b, c in rows if c and b is not None}
    want = {(a[0], a[1], b[1]) for a, b in combinations(sorted(known, key=str), 2) if a[0] == b[0] and shingles.similarity(known[a], known[b]) >= 0.7}
    want = {(t, min(i, j), max(i, j)) for t, i, j in want}
    got = [tuple(r) for r in fuzzy.alike_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.99 * len(want) and len(want) > 50
    links = fuzzy.alike_report(df.filter("rec_table = 'u'")).collect()
    assert [(r["id"], r["links"]) for r in links] == [(1, 0)]


def test_empty(spark):
    df = spark.createDataFrame([], "rec_table string, id bigint, text string")
    assert fuzzy.alike_pairs(df).count() == 0


def _greedy(rows):
    """Batch 0 is accepted; then in order."""
    accepted, cases = {}, {}
    for batch, cid, t in sorted({(b, c, t) for b, c, t in rows if t is not None and c is not None}):
        n = _norm(t)
        hit = [a for a, m in accepted.items() if shingles.similarity(m, n) >= 0.7]
        if batch and hit:
            cases[cid] = min(hit)
        else:
            accepted[cid] = n
    return cases


def test_batches_equal_greedy_and_stepwise(spark):
    texts = _texts(240, 9)
    rows = [(0 if i < 90 else 1 + (i - 90) // 50, i, t) for i, t in enumerate(texts)] + [(1, 95, texts[95]), (2, 500, None), (2, 501, "ab")]
    df = spark.createDataFrame([(b, c, t, "x") for b, c, t in rows], "batch_no int, chunk_id bigint, text string, block string")
    want = _greedy(rows)
    store = history.new_store(spark)
    history.begin(store, df.filter("batch_no = 0"))
    got = {r["chunk_id"]: r["reused_id"] for r in history.dedup_batches(store, df.filter("batch_no > 0")).collect()}
    store.close()
    same = sum(got.get(k) == v for k, v in want.items())
    assert same >= 0.98 * len(want) > 20 and len(set(got) - set(want)) <= 1
    # one batch at a time gives the same, also if the store is opened anew for each
    step, first = {}, history.new_store(spark)
    history.begin(first, df.filter("batch_no = 0"))
    for b in (1, 2, 3):
        again = history.BlockStore(spark, first.root)
        step |= {r["chunk_id"]: r["reused_id"] for r in history.dedup_batches(again, df.filter(F.col("batch_no") == b)).collect()}
    assert step == got
    # the tables of history are not shuffled: the only exchange is that of the batch
    plan = shuffled(history.block_tables(spark.createDataFrame([(1, "some text")], history.TEXTS)), first.tables(), "block")._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin") :].split("FileScan")[0]
    assert side.count("Exchange hashpartitioning") == 1


def test_rotation_follows_the_block():
    """Equal texts agree in all tables; a table's bits are those that come after its block."""
    pdf = pd.DataFrame({"class_id": [1, 2], "norm": ["the quick survey of nodes"] * 2})
    got = next(history._rotations(iter([pdf])))
    one, two = got.iloc[: history.BLOCKS], got.iloc[history.BLOCKS :]
    assert (one[["block", "f0", "f1"]].to_numpy() == two[["block", "f0", "f1"]].to_numpy()).all() and one["block"].nunique() == history.BLOCKS
    assert list(history._rotations(iter([pd.DataFrame({"class_id": [1], "norm": ["ab"]})]))) == []


def test_layout_recall():
    """Pairs at the threshold share a Golay key of a segment, minhash values being independent."""
    rng, n = np.random.default_rng(5), 4000
    layout, weights = fuzzy._layout(), 1 << np.arange(golay.N)
    equal = rng.random((n, fuzzy.POOL)) < fuzzy.SIMILARITY
    bits = rng.integers(0, 2, (n, fuzzy.POOL))
    other = np.where(equal, bits, rng.integers(0, 2, (n, fuzzy.POOL)))
    found = np.zeros(n, bool)
    for s in range(fuzzy.SEGMENTS):
        stem = equal[:, fuzzy.STEM * s : fuzzy.STEM * s + fuzzy.STEM].all(axis=1)
        (a, x), (b, y) = (golay.near_codewords((v[:, layout[s]] * weights).sum(axis=1)) for v in (bits, other))
        found |= stem & ((a[:, :, None] == b[:, None, :]) & x[:, :, None] & y[:, None, :]).any(axis=(1, 2))
    assert found.mean() >= 0.997


def test_hot_keys_lose_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), i, int(f), int(g)) for i, (k, f, g) in enumerate(zip([7] * 300 + [8] * 40 + list(range(20, 60)), rng.integers(-(2**62), 2**62, 380), rng.integers(-(2**62), 2**62, 380)))]
    rows += [(9, 500 + i, 5, 5 ^ (1 << i)) for i in range(30)] + [(7, 900, rows[3][2], rows[3][3] ^ 1)]
    df = spark.createDataFrame(rows, "key bigint, n bigint, f0 bigint, f1 bigint")
    got = {lim: {tuple(r) for r in fuzzy.near_pairs(df, lim).collect()} for lim in (10, 1000)}
    assert got[10] == got[1000] and (3, 900) in got[10] and len(got[10]) >= 30 * 29 // 2
    want = {(a[1], b[1]) for a, b in combinations(sorted(rows, key=lambda r: r[1]), 2) if a[0] == b[0] and ((a[2] ^ b[2]) & (2**64 - 1)).bit_count() + ((a[3] ^ b[3]) & (2**64 - 1)).bit_count() <= fuzzy.MAX_BITS}
    assert got[10] == want


def test_no_join_is_broadcast(spark):
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(_texts(30, 2))], "rec_table string, id bigint, text string")
    got = fuzzy.alike_pairs(df)
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_no_history(spark):
    df = spark.createDataFrame([(1, 1, "some words that stand here"), (1, 2, "some words that stand here")], "batch_no int, chunk_id bigint, text string")
    store = history.new_store(spark)
    history.begin(store, df.limit(0))
    assert [tuple(r) for r in history.dedup_batches(store, df).collect()] == [(1, 2)]


def test_settle_chain(spark):
    e = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 4)], "class_id bigint, other_id bigint")
    assert {r["class_id"]: r["accepted"] for r in history.settle(e).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}

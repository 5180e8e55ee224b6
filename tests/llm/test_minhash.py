import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from changeloom.llm import minhash
from changeloom.llm.shingles import shingle_set, word_hashes


def words_of(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))


def brute_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets = {k: brute_set(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    for a, s in sets.items():
        for b in {k for x in s for k in holders[x] if k > a}:
            both = len(s & sets[b])
            if 100 * both >= 75 * (len(s) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in texts}


def near_family(seed, families=12, copies=9, words=60):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(4000)]
    texts, n = {}, 0
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for c in range(copies):
            own = list(base)
            for _ in range(c % 4):
                own[rng.randrange(words)] = rng.choice(vocabulary)
            texts[n] = " ".join(own) if c % 2 else "\n".join(own).lower()
            n += 1
    return texts


@given(st.lists(st.text(alphabet="aBé \n\t", max_size=40), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_shingles(texts):
    for t in texts:
        assert len(shingle_set(t.encode())) == len(brute_set(t))
        assert len(word_hashes(t.encode())) == len(words_of(t))
    for a in texts:
        for b in texts:
            same = len(np.intersect1d(shingle_set(a.encode()), shingle_set(b.encode())))
            assert same == len(brute_set(a) & brute_set(b))


def test_long_text_in_chunks(monkeypatch):
    from changeloom.llm import shingles

    text = " ".join(f"word{i % 97}" + "x" * (i % 50) for i in range(4000)).encode()
    whole = word_hashes(text)
    monkeypatch.setattr(shingles, "CHUNK", 512)
    assert (word_hashes(text) == whole).all()


def test_pairs_within_the_guarantee_share_a_key():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 16, minhash.VALUES).astype(np.uint16)
    for _ in range(200):
        b = a.copy()
        b[rng.choice(minhash.VALUES, minhash.GUARANTEED, replace=False)] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], ["node", "sign"])
        out = next(minhash._keys([batch]))
        keys = out.column(0).to_numpy().reshape(2, -1)
        assert set(keys[0].tolist()) & set(keys[1].tolist())


def test_linked_is_a_spanning_forest():
    texts = near_family(3)
    sets = [shingle_set(t.encode()) for t in texts.values()]
    want = brute_components(texts)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in minhash.linked(sets):
        x, y = sorted((root(a), root(b)))
        assert x != y
        parent[y] = x
    assert [root(i) for i in range(len(sets))] == list(want.values())


def check(spark, texts, **options):
    rows = [(k, t, f"s{k % 3}") for k, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(5)
    got = {r.doc_id: r for r in minhash.near_copies(df, **options).collect()}
    want = brute_components(texts)
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.n_shingles == len(brute_set(texts[k])) and r.kept == (k == r.component_id) for k, r in got.items())
    kept = minhash.drop_near_copies(df, **options)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_edge_cases(spark):
    texts = near_family(7, families=5, copies=6)
    texts |= {1000: None, 1001: "", 1002: " \t\n", 1003: "one two", 1004: "One  TWO", 1005: "one", 1006: "long " * 30_000 + "end"}
    check(spark, texts)


def test_small_blocks_and_buckets_lose_nothing(spark):
    check(spark, near_family(9, families=4, copies=24, words=50), bucket=3, block=5)


def test_classes_outside_the_largest_component(spark):
    """Half of each text is common: one clump of many classes, most of them without links, in many batches."""
    rng = random.Random(21)
    common = " ".join(f"c{i}" for i in range(60))
    texts = {n: common + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(25)) for n in range(40)}
    texts |= {100 + n: texts[n % 4] + f" more{n}" for n in range(30)}
    check(spark, texts, bucket=2, block=4)


def test_components_with_a_hub(spark):
    from changeloom.llm.common import Scratch
    from changeloom.llm.components import components

    edges = [(0, i) for i in range(1, 3000)] + [(5, 5), (9, 0), (4000, 4001), (4002, 4001), (None, 3), (7, None)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in components(df, Scratch(spark, "test"), "hub").collect()}
    assert got == dict.fromkeys(range(3000), 0) | {4000: 4000, 4001: 4000, 4002: 4000}
    assert components(df.limit(0), Scratch(spark, "test"), "none").count() == 0


def test_empty_null_and_repeated(spark):
    schema = "doc_id long, text string"
    empty = spark.createDataFrame([], schema)
    assert minhash.near_copies(empty).count() == 0 and minhash.drop_near_copies(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "x"), (2, None)], schema)
    rows = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_copies(df).collect())
    assert rows == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "1", False), ("None", "None", True)]


def test_rows_that_share_an_id_or_have_none_go_by_their_text(spark):
    own = lambda n: " ".join(f"w{n}x{k}" for k in range(80))
    near = lambda n: own(n) + " more"
    rows = [(3, own(1)), (7, near(1)), (7, own(2)), (8, near(2)), (None, near(2) + " again"), (None, own(3)), (9, own(4)), (9, own(4)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = minhash.drop_near_copies(df)
    assert kept.columns == df.columns
    want = [(3, own(1)), (7, own(2)), (None, own(3)), (9, own(4)), (9, own(4)), (None, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from test_queries import removed_by_brute_force

from changeloom.llm import suffix_dedup as sd


@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 for x in b)), max_size=80))
@settings(max_examples=60, deadline=None)
def test_multikey_quicksort(strings):
    strings = strings * 2 + [b"\x01" * 40 + s for s in strings]
    order = sd.multikey_quicksort(strings)
    assert sorted(order.tolist()) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)


def test_every_window_holds_an_anchor_chosen_by_its_content():
    rng = np.random.default_rng(1)
    for letters in (1, 2, 40):
        shared = rng.integers(0, letters, 900).astype(np.uint8)
        found = []
        for n in (0, 321, 57):
            data = np.concatenate([rng.integers(0, letters, n).astype(np.uint8), shared])
            places = sd.anchors(data)
            gaps = np.diff(np.concatenate([[-1], places]))
            assert gaps.max() <= sd.WINDOW
            found.append({p - n for p in places.tolist()})
        inner = [{p for p in x if p >= sd.WINDOW} for x in found]
        for x in inner:  # away from the border all three choose alike
            assert {p for p in x if p < 600} == {p for p in inner[0] if p < 600}


def test_anchors_in_chunks(monkeypatch):
    data = np.random.default_rng(2).integers(0, 5, 20_000).astype(np.uint8)
    whole = sd.anchors(data)
    monkeypatch.setattr(sd, "CHUNK", 1000)
    assert (sd.anchors(data) == whole).all()


def planted(seed, n=60):
    """Texts that share passages of 300 to 900 bytes, with near misses and runs."""
    rng = random.Random(seed)
    prose = lambda k: "".join(rng.choice("abcdefgh é\n") for _ in range(k))
    passages = [prose(k) for k in (300, 390, 395, 399, 400, 401, 450, 600, 900)]
    texts = []
    for _ in range(n):
        parts = [prose(rng.randrange(0, 500))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            if rng.random() < 0.3:
                p = p[rng.randrange(0, 60) :]
            if rng.random() < 0.3:
                at = rng.randrange(len(p))
                p = p[:at] + "#" + p[at + 1 :]
            parts += [p, prose(rng.randrange(0, 300))]
        texts.append("".join(parts))
    return [*texts, texts[3], "ab" * 700, "q" * 1500, passages[4], "", None]


def check(spark, texts, **options):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place string").repartition(6)
    raw = [(t or "").encode() for t in texts]
    got = {r.id: r for r in sd.repeated_spans(df, **options).collect()}
    for i, want in enumerate(removed_by_brute_force(raw)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) == want, i
        assert sum(s["to"] - s["from"] for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed


def test_against_brute_force(spark):
    check(spark, planted(1))


def test_large_groups_are_counted_by_string(spark):
    check(spark, planted(2), group=3)


def test_small_buckets_and_copies(spark, monkeypatch):
    """Buckets of a few suffixes, and groups of copies of which one holds a third of the rows."""
    texts = planted(5, 40)
    check(spark, [*texts, *[texts[7] + texts[8]] * 25, texts[7][:500], texts[0] + "end"])
    rows = [(s[:400], s[400:500][::-1]) for s in (t.encode() for t in texts if t and len(t) > 600)] * 2
    import pyarrow as pa

    order = sorted(range(len(rows)), key=lambda i: rows[i][0][: sd.SHARED])
    batch = pa.RecordBatch.from_arrays([pa.array([bytes([i]) for i in order], pa.binary()), pa.array([rows[i][0] for i in order], pa.binary()), pa.array([rows[i][1] for i in order], pa.binary())], ["context", "suffix", "prefix"])
    want = {k: v for b in sd._matched([batch]) for k, *v in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    monkeypatch.setattr(sd, "BUCKET", 2)
    parts = list(sd._matched([batch]))
    got = {k: v for b in parts for k, *v in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert got == want and len(parts) > 10 and len(want) == len(rows)
    with __import__("pytest").raises(ValueError):
        list(sd._matched([batch.take(pa.array([0, len(rows) - 1] * 3))]))


def test_clashing_columns(spark):
    text = "".join(random.Random(8).choice("abcdefgh") for _ in range(900))
    rows = [(1, text, "n", "p", "s", 1), (2, "x" + text, "n", "p", "s", 2), (3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, name string, packed string, spans string, id long")
    got = {r.id: r.n_removed for r in sd.repeated_spans(df).collect()}
    assert got == {1: 900, 2: 900, 3: 0}


def test_open_anchors_compare_with_their_group():
    """Partners that are neighbours in neither order."""
    rng = random.Random(4)
    letters = "abcd"
    texts = []
    core = "".join(rng.choice(letters) for _ in range(260))
    befores = ["".join(rng.choice(letters) for _ in range(300)) for _ in range(6)]
    afters = ["".join(rng.choice(letters) for _ in range(300)) for _ in range(6)]
    for _ in range(40):
        b, a = rng.choice(befores), rng.choice(afters)
        texts.append(("".join(rng.choice(letters) for _ in range(9)) + b[rng.randrange(300) :] + core + a[: rng.randrange(300)] + rng.choice(letters) * 9).encode())
    joined = [t for t in texts if len(t) >= sd.LENGTH]
    contexts = {}
    for t in joined:
        for p in sd.anchors(np.frombuffer(t, np.uint8)).tolist():
            key = (t[p : p + sd.LENGTH], t[max(0, p - sd.WINDOW + 1) : p][::-1])
            contexts[key] = contexts.get(key, 0) + 1
    keys = list(contexts)
    a, b = sd.reaches([k[0] for k in keys], [k[1] for k in keys], [contexts[k] for k in keys])

    def agree(x, y):
        n = 0
        for p, q in zip(x, y, strict=False):
            if p != q:
                break
            n += 1
        return n

    for i, (s, p) in enumerate(keys):
        best = [0, 0]
        for j, (s2, p2) in enumerate(keys):
            if j != i or contexts[keys[i]] > 1:
                r, m = agree(s, s2), agree(p, p2)
                if r >= sd.SHARED and r + m >= sd.LENGTH:
                    best = [max(best[0], m), max(best[1], r)]
        assert [a[i], b[i]] == best


def test_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert sd.repeated_spans(spark.createDataFrame([], schema)).count() == 0
    text = "".join(random.Random(3).choice("abcdefgh") for _ in range(700))
    rows = sd.repeated_spans(spark.createDataFrame([(1, text), (1, text), (None, "short")], schema)).collect()
    assert sorted((str(r.id), r.n_removed) for r in rows) == [("1", 700), ("1", 700), ("None", 0)]

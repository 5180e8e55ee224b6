"""The registered queries against DuckDB SQL, or brute force where SQL has no answer."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import oracle
import pyarrow.parquet as pq
import pytest

from changeloom.llm import queries, sql
from changeloom.llm.tokens import default_vocabulary

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_sql(spark, name):
    assert oracle.difference(spark, SMALL, queries.queries()[name], sql.oracle_sql()[name]) == ""


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def documents(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


def check_packing(rows, documents, tokenizer, most=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(documents)
    for key, text in documents.items():
        ids, at = ids_of(tokenizer, text), 0
        for n, r in enumerate(sorted(by_doc[key], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == most or (n == 0 and 0 < r.length <= most)
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.03 * -(-total // most) + 1


def test_packing(spark, tokenizer):
    check_packing(queries.op2_best_fit_packing(spark, SMALL).collect(), documents(SMALL), tokenizer)


def test_token_store(spark, tokenizer):
    rows = {r.doc_id: r for r in queries.op8_token_orc(spark, SMALL).collect()}
    at = 0
    for key, text in sorted(documents(SMALL).items()):
        ids = ids_of(tokenizer, text)
        assert (rows[key].start, rows[key].n_tokens, rows[key].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(rows) == len(documents(SMALL))


def removed_by_brute_force(texts, length=400):
    seen = Counter(hash(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cut = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] > 1:
                cut[i] += 1
                cut[i + length] -= 1
        gone = np.cumsum(cut)[:-1] > 0
        spans = int(np.sum(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
        rest = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def test_repeated_strings(spark):
    docs = documents(MEDIUM)
    want = dict(zip(docs, removed_by_brute_force([(t or "").encode() for t in docs.values()]), strict=True))
    rows = queries.op7_suffix_dedup(spark, MEDIUM).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == want
    assert sum(1 for x in want.values() if x[1]) > 50


def test_pipeline_edge_cases(spark, tokenizer):
    """Nulls in any column, ties, repeated rows, long texts, clashing columns; and an empty table."""
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars int, _digest string, tag string, sequence int, n long"
    prose = lambda i: " ".join(f"w{i}x{k}" for k in range(80))
    more = ("d", "t", 1, 2)
    rows = [(i, prose(i), "en", "a", 0, *more) for i in range(12)]
    rows += [(20, prose(3), None, None, None, *[None] * 4), (3, prose(3), "en", "a", 0, *more), (None, prose(40), "en", "b", 1, *more), (21, None, "en", "b", 0, *more), (22, "", None, "b", 0, *more)]
    rows += [(23, prose(5) + " one more", "en", "a", 0, *more), (24, " ".join(prose(k) for k in range(100, 700)), "en", "b", 0, *more)]
    docs = spark.createDataFrame(rows, schema)
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), schema)
        if name == "quality_rules":
            assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted([*range(12), 3, 20, 23, 24])
        if name == "exact_dedup":
            assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, range(12)), "23", "24", "None"])
        if name == "near_dedup":
            assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, range(12)), "24", "None"])
    packed = cp.best_fit_packing(spark, kept, SMALL).collect()
    assert sum(r.length for r in packed) == sum(len(ids_of(tokenizer, r.text)) for r in kept.collect())
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SMALL)
        assert empty.count() == 0
        empty = spark.createDataFrame([], empty.schema)


def test_pipeline(spark, tokenizer):
    """Stage by stage against what each stage was given."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mixing", "best_fit_packing"]
    good = cp.quality_rules(spark, docs, SMALL)
    want = {r[0] for r in oracle.tables(SMALL).execute(f"select doc_id from ({sql.OP4}) where kept").fetchall()}
    good_rows = good.collect()
    assert {r.doc_id for r in good_rows} == want and len(good_rows) == len(want)
    unique = cp.exact_dedup(spark, good, SMALL).collect()
    firsts = {}
    for r in good_rows:
        key = " ".join(re.split(r"[\x20\x09-\x0D]+", r.text))
        firsts[key] = min(firsts.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in unique) == sorted(firsts.values())
    unique_df = spark.createDataFrame(unique, docs.schema)
    near = cp.near_dedup(spark, unique_df, SMALL)
    near_rows = near.collect()
    from test_minhash import brute_components

    comp = brute_components({r.doc_id: r.text for r in unique})
    assert sorted(r.doc_id for r in near_rows) == sorted(set(comp.values()))
    near_df = spark.createDataFrame(near_rows, docs.schema)
    mix = cp.source_mixing(spark, near_df, SMALL)
    mix_rows = mix.collect()
    for frame in (good, near, mix):
        assert frame.columns == columns
    words = lambda t: len((t or "").split())
    size = {r.doc_id: words(r.text) for r in near_rows}
    taken = Counter()
    for r in mix_rows:
        taken[r.doc_id] += words(r.text)
        assert r.n_chars == len(r.text)
    assert all(taken[k] <= 3 * size[k] for k in size)
    total = sum(taken.values())
    assert abs(total - sum(size.values())) <= 16 * 20 + 0.02 * sum(size.values())
    packed = cp.best_fit_packing(spark, spark.createDataFrame(mix_rows, docs.schema), SMALL).collect()
    assert sum(r.length for r in packed) == sum(len(ids_of(tokenizer, r.text)) for r in mix_rows)
    assert cp.run(spark, SMALL).count() == len(packed)

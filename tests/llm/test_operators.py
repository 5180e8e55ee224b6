"""Edge cases and methods of the other corpus operators."""

import gzip
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changeloom.llm import chat, exact_dedup, line_dedup, mixing, packing, quality, token_store, warc
from changeloom.llm.common import Scratch
from changeloom.llm.tokens import default_vocabulary, encoder

DOCS = "doc_id long, text string, source string, _digest string, n_lines string"


# exact copies


def test_exact_copies(spark):
    rows = [
        (5, "a  b", "x"), (3, "a\tb", "x"), (9, None, None), (8, "", "y"), (7, "a b ", "x"), (3, "a b", "x"), (None, "a b", "z"), (None, "q", "z"),
    ]
    df = spark.createDataFrame([(*r, "d", "n") for r in rows], DOCS)
    for counters in (1, 3, 1024):
        got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_copies(df, counters=counters).collect())
        assert got == sorted([
            ("5", "3", 4, False), ("3", "3", 4, True), ("3", "3", 4, False), ("None", "3", 4, False),
            ("9", "8", 2, False), ("8", "8", 2, True), ("7", "7", 1, True), ("None", "None", 1, True),
        ])
        kept = exact_dedup.drop_exact_copies(df, counters=counters)
        assert kept.columns == df.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "8", "None"]
    assert exact_dedup.exact_copies(df.limit(0)).count() == 0


def test_misra_gries_finds_every_heavy_digest():
    import pyarrow as pa

    rng = random.Random(2)
    values = [b"hot"] * 400 + [b"warm"] * 200 + [bytes([rng.randrange(256), rng.randrange(256)]) for _ in range(600)]
    rng.shuffle(values)
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i : i + 50], pa.binary())], ["digest"]) for i in range(0, len(values), 50)]
    out = next(exact_dedup.misra_gries(8)(batches))
    bounds = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    assert len(bounds) <= 8
    for key, n in ((b"hot", 400), (b"warm", 200)):
        assert n - len(values) / 9 <= bounds[key] <= n


# lines and quality


def test_site_lines(spark):
    rows = [(i, f"Menu\n own {i} text\n\n menu ", "h") for i in range(10)] + [(99, "Menu", None), (98, None, "h"), (97, "", "k")]
    df = spark.createDataFrame([(*r, "d", "n") for r in rows], DOCS)
    out = line_dedup.drop_site_lines(df)
    got = {r.doc_id: (r.text, r["n_lines_"], r["n_dropped"]) for r in out.collect()}
    assert got[4] == (" own 4 text\n", 4, 2)
    assert got[99] == ("Menu", 1, 0) and got[98] == ("", 1, 0) and got[97] == ("", 1, 0)
    assert line_dedup.drop_site_lines(df.limit(0)).count() == 0


def test_site_lines_of_pages(spark):
    html = lambda i: f"<p>own {i}</p>\n<nav>menu</nav>"
    rows = [(i, f"https://{'A' if i < 8 else 'b'}.org/{i}", html(i)) for i in range(10)] + [(10, "no url", html(10)), (11, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", line_dedup.host_of(F.col("url")))
    got = {r.page_id: (r.host, r.n_dropped) for r in line_dedup.drop_site_lines(df, "host", "html").collect()}
    assert got == {i: ("a.org", 1) if i < 8 else ("b.org", 0) for i in range(10)} | {10: (None, 0), 11: (None, 0)}


def counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_base_counts(spark):
    rng = random.Random(8)
    texts = ["", " \n\t", "a", "a a", "a a a a", "x y z x y z", "a b\na b\n\n b#", "é$ü |\x0b<z>"]
    texts += [rng.choice(["", " "]) + "".join(rng.choice(["ab", "c", "dé"]) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    texts.append("w1 w2 w3 " * 20_000)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = quality.base_counts(df, "text")
    for r in out.collect():
        b = r[out.columns[-1]]
        got = (b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words)
        assert got == (counts(r.text) if len(r.text) < 10_000 else (60_000, 120_000, 0, 0, 60_000))


def test_frequent_lines(spark):
    prose = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    foot = " ".join(f"foot{k}" for k in range(80))
    rows = [(i, prose(i) + "\n" + foot, "h") for i in range(40)]  # depleted: most words are in a frequent line
    rows += [(100 + i, prose(500), "h") for i in range(30)]  # so are documents of one line that 30 documents have
    rows += [(140, prose(501), "h")] * 30  # rows that repeat a document count once
    rows += [(200, prose(600) + "\n" + foot, "other"), (201, None, "h"), (202, prose(601), None)]
    df = spark.createDataFrame([(*r, "d", "n") for r in rows], DOCS)
    out, v = quality.judged(df)
    clean = {r.doc_id: r.clean for r in out.withColumn("clean", quality.clean_text("text", F.col(v)["frequent"])).collect()}
    got = {r.doc_id: r[v] for r in out.collect()}
    assert all(got[i].depleted and not got[i].kept and clean[i] == prose(i) for i in range(40))
    assert clean[202] == prose(601) and clean[201] == ""
    assert all(got[100 + i].depleted and clean[100 + i] == "" for i in range(30))
    assert got[140].kept and got[200].kept and got[202].kept
    assert got[201].base_failed and not got[201].kept
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 32
    by_content, v = quality.judged(df, by_content=True)
    assert sum(r[v].kept for r in by_content.collect()) == 62
    assert quality.keep_good(df.limit(0)).count() == 0


def test_lines_of_documents_without_id(spark):
    foot = "some foot line"
    rows = [(None, f"text {i}\n{foot}", "h") for i in range(25)] + [(None, f"only\n{foot}", "k")] * 25
    out, v = quality.judged(spark.createDataFrame([(*r, "d", "n") for r in rows], DOCS))
    removed = sorted((r.source, r[v].n_removed_words) for r in out.collect())
    assert removed == [("h", 3)] * 25 + [("k", 0)] * 25


def test_very_long_texts(spark):
    """A text of some megabytes among short ones, for the operators on lines and words."""
    long = "\n".join(" ".join(f"w{i}x{k}" for k in range(50)) for i in range(10_000))
    rows = [(i, t, "h", "d", "n") for i, t in enumerate([long, "menu\nshort text", "menu\nother", "menu\nthird", long + " "])]
    df = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r for r in line_dedup.drop_site_lines(df, ratio=0.5).collect()}
    assert out[0].text == long and out[1].text == "short text"
    got = {r.doc_id: r for r in exact_dedup.exact_copies(df).collect()}
    assert [got[i].group_size for i in range(5)] == [1] * 5
    sized, plan = mixing.planned(df.withColumn("size", mixing.word_count(F.col("text"))), "size")
    taken = {r.doc_id: (r["size"], r[plan].taken) for r in sized.collect()}
    assert taken[0][0] == 500_000 and abs(sum(t for _, t in taken.values()) - 1_000_008) <= 16


def test_kept_documents_lose_the_lines_above_the_limits(spark):
    import corpus_pipeline as cp

    prose = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"{prose(i)}\n Share  this\n\nend {i}", "h", 0) for i in range(40)]
    rows += [(50, prose(50) + "\nShare this", "other", 0), (51, "Share this", "h", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    out = cp.quality_rules(spark, df, "")
    assert out.schema["n_chars"].dataType == df.schema["n_chars"].dataType and out.columns == df.columns
    want = {i: f"{prose(i)}\n\nend {i}" for i in range(40)} | {50: prose(50) + "\nShare this"}
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


# mixing


def highest_quotients(votes, seats):
    out = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


def test_apportionment(spark):
    rng = random.Random(1)
    for _ in range(3):
        groups = {g: ([rng.choice([0, 1, 7, 7, 130, 5000 * rng.random()]) for _ in range(rng.randrange(1, 9))] + [3.0], rng.randrange(0, 60)) for g in range(6)}
        rows = [(g, i, float(v), n) for g, (votes, n) in groups.items() for i, v in enumerate(votes)]
        df = spark.createDataFrame(rows, "g long, i long, v double, n long")
        got = {(r.g, r.i): r.q for r in mixing.apportioned(df, ["g"], "v", "n", ["i"], "q").collect()}
        for g, (votes, n) in groups.items():
            assert [got[g, i] for i in range(len(votes))] == highest_quotients(votes, n)


def test_targets_stop_at_the_limit(spark):
    words = {"a": 10, "b": 400, "c": 90, "d": 500, "e": 0, None: 200}
    rows = mixing.targets(spark.createDataFrame(list(words.items()), "src string, words long")).collect()
    got = {r.src: r.target for r in rows}
    weights = dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1], strict=True))
    want, free = {}, set(words)
    total = sum(words.values())
    while True:
        rest = total - sum(want.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * words[s]}
        if not over:
            break
        want |= {s: 3.0 * words[s] for s in over}
        free -= over
    want |= share
    assert got == pytest.approx(want)


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{i}_{k}" + rng.choice(["", "\n"]) for k in range(rng.randrange(0, 400))), rng.choice(["a", "b", "b", "b", None])) for i in range(300)]
    df = spark.createDataFrame([(*r, "d", "n") for r in rows], DOCS)
    out = mixing.mixed(df, shard_rows=40)
    again = sorted((r.doc_id, r.text) for r in mixing.mixed(df.repartition(3), shard_rows=40).collect())
    mixed = out.collect()
    assert out.columns == df.columns and again == sorted((r.doc_id, r.text) for r in mixed)
    size = {i: len(t.split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    text = {i: t for i, t, _ in rows}
    taken = dict.fromkeys(size, 0)
    for r in mixed:
        taken[r.doc_id] += len(r.text.split())
        assert r.text.strip() and r.text in text[r.doc_id]
    assert all(taken[i] <= 3 * size[i] for i in size)
    sizes = df.withColumn("size", mixing.word_count(F.col("text")))
    planned, plan = mixing.planned(sizes, "size", shard_rows=40)
    for r in planned.collect():
        assert r[plan].taken == taken[r.doc_id]
        near = sum(taken[i] for i in size if source[i] == r.source)
        assert abs(near - r[plan].target) <= 16 * 16
    twice = [(1, "a b c d", "a", "d", "n")] * 3 + [(2, "e f", "b", "d", "n")]
    words = sum(len(r.text.split()) for r in mixing.mixed(spark.createDataFrame(twice, DOCS)).collect())
    assert abs(words - 14) <= 16 and words > 0
    assert mixing.mixed(df.limit(0)).count() == 0
    assert mixing.mixed(spark.createDataFrame([(1, None, None, "d", "n")], DOCS)).count() == 0


def test_small_sources_of_short_texts_meet_their_targets(spark):
    """The mix of a small source does not depend on the number of shards of the whole table."""
    rng = random.Random(4)
    text = lambda a, b: " ".join(["w"] * rng.randint(a, b))
    rows = [(i, text(4, 8), "a") for i in range(500)] + [(i, text(2, 6), "b") for i in range(500, 900)]
    rows += [(i, text(40, 80), "c") for i in range(900, 3900)] + [(i, "", "a") for i in range(3900, 4200)]
    df = spark.createDataFrame([(*r, "d", "n") for r in rows], DOCS).withColumn("size", mixing.word_count(F.col("text")))
    for shard_rows in (20_000, 7):
        out, plan = mixing.planned(df, "size", shard_rows=shard_rows)
        assert out.count() == len(rows)
        p = F.col(plan)
        sums = out.groupBy("source").agg(F.sum(p["taken"]).alias("taken"), F.max(p["target"]).alias("target"), F.max(p["source_size"]).alias("words"))
        got = {r.source: r for r in sums.collect()}
        assert got["a"].target == 3 * got["a"].words and got["b"].target == 3 * got["b"].words
        for r in got.values():
            assert abs(r.taken - r.target) <= 48 + 0.003 * r.target


# packing


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 300, 900))[::-1]
    for tokens, documents, attention in ((512, 512, 512 * 512), (512, 3, 512 * 512), (512, 512, 60_000)):
        limit = lengths[lengths**2 <= attention]
        bins, offsets = packing.best_fit(limit, tokens, documents, attention, rule)
        for b in np.unique(bins):
            own = np.flatnonzero(bins == b)
            assert limit[own].sum() <= tokens and len(own) <= documents and (limit[own] ** 2).sum() <= attention
            at = 0
            for i in own[np.argsort(offsets[own])]:
                assert offsets[i] == at
                at += limit[i]
        if attention == 512 * 512 and documents == 512:
            assert bins.max() + 1 <= 1.02 * np.ceil(limit.sum() / tokens) + 1
    with pytest.raises(ValueError):
        packing.best_fit([600], 512, 512, 512 * 512)


def test_pieces():
    assert packing.pieces_of(1, 8) == [(0, 1)] and packing.pieces_of(8, 8) == [(0, 8)]
    assert packing.pieces_of(16, 8) == [(0, 8), (8, 8)] and packing.pieces_of(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_clashing_columns_and_long_texts(spark):
    text = "one two three four five " * 40_000
    df = spark.createDataFrame([(1, text), (2, "short")], "id long, text string")
    pieces = packing.token_pieces(df, "id", "text").withColumn("tag", F.lit("mine")).withColumn("shard", F.lit(5))
    placed = packing.packed(pieces)
    rows = placed.collect()
    assert placed.columns == [*pieces.columns, "sequence_id", "offset"] and {r.tag for r in rows} == {"mine"} and {r.shard for r in rows} == {5}
    assert sum(r.length for r in rows if r.id == 1) == 200_002 and len({r.sequence_id for r in rows}) == 98
    with pytest.raises(ValueError):
        packing.packed(pieces.withColumn("offset", F.lit(1)))


def test_documents_bind_without_more_sequences(spark):
    """The capacities of the query: those of few short documents stay under them, and no sequence is added."""
    rng = random.Random(12)
    lengths = [rng.randrange(1200, 2048) for _ in range(300)] + [rng.randrange(1, 12) for _ in range(4000)]
    df = spark.createDataFrame([(n,) for n in lengths], "length long")
    counts = {}
    for documents in (packing.DOCUMENTS, packing.TOKENS):
        rows = packing.packed(df, documents=documents).groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("length").alias("t")).collect()
        assert all(r.t <= packing.TOKENS for r in rows)
        counts[documents] = (len(rows), max(r.n for r in rows))
    assert counts[packing.DOCUMENTS][1] <= packing.DOCUMENTS < counts[packing.TOKENS][1]
    assert counts[packing.DOCUMENTS][0] == counts[packing.TOKENS][0]


def test_sequences_hold_the_ids(spark):
    rows = [(1, "one two three " * 30), (1, "one two three " * 30), (2, None), (None, ""), (3, "x" * 3000)]
    df = spark.createDataFrame(rows, "id long, text string")
    pieces = packing.token_pieces(df, "id", "text", tokens=64, with_ids=True)
    placed = packing.packed(pieces, tokens=64, shard_rows=4)
    encode = encoder(default_vocabulary())
    got = packing.sequences(placed).collect()
    assert sum(r.length for r in got) == sum(len(encode(t or "")) // 4 + 1 for _, t in rows)
    assert all(len(r.ids) == 4 * r.length <= 256 for r in got)
    assert packing.packed(packing.token_pieces(df.limit(0), "id", "text")).count() == 0


# tokens


@given(st.text(max_size=60) | st.text(alphabet="ab'sl 1\n\té_!ß—  ½<|endoftext|>", max_size=60))
@settings(max_examples=400, deadline=None)
def test_remembered_ids_are_the_library_s(text):
    encode = encoder(default_vocabulary())
    more = [text, "", " ".join(text.split()), "two\nlines and 3 words, it's", text]
    assert encode(text) == encode.whole(text)
    assert encode.batch(more) == [encode.whole(x) for x in more]


def test_long_texts_are_cut_where_the_library_cuts(monkeypatch):
    from changeloom.llm import tokens

    rng = random.Random(7)
    parts = ["word", "it's", " ", "  ", "\n", "\n\n", "Äß", "日本", "12", "--", "\t", "<|endoftext|>", "\x1c", "\x85", "\u3000"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(400))) for _ in range(40)] + ["x" * 900, "ab " * 300]
    encode = encoder(default_vocabulary())
    want = [encode.whole(t) for t in texts]
    for size in (1, 7, 60):
        monkeypatch.setattr(tokens, "SLICE_CHARS", size)
        assert all("".join(tokens.slices(t)) == t for t in texts)
        assert encode.batch(texts) == want and [encode(t) for t in texts] == want


def test_remembered_chunks_are_bounded(monkeypatch):
    from changeloom.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED_CHUNKS", 50)
    monkeypatch.setattr(tokens, "NEW_CHUNKS", 10)
    monkeypatch.setattr(tokens, "REMEMBERED_PIECES", 20)
    encode = tokens.Encoder(default_vocabulary())
    rng = random.Random(9)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(9)) for _ in range(4)]
        assert encode.batch(texts) == [encode.whole(t) for t in texts]
    assert 10 <= len(encode.chunks.keys) <= 50 and len(encode.pieces) <= 20
    assert (np.diff(encode.chunks.keys.astype(object)) > 0).all()


def test_store_of_long_texts_and_clashing_columns(spark):
    import zlib

    texts = ["many words here " * 90_000, "", "x" * 100_000, "end"]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, file int, offset int, ids int")
    path = Scratch(spark, "test").path("orc")
    token_store.write_tokens(df, path, partitions=2)
    rows = {r.doc_id: r for r in token_store.checksums(token_store.read_tokens(spark, path)).collect()}
    encode, at = encoder(default_vocabulary()), 0
    for i, t in enumerate(texts):
        ids = encode(t) + bytes(4)
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_token_store(spark):
    rows = [(3, "c d"), (1, "a"), (None, "z"), (2, None), (2, "b b"), (2, "b b")]
    path = Scratch(spark, "test").path("orc")
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, partitions=3)
    stored = token_store.read_tokens(spark, path)
    out = sorted(stored.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [1, 2, 2, 2, 3, None]
    at = 0
    for r in out:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 0
        at += r.n_tokens
    assert [r.doc_id for r in token_store.find(spark, path, [3]).collect()] == [3]
    plan = token_store.find(spark, path, [3])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id, [3])" in plan or "EqualTo(doc_id,3)" in plan
    token_store.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_store.checksums(token_store.read_tokens(spark, path)).count() == 0


# archives


def test_archives(spark):
    long = "é" * 60
    rows = [(7, "http://a/x y", long), (3, "http://b", long), (4, None, "short"), (5, "u", "short"), (6, "u", None), (None, "u", long), (3, "http://b", long)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, digest string")
    folder = Scratch(spark, "test").path("warc")
    assert warc.write_warc(df, folder, roll_bytes=400).count() > 1
    out = warc.read_warc(spark, folder).collect()
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in out)
    assert got == sorted([
        ("7", 120, "revisit", "3"), ("3", 120, "response", "None"), ("3", 120, "response", "None"), ("None", 120, "revisit", "3"),
        ("4", 5, "response", "None"), ("5", 5, "response", "None"), ("6", 0, "response", "None"),
    ])
    empty = Scratch(spark, "test").path("none")
    assert warc.write_warc(df.limit(0), empty).count() == 0
    assert warc.read_warc(spark, empty).count() == 0


def test_archives_with_long_urls(spark):
    long = "é" * 60
    rows = [(1, "http://a/" + "x" * 100_000, long), (2, "http://a/" + " " * 40_000, long), (3, "http://a/" + "WARC/1.1 \n" * 9_000, "other")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, digest string")
    folder = Scratch(spark, "test").path("warc")
    warc.write_warc(df, folder)
    got = {r.page_id: (r.kind, r.record_type, r.refers_to, len(r.target_uri or "")) for r in warc.read_warc(spark, folder).collect()}
    assert got == {
        "1": ("record", "response", None, 100_009), "2": ("record", "revisit", "1", 120_009), "3": ("record", "response", None, 9 + 9_000 * 14),
    }


def test_header_ends_before_the_next_version_line():
    raw = members(4)
    broken = raw[1][: raw[1].index(b"\r\n\r\n")] + b"\r\n"  # its blank line is gone
    data = raw[0] + broken + raw[2] + raw[3]
    assert [x[0] for x in warc.salvage(data)] == [0, len(raw[0]), len(raw[0] + broken), len(raw[0] + broken + raw[2])]
    assert [len(x) for x in warc.salvage(data)] == [5, 3, 5, 5]
    assert len(list(warc.salvage(b"WARC/1.1\r\n" * 200_000))) == 1


def test_junk_headers_are_gaps():
    raw = members(3)
    for old, new in ((b"Content-Length: ", b"Content-Length: \xc2\xb2"), (b"X-Payload-Length: ", b"X-Payload-Length: abc"), (b"WARC-Date: 2024-01-01T00:00:00Z", b"WARC-Date 2024"), (b"Content-Length: ", b"Content-Length: -")):
        for pack in (bytes, gzip.compress):
            data = pack(raw[0]) + pack(raw[1].replace(old, new)) + pack(raw[2])
            ids, gaps = ids_and_gaps(data)
            assert ids == [0, 2] and len(gaps) == 1


def test_false_marks_cost_a_linear_search():
    import time

    for mark in (b"\x1f\x8b\x08", b"\x1f\x8b\x08\x08ab", b"WARC/1.1\r\n"):
        took = []
        for n in (5_000, 40_000):
            began = time.perf_counter()
            assert len(list(warc.salvage(b"x" + mark * n))) == 1
            took.append(time.perf_counter() - began)
        assert took[1] < 30 * took[0] + 0.5


def test_very_long_payloads_and_repeated_writes(spark):
    import hashlib
    from pathlib import Path

    long = "<p>some text of a page</p>\n" * 800_000
    rows = [(i, f"u{i}", long if i in (3, 5) else f"{i} " * 100) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4, "page_id")
    first, second = (Scratch(spark, "test").path("warc") for _ in range(2))
    for folder in (first, second):
        warc.write_warc(df, folder, roll_bytes=2000)
    read = {r.page_id: r for r in warc.read_warc(spark, first).collect()}
    assert len(read) == 40 and read["3"].payload_bytes == len(long) and read["5"].refers_to == "3" and read["3"].payload.decode() == long
    files = [{p.name: hashlib.md5(p.read_bytes()).hexdigest() for p in Path(f.removeprefix("file://")).glob("*.warc.gz")} for f in (first, second)]
    assert files[0] == files[1] and len(files[0]) > 4


def members(n):
    import hashlib

    out = []
    for i in range(n):
        payload = f"<p>page {i} {'x' * 50 * i}</p>".encode()
        out.append(warc.record(i, f"http://h/{i}", payload, hashlib.sha256(payload).hexdigest(), None, len(payload)))
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    raw = [gzip.compress(x) if packed else x for x in members(8)]
    starts = np.cumsum([0, *map(len, raw)]).tolist()
    whole = b"".join(raw)
    found = list(warc.salvage(whole))
    assert [x[0] for x in found] == starts[:-1] and all(len(x) == 5 for x in found)
    damaged = bytearray(whole)
    for at in range(starts[3] - 30, starts[3] - 15):
        damaged[at] ^= 0xFF  # inside the payload of record 2
    damaged[starts[5]] ^= 0xFF  # the first byte of record 5
    data = bytes(damaged[: starts[7] + 20])  # and the last one is cut
    found = list(warc.salvage(data))
    good = [int(x[2]["x-page-id"]) for x in found if len(x) == 5]
    gaps = [(x[0], x[0] + x[1]) for x in found if len(x) == 3]
    assert good == [0, 1, 3, 4, 6]
    assert gaps == [(starts[2], starts[3]), (starts[5], starts[6]), (starts[7], len(data))]
    assert sum(x[1] for x in found) == len(data)


def ids_and_gaps(data):
    found = list(warc.salvage(data))
    return [int(x[2]["x-page-id"]) for x in found if len(x) == 5], [x for x in found if len(x) == 3]


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_inside_a_member(level):
    raw = members(200)
    starts = np.cumsum([0, *map(len, raw)]).tolist()
    whole = gzip.compress(b"".join(raw), level)
    assert ids_and_gaps(whole) == ([*range(200)], [])
    plain = bytearray(b"".join(raw))
    for i in (3, 4, 150):
        plain[starts[i + 1] - 10] ^= 0xFF  # a payload
    plain[starts[100]] ^= 0xFF  # a version line
    two = gzip.compress(bytes(plain), level) + gzip.compress(raw[0], level)
    ids, gaps = ids_and_gaps(two)
    assert ids == [i for i in range(200) if i not in (3, 4, 100, 150)] + [0] and len(gaps) == 3
    assert all(f"from byte {starts[i]} " in x[2] for i, x in zip((3, 100, 150), gaps, strict=True))
    # the end is cut, the CRC fails, the deflate data is damaged; the member behind is found again
    cut = whole[: len(whole) * 3 // 4]
    ids, gaps = ids_and_gaps(cut)
    assert 50 < len(ids) < 200 and ids == [*range(len(ids))] and len(gaps) == 1 and gaps[0][:2] == (0, len(cut))
    wrong = bytearray(whole)
    wrong[-8] ^= 0xFF
    ids, gaps = ids_and_gaps(bytes(wrong) + gzip.compress(raw[7], level))
    assert ids == [*range(200), 7] and [x[:2] for x in gaps] == [(0, len(whole))]
    wrong = whole[: len(whole) // 2] + b"\xff" * 400 + whole[len(whole) // 2 + 400 :]
    ids, gaps = ids_and_gaps(wrong + gzip.compress(raw[7], level))
    assert len(ids) > 50 and len(set(ids[:-1])) == len(ids) - 1 and ids[-1] == 7 and gaps
    # without a digest nothing vouches for a payload of a member that fails its CRC
    bare = gzip.compress(b"".join(raw).replace(b"WARC-Payload-Digest", b"X-Other"), level)
    assert len(ids_and_gaps(bare)[0]) == 200 and ids_and_gaps(bare[:-8] + b"12345678")[0] == []


@given(st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_salvage_never_fails(noise):
    data = noise + gzip.compress(members(1)[0]) + noise[:7]
    found = list(warc.salvage(data))
    assert sum(x[1] for x in found) == len(data)
    assert any(len(x) == 5 for x in found)


# chat


def test_chat_round_trip(spark):
    hard = ["", None, "\\", "\\\\[INST]", "[\\INST]", "</s>[INST] ok [/INST]", "<s><s", "a</s", "[/INST]\\", "x\ny", "<</s>>"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(hard[:10])]
    rows += [(2, 1, "assistant", "no"), (2, 0, "user", hard[10]), (3, 0, "assistant", "first"), (4, 0, None, "who"), (4, 0, None, "who"), (5, 0, "[INST]", "odd"), (6, 0, "system", "s")]
    rows += [(None, 0, "user", "u"), (None, 1, "assistant", "v")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(df).withColumn("string", chat.joined(F.col("segments"))).withColumn("loss", chat.loss_text(F.col("segments")))
    out = out.withColumn("turns", chat.parsed(F.col("string")))
    for r in out.collect():
        own = sorted((x[1:] for x in rows if x[0] == r.conv_id), key=lambda x: (x[0], x[1] or "", x[2] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(a or "", b or "") for _, a, b in own]
        assert r.loss == "".join(b or "" for _, a, b in own if a == "assistant")
        assert r.string.count("</s>") == len(own)
    valid = {r.conv_id: r.valid for r in out.collect()}
    assert valid == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, None: True}
    assert chat.formatted(df.limit(0)).count() == 0
    for wrong in ({"open": "\\x"}, {"close": "##"}, {"close": "|>end|>"}, {"middle": "[INST]/"}, {"open": "x</", "more_controls": ("s>x",)}, {"close": ""}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)


@given(st.lists(st.text(alphabet="#|ab\\<>", min_size=2, max_size=4), min_size=3, max_size=4), st.lists(st.text(alphabet="#|ab\\<>", max_size=9), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_valid_templates_read_back(marks, texts):
    """The rule on templates, with the formatting and its inverse in plain Python."""
    import re

    try:
        t = chat.Template(begin="<s>", open=marks[0], middle=marks[1], close=marks[2], more_controls=tuple(marks[3:]))
    except ValueError:
        return
    broken = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in t.controls))
    out = t.begin + "".join(t.open + "r" + t.middle + broken.sub(lambda m: m[0] + "\\", x.replace("\\", "\\\\")) + t.close for x in texts)
    parts = out[len(t.begin) :].split(t.close)
    assert parts.pop() == "" and len(parts) == len(texts)
    back = [p[len(t.open) :].split(t.middle) for p in parts]
    assert [re.sub(r"\\(\\|)", r"\1", x) for _, x in back] == texts


def test_very_long_conversations(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"</s>{i}") for i in range(20_000)] + [(2, 0, "user", "[INST]" * 500_000), (2, 1, "assistant", "\\" * 1_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(df).withColumn("loss", chat.loss_text(F.col("segments"))).withColumn("turns", chat.parsed(chat.joined(F.col("segments"))))
    got = {r.conv_id: r for r in out.select("conv_id", "valid", "loss", F.size("turns").alias("n"), F.sha2(F.get("turns", 0)["text"], 256).alias("first")).collect()}
    assert got[1].valid and got[2].valid and got[1].n == 20_000 and got[2].n == 2
    assert got[1].loss == "".join(t for _, i, r, t in rows[:20_000] if r == "assistant") and got[2].loss == "\\" * 1_000_000

"""Suffix-array deduplication: byte strings of 400 that start more than once go.

A byte is removed when a 400-byte string covers it that also starts anywhere
else, in another document or in the same one.  Strings are judged on the input.

Sorting every suffix would move hundreds of times the corpus, so the suffix
array is sparse, by a rule that loses nothing:

1. *Anchors.*  Among the 16-byte grams of each run of 200 consecutive positions
   the leftmost one of least hash is an anchor.  Every 400-byte string holds an
   anchor among its first 200 positions, chosen by the string's content alone, so
   equal strings hold anchors at equal offsets, followed by 201 bytes or more of
   the string.  Anchors whose next 201 bytes occur once (counted by hash, over
   the corpus) are set aside.
   Equal texts are one text here; all bytes of a text that has copies go.
2. *Suffix array.*  The suffixes at the remaining anchors, up to 400 bytes with
   the 199 bytes before them, are range-partitioned by their leading bytes with
   sampled splitters, into as many partitions as their number asks for.  Spark
   sorts a partition by 201 bytes, spilling if it must; buckets of about
   ``BUCKET`` suffixes are cut from it between different 201-byte prefixes, so a
   task's memory does not grow with its partition.  A bucket sorts its suffixes by
   multikey quicksort, takes common prefixes of neighbours, and compares its first
   suffix with the last one of the bucket before: these share fewer than 201 bytes,
   as splitters are prefixes of 201 bytes too, and no match crosses.
3. *Spans.*  If two anchors agree on ``a`` bytes before and ``b`` bytes from them
   on, and ``a + b >= 400``, then [anchor - a, anchor + b) is covered at both.
   The union over partners is given by the greatest ``a`` and the greatest ``b``
   among partners with ``a + b >= 400``.  Neighbours in order of suffixes and in
   order of reversed prefixes give upper bounds and usually reach them; where
   they do not, the anchor is compared with its whole group through running
   minima of the common prefixes.
4. A group of more than ``GROUP`` suffixes with the same 201 bytes is not gathered
   in a bucket: its 400-byte strings are counted one by one by their hash, a sum
   that is aggregated map-side.

Defined results: a null text counts as empty; texts under 400 bytes keep all
their bytes; repeated rows repeat each other's strings, so they lose them all;
a null id is carried along; an empty table gives an empty result; columns other
than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, quoted, ship, whole_text

LENGTH = 400
WINDOW = 200
GRAM = 16
SHARED = LENGTH - WINDOW + 1
GROUP = 20_000
BUCKET = 16_384
#: Suffixes of a partition of the range partitioning, and how many partitions there may be: the
#: driver sees a sample of 100 prefixes for each.  Beyond that partitions grow, buckets do not.
PARTITION, MOST_PARTITIONS = 1 << 16, 1 << 14
CHUNK = 1 << 20
#: End of a span that covers all of a text.
ALL = 1 << 62


def _gram_hashes(data):
    """Hashes of the 16-byte grams that start at each position of a byte array."""
    import numpy as np

    from .shingles import mixed

    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | x[step:] << np.uint64(8 * step)
    return mixed(mixed(x[:-8]) + x[8:] * np.uint64(0x9E3779B97F4A7C15))


def _chunk_anchors(data):
    import numpy as np

    places = np.uint64((1 << 24) - 1)
    rank = _gram_hashes(data) & ~places | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    least, width = rank, 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    found = (least & places).astype(np.int64)
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def anchors(data):
    """Sorted anchor positions of a byte array of LENGTH bytes or more."""
    import numpy as np

    overlap = WINDOW + GRAM - 2
    parts = [_chunk_anchors(data[at : at + CHUNK + overlap]) + at for at in range(0, max(1, len(data) - overlap), CHUNK)]
    found = np.unique(np.concatenate(parts))
    return found[found + SHARED <= len(data)]


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, places, hashes) of each text that can hold a match; equal texts share a name."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        names, places, hashes = [], [], []
        for text in batch.column(0):
            raw = text.as_buffer()
            if raw.size < LENGTH:
                continue
            found = anchors(np.frombuffer(raw, np.uint8))
            view = memoryview(raw)
            names.append(xxhash.xxh3_128_digest(raw))
            places.append(found.astype(np.int32))
            hashes.append(np.array([digest(view[p : p + SHARED]) for p in found.tolist()], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array(places, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))],
            ["name", "places", "hashes"],
        )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, name, packed text) of each row."""
    import xxhash
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        raws = [t.as_buffer() for t in batch.column(1)]
        names = [xxhash.xxh3_128_digest(r) for r in raws]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names, pa.binary()), pa.array([pack(r) for r in raws], pa.binary())], ["id", "name", "packed"]
        )


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, packed text) of the texts that can hold a match, each at most once for each task."""
    import xxhash
    import zstandard

    pack, seen = zstandard.ZstdCompressor(level=1).compress, set()
    for batch in batches:
        names, texts = [], []
        for text in batch.column(0):
            raw = text.as_buffer()
            if raw.size >= LENGTH and (name := xxhash.xxh3_128_digest(raw)) not in seen:
                seen.add(name)
                names.append(name)
                texts.append(pack(raw))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(texts, pa.binary())], ["name", "packed"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, doc, place, hash, suffix, prefix) of each anchor that may match.

    ``prefix`` is reversed.  A task sends the bytes of a context twice at most:
    a second row says that it occurs again.
    """
    import xxhash
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    sent: dict[bytes, int] = {}
    names = ["context", "doc", "place", "hash", "suffix", "prefix"]
    types = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def flush(rows):
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        rows = []
        for doc, packed, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = unpack(packed)
            for hit in hits:
                place = hit["place"]
                suffix, prefix = text[place : place + LENGTH], text[max(0, place - WINDOW + 1) : place][::-1]
                context = xxhash.xxh3_128_digest(len(suffix).to_bytes(2, "little") + suffix + prefix)
                seen = sent.get(context, 0)
                if seen < 2:
                    sent[context] = seen + 1
                full = seen < 2
                rows.append((context, doc, place, hit["hash"], suffix if full else None, prefix if full else None))
            if len(rows) > 10_000:
                yield flush(rows)
                rows = []
        yield flush(rows)


def multikey_quicksort(strings: list[bytes]):
    """Positions of ``strings`` in sorted order.

    Three-way partitioning on one character at a time, where a character is
    eight bytes; small parts are sorted by comparison.
    """
    import numpy as np

    width = max(8, -(-max(map(len, strings), default=0) // 8) * 8)
    if not strings:
        return np.empty(0, np.int64)
    keys = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), ">u8").reshape(len(strings), -1).astype(np.uint64)
    out, todo = [], [(np.arange(len(strings)), 0)]
    while todo:
        part, depth = todo.pop()
        if len(part) <= 24 or depth >= keys.shape[1]:
            out.extend(sorted(part.tolist(), key=strings.__getitem__) if len(part) > 1 else part.tolist())
            continue
        here = keys[part, depth]
        pivot = here[len(here) // 2]
        todo.append((part[here > pivot], depth))
        todo.append((part[here == pivot], depth + 1))
        todo.append((part[here < pivot], depth))
    return np.array(out, np.int64)


def _matrix(strings: list[bytes], width: int):
    import numpy as np

    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def _common(table, sizes, i, j):
    """Common prefixes of rows ``i`` and rows ``j``."""
    import numpy as np

    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 8192):
        x, y = i[at : at + 8192], j[at : at + 8192]
        differ = table[x] != table[y]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
        out[at : at + 8192] = np.minimum(first, np.minimum(sizes[x], sizes[y]))
    return out


def _outward(order_common, at: int):
    """Common prefix of the row at ``at`` with every other, from those of neighbours."""
    import numpy as np

    before = np.minimum.accumulate(order_common[:at][::-1])[::-1]
    after = np.minimum.accumulate(order_common[at:])
    return before, after


def reaches(suffixes: list[bytes], prefixes: list[bytes], counts):
    """(a, b) for each distinct context, the greatest agreements before and after that
    belong to matches of LENGTH bytes; (0, 0) where there is none."""
    import numpy as np

    n = len(suffixes)
    best_a, best_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return best_a, best_b
    right, left = _matrix(suffixes, LENGTH), _matrix(prefixes, WINDOW)
    right_size, left_size = np.array([*map(len, suffixes)]), np.array([*map(len, prefixes)])
    own = (np.asarray(counts) > 1) & (right_size + left_size >= LENGTH)
    best_a[own], best_b[own] = left_size[own], right_size[own]

    order = multikey_quicksort(suffixes)
    after = _common(right, right_size, order[:-1], order[1:])
    cuts = np.concatenate([[0], np.flatnonzero(after < SHARED) + 1, [n]])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo < 2 or own[order[lo:hi]].all():
            continue
        group, by_suffix = order[lo:hi], after[lo : hi - 1]
        turned = multikey_quicksort([prefixes[i] for i in group.tolist()])
        back = group[turned]  # the group in order of reversed prefixes
        by_prefix = _common(left, left_size, back[:-1], back[1:])
        g = hi - lo
        bound_b = np.zeros(g, np.int64)
        place = np.empty(g, np.int64)
        place[turned] = np.arange(g)  # of each group member, by suffix order, in prefix order
        bound_b[:-1] = by_suffix
        bound_b[1:] = np.maximum(bound_b[1:], by_suffix)
        edge = np.zeros(g, np.int64)
        edge[:-1] = by_prefix
        edge[1:] = np.maximum(edge[1:], by_prefix)
        bound_a = edge[place]
        got_a, got_b = best_a[group].copy(), best_b[group].copy()

        def offer(i, j, a, b, got_a=got_a, got_b=got_b):
            good = a + b >= LENGTH
            for x in (i[good], j[good]):
                np.maximum.at(got_a, x, a[good])
                np.maximum.at(got_b, x, b[good])

        spots = np.arange(g)
        offer(spots[:-1], spots[1:], _common(left, left_size, group[:-1], group[1:]), by_suffix)
        offer(turned[:-1], turned[1:], by_prefix, _common(right, right_size, back[:-1], back[1:]))
        open_ = (bound_a + bound_b >= LENGTH) & ((got_a < bound_a) | (got_b < bound_b)) & ~own[group]
        for at in np.flatnonzero(open_).tolist():
            b = np.empty(g, np.int64)
            b[:at], b[at + 1 :] = _outward(by_suffix, at)
            a_turned = np.empty(g, np.int64)
            a_turned[: place[at]], a_turned[place[at] + 1 :] = _outward(by_prefix, int(place[at]))
            a_turned[place[at]] = b[at] = -LENGTH
            a = a_turned[place]
            good = a + b >= LENGTH
            if good.any():
                got_a[at] = max(got_a[at], int(a[good].max()))
                got_b[at] = max(got_b[at], int(b[good].max()))
        best_a[group], best_b[group] = got_a, got_b
    return best_a, best_b


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list]]:
    """Contexts, suffixes, prefixes and counts of about BUCKET suffixes, from rows in order of their 201-byte prefixes."""
    seen: dict[bytes, list] = {}
    rows, head = 0, b""
    for batch in batches:
        for context, suffix, prefix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows >= BUCKET and suffix[:SHARED] != head:
                yield [*seen], *map(list, zip(*seen.values(), strict=True))
                seen, rows = {}, 0
            rows, head = rows + 1, suffix[:SHARED]
            if context in seen:
                seen[context][2] += 1
            else:
                seen[context] = [suffix, prefix, 1]
    if seen:
        yield [*seen], *map(list, zip(*seen.values(), strict=True))


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, a, b) of the contexts of a partition that match elsewhere."""
    import numpy as np

    last = None
    for names, suffixes, prefixes, counts in _buckets(batches):
        if last is not None and min(suffixes)[:SHARED] <= last[:SHARED]:
            raise ValueError("a match may cross two buckets: their order or their cut is wrong")
        last = max(suffixes)
        a, b = reaches(suffixes, prefixes, counts)
        hit = np.flatnonzero(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in hit.tolist()], pa.binary()), pa.array(a[hit]), pa.array(b[hit])], ["context", "a", "b"]
        )


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, offset, string): every 400-byte string around an anchor of a large group, by its hash."""
    import xxhash

    for batch in batches:
        for context, suffix, prefix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text, at = prefix[::-1] + suffix, len(prefix)
            offsets = range(max(0, LENGTH - len(suffix)), at + 1)
            found = [xxhash.xxh3_128_digest(text[at - x : at - x + LENGTH]) for x in offsets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([context] * len(found), pa.binary()), pa.array(list(offsets), pa.int32()), pa.array(found, pa.binary())],
                ["context", "offset", "string"],
            )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint spans that cover the same positions; touching spans become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        sizes, removed, spans, kept, sums = [], [], [], [], []
        for packed, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = unpack(packed)
            runs = merged([(x["from"], min(x["to"], len(text))) for x in found or ()])
            ends = [0, *(b for _, b in runs)]
            rest = b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(text)], strict=True))
            sizes.append(len(text))
            removed.append(len(text) - len(rest))
            spans.append([{"from": a, "to": b} for a, b in runs])
            kept.append(rest)
            sums.append(hashlib.sha256(rest).hexdigest())
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(sums, pa.string()), pa.array(kept, pa.binary())],
            ["id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"],
        )


def _matches(hits: DataFrame, scratch: Scratch, group: int) -> DataFrame:
    """(context, a, b) for the contexts that match elsewhere."""
    shown = hits.where("suffix is not null")
    large = scratch.keep(shown.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > group), "large")
    small = shown.join(large.select("hash"), "hash", "left_anti").select("context", "suffix", "prefix")
    head = F.substring("suffix", 1, SHARED)
    partitions = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, shown.count() // PARTITION + 1))
    buckets = small.repartitionByRange(partitions, head).sortWithinPartitions(head).mapInArrow(_matched, "context binary, a long, b long")
    if large.isEmpty():
        return buckets
    wide = shown.join(large.select("hash"), "hash", "left_semi").select("context", "suffix", "prefix")
    strings = scratch.keep(wide.mapInArrow(_strings, "context binary, offset int, string binary"), "strings")
    again = strings.groupBy("offset", "string").agg(F.count("*").alias("n")).where("n > 1").select("offset", "string")
    found = strings.join(again, ["offset", "string"], "left_semi").groupBy("context")
    found = found.agg(F.max("offset").cast("long").alias("a"), (F.lit(LENGTH) - F.min("offset")).cast("long").alias("b"))
    return buckets.union(found)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row for each row of ``df``: id, n_bytes, n_removed, spans, kept_sha256, kept (bytes)."""
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "suffix")
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(quoted(id_col)).alias("id"), whole_text(text_col).cast("binary").alias("text"))
    rows = docs.select("text").mapInArrow(_anchored, "name binary, places array<int>, hashes array<long>")
    # copies are counted map-side and go on as one text
    found = rows.groupBy("name").agg(F.first("places").alias("places"), F.first("hashes").alias("hashes"), F.count("*").alias("copies"))
    found = scratch.keep(found.withColumn("doc", F.monotonically_increasing_id()), "anchors")
    each = found.select("doc", F.explode(F.arrays_zip("places", "hashes")).alias("x"))
    each = each.select("doc", F.col("x.places").alias("place"), F.col("x.hashes").alias("hash"))
    # written first, so that the join below has two plain shuffles and hot hashes are split
    twice = scratch.keep(each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "twice")
    hits = each.join(twice, "hash").groupBy("doc").agg(F.collect_list(F.struct("place", "hash")).alias("hits"))
    hits = scratch.keep(hits.join(found.select("doc", "name"), "doc"), "hits")
    texts = docs.select("text").mapInArrow(_once, "name binary, packed binary")
    met = texts.join(hits, "name").groupBy("doc").agg(F.first("packed").alias("packed"), F.first("hits").alias("hits"))
    schema = "context binary, doc long, place int, hash long, suffix binary, prefix binary"
    hits = scratch.keep(met.mapInArrow(_contexts, schema), "contexts")
    scratch.drop("hits")
    scratch.drop("twice")
    matches = scratch.keep(_matches(hits, scratch, group).groupBy("context").agg(F.max("a").alias("a"), F.max("b").alias("b")), "matches")
    spans = hits.select("context", "doc", "place").join(matches, "context")
    span = F.struct((F.col("place") - F.col("a")).alias("from"), (F.col("place") + F.col("b")).alias("to"))
    spans = spans.groupBy("doc").agg(F.collect_list(span).alias("spans")).join(found.where("copies = 1").select("doc", "name"), "doc")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.lit(ALL).alias("to"))).alias("spans")
    spans = scratch.keep(spans.select("name", "spans").union(found.where("copies > 1").select("name", whole)), "spans")
    scratch.drop("contexts")
    texts = docs.mapInArrow(_packed, f"id {kind}, name binary, packed binary")
    out = texts.join(spans, "name", "left").select("id", "packed", "spans")
    row = f"id {kind}, n_bytes long, n_removed long, spans array<struct<`from`:long,`to`:long>>, kept_sha256 string, kept binary"
    return out.mapInArrow(_stripped, row)

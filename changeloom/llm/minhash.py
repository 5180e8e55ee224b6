"""Near-duplicates by MinHash with a multi-index Hamming join.

Two documents are linked when ``100 * intersection >= 75 * union`` of their
five-word shingle sets; components of linked documents are the groups.

1. Documents with the same shingle set form a class; only classes go on.
2. A class gets 48 MinHash values of 16 bits.  The signature distance of two
   classes is the number of values that differ.  The signature is split into 12
   chunks of 4 values; by the pigeonhole principle two signatures at distance 23
   or less agree in some chunk but for at most one value.  Enumerating the one
   allowed error (each value left out in turn) gives 48 exact keys, so every
   pair within distance 23 shares a key.  A pair at similarity 0.75 exactly is
   within 23 with probability 0.9997, and shares a key at any distance but for
   one case in ten million; pairs found at distance up to 28 are kept too.
3. Within a bucket (classes with a common key) signatures at distance 28 or
   less are joined to the smallest of them, never by all pairs; a bucket of more
   than ``BUCKET`` classes is joined whole.  Components of these edges, clumps,
   hold every pair that can be linked.
4. Each clump's texts meet once, in blocks of ``BLOCK`` classes, and links are
   confirmed on full sets: candidates by rarest shingles, exact intersections,
   and none for pairs that are connected already.  A clump of several blocks
   first compares each block inside and against four leaders; classes that stay
   outside the clump's largest component are then compared with all its blocks, in
   batches of ``BLOCK`` too, so no link is lost and no task holds more than about
   two blocks.  This part is quadratic in the classes outside.
5. Components of the links give each document the smallest id it reaches.

Defined results: a null or empty text, or one of white space only, has no
shingles and stands alone; rows with equal id and text count as one document
with the same result, rows with equal id and other texts as several; a null id is greater than all others; an empty table gives an empty
result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, quoted, ship
from .components import components

VALUES, CHUNKS = 48, 12
GUARANTEED, ACCEPTED = 2 * CHUNKS - 1, 28
BUCKET = 1000
BLOCK = 1000
LEADERS = 4
PERCENT = 75


def _multipliers():
    import numpy as np

    from .shingles import mixed

    return mixed(np.arange(1000, 1000 + VALUES, dtype=np.uint64)) | np.uint64(1)


def signature(shingles) -> bytes:
    """48 MinHash values of 16 bits each."""
    import numpy as np

    from .shingles import mixed

    least = None
    for at in range(0, len(shingles), 2048):
        part = (shingles[at : at + 2048, None] * _multipliers()).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return (mixed(least) >> np.uint64(48)).astype(np.uint16).tobytes()


def _signed(carried: list[str]):
    """Rows (id, text, columns to carry) with size, class and signature instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from .shingles import shingle_set

        for batch in batches:
            sizes, sets, signs = [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_buffer()) if text.is_valid else ()
                sizes.append(len(found))
                sets.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signs.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(signs, pa.binary()), *batch.columns[2:]],
                ["id", "n", "class", "sign", *carried],
            )

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, packed text), a class at most once for each task."""
    import xxhash
    import zstandard

    from .shingles import shingle_set

    seen: set[bytes] = set()
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        names, texts = [], []
        for text in batch.column(0):
            found = shingle_set(text.as_buffer()) if text.is_valid else ()
            name = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
            if name and name not in seen:
                seen.add(name)
                names.append(name)
                texts.append(pack(text.as_buffer()))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(texts, pa.binary())], ["class", "packed"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node): the chunks of each signature with each value left out once.

    A key holds the number of the error pattern and the values left, 64 bits in
    all, so equal keys mean equal values.
    """
    import numpy as np

    width = VALUES // CHUNKS
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            nodes = part.column(0).to_numpy(zero_copy_only=False)
            values = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, CHUNKS, width).astype(np.uint64)
            keys = np.empty((len(nodes), CHUNKS, width), np.uint64)
            for out in range(width):
                left = [i for i in range(width) if i != out]
                tag = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(width) + np.uint64(out)) << np.uint64(48)
                keys[:, :, out] = tag | values[:, :, left[0]] << np.uint64(32) | values[:, :, left[1]] << np.uint64(16) | values[:, :, left[2]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(nodes, VALUES))], ["key", "node"]
            )


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Groups of rows that are equal in the first ``keys`` columns, from sorted batches."""
    name, columns = None, None
    for batch in batches:
        lists = [c.to_pylist() for c in batch.columns]
        at = 0
        while at < batch.num_rows:
            here = tuple(x[at] for x in lists[:keys])
            end = at + 1
            while end < batch.num_rows and all(lists[i][end] == here[i] for i in range(keys)):
                end += 1
            if here != name:
                if columns is not None:
                    yield name, columns
                name, columns = here, [[] for _ in lists[keys:]]
            for store, x in zip(columns, lists[keys:], strict=True):
                store.extend(x[at:end])
            at = end
    if columns is not None:
        yield name, columns


def _batched(pairs: Iterator[tuple[int, int]], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    u, v = [], []
    for a, b in pairs:
        u.append(a)
        v.append(b)
        if len(u) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
            u, v = [], []
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def stars(pairs) -> Iterator[tuple[int, int]]:
    """(smallest, other) for the nodes that some pairs connect: the same components in fewer steps for what follows."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    for x in list(parent):
        if (top := root(x)) != x:
            yield top, x


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars that connect the signatures within ACCEPTED, bucket by bucket."""
    import numpy as np

    def edges():
        for _, (nodes, signs) in grouped(batches, 1):
            values = np.frombuffer(b"".join(signs), np.uint16).reshape(len(nodes), VALUES)
            rest = np.arange(len(nodes))
            while len(rest) > 1:
                together, reached, rest = [], [rest[0]], rest[1:]
                while reached and len(rest):
                    one = reached.pop()
                    together.append(one)
                    close = (values[rest] != values[one]).sum(axis=1) <= ACCEPTED
                    reached += rest[close].tolist()
                    rest = rest[~close]
                names = [nodes[x] for x in together + reached]
                least = min(names)
                yield from ((least, x) for x in names if x != least)

    yield from _batched(edges())


def linked(sets: list, tested=None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what is similar: positions in ``sets`` (sorted distinct arrays).

    Pairs in one component already are passed over, so this is a spanning forest
    of the similarity graph, not all its edges.  ``tested``: positions of which
    at least one must be in a pair; all by default.
    """
    import numpy as np

    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(inverse, kind="stable")
    posting = owner[order]
    ends = np.cumsum(count)
    begins = ends - count
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    mark = np.zeros(len(values), bool)
    queries = range(len(sets)) if tested is None else sorted(tested)
    asked = np.zeros(len(sets), bool)
    for x in queries:
        asked[x] = True
        own = inverse[bounds[x] : bounds[x + 1]]
        n = len(own)
        short = n - -(-percent * n // 100) + 1  # any so many shingles of x meet every set that is similar to x
        rare = own if short >= n else own[np.argpartition(count[own], short - 1)[:short]]
        rare = rare[count[rare] > 1]
        if not len(rare):
            continue
        near = np.unique(np.concatenate([posting[begins[g] : ends[g]] for g in rare]))
        near = near[~asked[near] & (100 * np.minimum(sizes[near], n) >= percent * np.maximum(sizes[near], n))]
        if not len(near):
            continue
        mark[own] = True
        for y in near.tolist():
            a, b = root(x), root(y)
            if a == b:
                continue
            both = int(mark[inverse[bounds[y] : bounds[y + 1]]].sum())
            if 100 * both >= percent * (n + int(sizes[y]) - both):
                parent[max(a, b)] = min(a, b)
                found.append((x, y))
        mark[own] = False
    return found


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the links inside each (clump, block); if some rows are queries, of those with a query."""
    import zstandard

    from .shingles import shingle_set

    unpack = zstandard.ZstdDecompressor().decompress

    def edges():
        for _, (nodes, queries, texts) in grouped(batches, 2):
            at: dict[int, int] = {}
            for i, node in enumerate(nodes):
                if node not in at or queries[i]:
                    at[node] = i
            rows = list(at.values())
            tested = [k for k, i in enumerate(rows) if queries[i]]
            if len(rows) < 2:
                continue
            sets = [shingle_set(unpack(texts[i])) for i in rows]
            yield from stars((nodes[rows[a]], nodes[rows[b]]) for a, b in linked(sets, tested or None))

    yield from _batched(edges())


def _links(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """Links confirmed for ``placed`` (clump, block, node, query), with texts by node."""
    met = placed.join(texts, "node").select("clump", "block", "node", "query", "packed")
    return met.repartition("clump", "block").sortWithinPartitions("clump", "block").mapInArrow(_confirmed, "u long, v long")


def _clumps(classes: DataFrame, scratch: Scratch, bucket: int) -> DataFrame:
    """(node, clump) for classes that may be linked with another."""
    keys = classes.select("node", "sign").mapInArrow(_keys, "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    members = scratch.keep(keys.join(shared, "key"), "members")
    small = members.where(F.col("n") <= bucket).join(classes.select("node", "sign"), "node").select("key", "node", "sign")
    near = small.repartition("key").sortWithinPartitions("key").mapInArrow(_near, "u long, v long")
    whole = members.where(F.col("n") > bucket).select(F.col("least").alias("u"), F.col("node").alias("v"))
    found = components(near.union(whole), scratch, "clumps").withColumnRenamed("root", "clump")
    return scratch.keep(found, "clumped")


def _roots(docs: DataFrame, classes: DataFrame, clumps: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """(node, root) of the classes that links connect with others."""
    sized = clumps.groupBy("clump").agg(F.ceil(F.count("*") / block).alias("blocks"))
    home = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = scratch.keep(clumps.join(sized, "clump").withColumn("block", home).withColumn("query", F.lit(False)), "placed")
    names = placed.select("node").join(classes.select("node", "class"), "node")
    packed = docs.mapInArrow(_texts, "class binary, packed binary")
    texts = packed.join(names, "class").groupBy("node").agg(F.first("packed").alias("packed"))
    texts = scratch.keep(texts, "texts")
    several = placed.where("blocks > 1")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    first = [F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"l{i}") for i in range(LEADERS)]
    leaders = several.groupBy("clump", "blocks").agg(F.array_distinct(F.array(*first)).alias("all")).withColumn("block", everywhere)
    leaders = leaders.select(F.explode("all").alias("node"), "clump", "block", F.lit(False).alias("query"))
    columns = ["clump", "block", "node", "query"]
    links = scratch.keep(_links(texts, placed.select(columns).union(leaders.select(columns))), "links")
    parts = components(links, scratch, "parts")
    if several.isEmpty():
        return parts
    several = several.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main = several.groupBy("clump", "root").agg(F.count("*").alias("n")).groupBy("clump").agg(F.max_by("root", "n").alias("main"))
    outside = scratch.keep(several.join(main, "clump").where("root <> main").select("clump", "blocks", "node"), "outside")
    batches = outside.groupBy("clump").agg(F.ceil(F.count("*") / block).alias("batches"))
    one = F.pmod(F.xxhash64("node", F.lit("batch")), F.col("batches"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1))
    place = (F.col("block") * F.col("batches") + F.col("batch")).alias("block")
    asked = outside.withColumn("block", everywhere).join(batches, "clump").withColumn("batch", one)
    met = placed.where("blocks > 1").select(columns).join(batches, "clump").withColumn("batch", each)
    rest = _links(texts, met.select("clump", place, "node", "query").union(asked.select("clump", place, "node", F.lit(True).alias("query"))))
    rest = scratch.keep(rest, "rest")
    if rest.isEmpty():
        return parts
    return components(rest.union(parts.where("node <> root").select("root", "node")), scratch, "groups")


def _decided(df: DataFrame, id_col: str, text_col: str, bucket: int, block: int, **carry: Column) -> DataFrame:
    """One row for each row of ``df``: id, n_shingles, component_id, kept, and the binary columns ``carry``."""
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "minhash")
    kind = df.schema[id_col].dataType
    docs = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    rows = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"), *[c.alias(n) for n, c in carry.items()])
    schema = f"id {kind.simpleString()}, n long, class binary, sign binary" + "".join(f", {n} binary" for n in carry)
    signed = scratch.keep(rows.mapInArrow(_signed([*carry]), schema), "signed")
    classes = (
        signed.where("class is not null")
        .groupBy("class")
        .agg(F.min("id").alias("least"), F.count("*").alias("docs"), F.first("sign").alias("sign"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = scratch.keep(classes, "classes")
    roots = _roots(docs.select("text"), classes, _clumps(classes, scratch, bucket), scratch, block)
    grouped_classes = classes.join(roots, "node", "left").where("root is not null or docs > 1")
    grouped_classes = grouped_classes.select("class", "least", F.coalesce("root", "node").alias("root"))
    smallest = grouped_classes.groupBy("root").agg(F.min("least").alias("component"))
    named = scratch.keep(grouped_classes.join(smallest, "root").select("class", "component"), "named")
    out = signed.select("id", "n", "class", *carry).join(named, "class", "left")
    component = F.coalesce("component", "id")
    return out.select(
        "id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"), *carry
    )


def near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, block: int = BLOCK
) -> DataFrame:
    """One row for each row of ``df``: id_col, n_shingles, component_id, kept."""
    out = _decided(df, id_col, text_col, bucket, block)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def drop_near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, block: int = BLOCK
) -> DataFrame:
    """The rows of ``df`` that stay: those with the smallest id of their component.

    Rows go by id and text, since rows may share an id, or have none, with different texts.
    """
    gone, digest = free_name(df, "_gone"), free_name(df, "_digest")
    own = F.unhex(F.md5(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).cast("binary")))
    decided = _decided(df, id_col, text_col, bucket, block, text_digest=own)
    dropped = decided.where("not kept").select(F.col("id").alias(gone), F.col("text_digest").alias(digest)).distinct()
    return df.join(dropped, F.col(quoted(id_col)).eqNullSafe(F.col(gone)) & (own == F.col(digest)), "left_anti")

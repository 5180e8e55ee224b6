"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one document: words, their characters, symbols, duplicate
lines, and words inside three-word windows that occur twice or more.  The
cross-document rule hashes each normalised line (lower case, trimmed, white
space collapsed), counts the distinct documents of a host that contain it, and
removes lines above both limits: more than ``max_docs`` documents, and more than
``max_share`` of the host's documents.  A document that loses more than
``depleted`` of its words is rejected.

Documents are told apart by id (``by_content=True``: by their lines, so that the
copies of a document count once).  Counting is by (host, line, document),
aggregated map-side before each of its two shuffles; the limits bound a host's removed lines by the lines of an average document divided
by ``max_share``, so they travel as one array for each host.

Repeated windows: each window becomes one long, its hash with the low bits
replaced by its position; sorting these brings equal windows together, and the
words of neighbours are compared before they count.  That is O(n log n) in a
text's words and needs no shuffle.

Defined results: a null or empty text has no words and fails the base rules; a
null host is a host of its own; repeated rows get the same verdict and count
once; rows without id count once for each content; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, Scratch, free_name, quoted, whole_text
from .line_dedup import has_word, line_key

MAX_DOCS = 20
MAX_SHARE = 0.02
DEPLETED = 0.5
MIN_WORDS = 50
SYMBOLS = r"[#*$%&|<>]"


def words_of(trimmed: Column) -> Column:
    """Words of a text without white space at its ends."""
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def word_count(text: Column) -> Column:
    return F.size(words_of(F.btrim(text, F.lit(SPACE_CHARS)))).cast("long")


def _repeated(words: Column, windows: Column, modulus: Column) -> Column:
    """Sorted start positions of the three-word windows found twice or more."""
    after = F.slice(windows, 2, F.size(windows))

    def same(a: Column, b: Column) -> Column:
        i, j = F.pmod(a, modulus).cast("int"), F.pmod(b, modulus).cast("int")
        equal = F.lit(True)
        for k in range(3):
            equal = equal & (F.get(words, i + k) == F.get(words, j + k))
        return F.when((a - F.pmod(a, modulus) == b - F.pmod(b, modulus)) & equal, F.array(i, j))

    pairs = F.filter(F.zip_with(windows, after, same), lambda x: x.isNotNull())
    return F.sort_array(F.array_distinct(F.flatten(pairs)))


def _covered(starts: Column) -> Column:
    """Words covered by three-word windows that begin at ``starts``."""
    steps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def base_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with a struct column of counts; its name is the last column's."""
    name = free_name(df, "_base")
    text, trimmed, words, hashes, modulus, windows, starts = (free_name(df, f"{name}{i}") for i in range(7))
    step = df.withColumn(text, whole_text(text_col)).withColumn(trimmed, F.btrim(F.col(text), F.lit(SPACE_CHARS)))
    step = step.withColumn(words, words_of(F.col(trimmed)))
    step = step.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    step = step.withColumn(modulus, F.pow(F.lit(2.0), F.ceil(F.log2(F.size(words) + 2.0))).cast("long"))
    h, m = F.col(hashes), F.col(modulus)

    def window(i: Column) -> Column:
        x = F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))
        return x - F.pmod(x, m) + i

    none = F.array().cast("array<bigint>")
    spans = F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)
    step = step.withColumn(windows, F.when(F.size(words) >= 3, F.sort_array(spans)).otherwise(none))
    step = step.withColumn(starts, _repeated(F.col(words), F.col(windows), m))
    lines = F.filter(F.split(F.col(text), "\n"), has_word)
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col(text), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.size(starts) > 0, _covered(F.col(starts))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    return step.withColumn(name, counts).select(*[quoted(c) for c in df.columns], name)


def frequent_lines(docs: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """(host, keys): hashes of the lines above both limits in a host, of rows (host, doc, keys)."""
    totals = docs.where(F.size("keys") > 0).groupBy("host").agg(F.countDistinct("doc").alias("docs"))
    lines = docs.select("host", "doc", F.explode("keys").alias("key"))
    counted = lines.groupBy("host", "key").agg(F.countDistinct("doc").alias("n"))
    above = counted.where(F.col("n") > max_docs).join(
        totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))
    )
    return above.where(F.col("n") > F.col("docs") * max_share).groupBy("host").agg(F.collect_set("key").alias("keys"))


def judged(
    df: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    max_docs: int = MAX_DOCS,
    max_share: float = MAX_SHARE,
    depleted: float = DEPLETED,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    by_content: bool = False,
    carry: list[str] | None = None,
) -> tuple[DataFrame, str]:
    """The columns ``carry`` of ``df`` (all by default) with a struct column, and that column's name.

    The struct has n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_removed_words, base_failed, depleted, kept, and ``frequent``,
    the hashes of the host's removed lines, for ``clean_text``.  Counts and line
    hashes are written once, so texts are read once.
    """
    scratch = Scratch(df.sparkSession, "quality")
    carried = df.columns if carry is None else carry
    verdict, lines_name, host_name, id_name = (free_name(df, x) for x in ("_verdict", "_lines", "_of", "_id"))
    lines = F.transform(
        F.filter(F.split(whole_text(text_col), "\n"), has_word),
        lambda x: F.struct(line_key(x).alias("key"), word_count(x).alias("words")),
    )
    step = df.withColumn(lines_name, lines).withColumn(host_name, F.col(quoted(host_col)))
    step = step.withColumn(id_name, F.lit(None).cast("long") if by_content else F.xxhash64(F.col(quoted(id_col))))
    if not by_content:
        step = step.withColumn(id_name, F.when(F.col(quoted(id_col)).isNotNull(), F.col(id_name)))
    step = base_counts(step, text_col)
    base = step.columns[-1]
    step = scratch.keep(step.select(*[quoted(c) for c in carried], lines_name, host_name, id_name, base), "counted")
    keys = F.array_distinct(F.transform(F.col(lines_name), lambda x: x["key"]))
    rows = step.select(F.col(host_name).alias("host"), F.col(id_name).alias("id"), keys.alias("keys"))
    rows = rows.select("host", F.coalesce("id", F.xxhash64("keys")).alias("doc"), "keys")
    found = scratch.keep(frequent_lines(rows, max_docs, max_share), "frequent")
    of, keys = free_name(step, "_host"), free_name(step, "_keys")
    step = step.join(found.select(F.col("host").alias(of), F.col("keys").alias(keys)), F.col(host_name).eqNullSafe(F.col(of)), "left")
    gone = F.filter(lines_name, lambda x: F.array_contains(F.col(keys), x["key"]))
    removed = F.when(F.col(keys).isNull(), F.lit(0).cast("long")).otherwise(
        F.aggregate(gone, F.lit(0).cast("long"), lambda total, x: total + x["words"])
    )
    step = step.withColumn(lines_name, removed)
    n, repeat, removed = F.col(base)["n_words"], F.col(base)["n_repeat_words"], F.col(lines_name)
    failed = (n < min_words) | (100 * repeat > 50 * n)
    empty = removed > n * depleted
    parts = [F.col(base)[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")]
    out = F.struct(
        *parts,
        removed.alias("n_removed_words"),
        failed.alias("base_failed"),
        empty.alias("depleted"),
        (~failed & ~empty).alias("kept"),
        F.col(keys).alias("frequent"),
    )
    return step.withColumn(verdict, out).select(*[quoted(c) for c in carried], verdict), verdict


def clean_text(text_col: str, frequent: Column) -> Column:
    """The text without the lines whose hashes are in ``frequent`` (null: none)."""
    text = whole_text(text_col)
    rest = F.filter(F.split(text, "\n"), lambda x: ~(has_word(x) & F.array_contains(frequent, line_key(x))))
    return F.when(frequent.isNull(), text).otherwise(F.array_join(rest, "\n"))


def keep_good(df: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """The rows that pass, with the columns of ``df``; their texts without the removed lines."""
    out, verdict = judged(df, text_col=text_col, **rules)
    v = F.col(verdict)
    text = F.when(v["n_removed_words"] > 0, clean_text(text_col, v["frequent"])).otherwise(F.col(quoted(text_col)))
    return out.where(v["kept"]).select(*[text.alias(c) if c == text_col else quoted(c) for c in df.columns])

"""Quality rules with cross-document line frequency, in SQL functions only.

Lines are normalised and hashed, the distinct documents of a host that hold
each are counted, lines above the limit are removed and documents that lose
too much are rejected. The text is read once: counts and line hashes go to a
narrow table from which the frequencies and the verdicts are made. A line's
rows are summed before they are shuffled, so a line that a third of all
documents share is one row per task; the join back to documents is a plain
equi-join, which Spark splits or broadcasts as sizes turn out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD_GAP, Scratch

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line in more documents of a host than this is removed.
MAX_DOCS_PER_HOST = 10
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.5


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.when(i + 1 < F.size(at), F.least(F.lit(3), F.get(at, i + 1) - p)).otherwise(F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def twice(sorted_: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(sorted_, i)["h"] == F.get(sorted_, j)["h"], F.lit(False))
        kept = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return let(F.sort_array(F.transform(kept, lambda i: sorted_[i]["i"])), covered)

    def count(h: Column) -> Column:
        sort = lambda: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(sort(), twice))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(let(words, windows), count))


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col("_text"), F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    hashed = F.transform(
        F.col("_lines"),
        lambda x: let(F.split(F.lower(F.btrim(x, F.lit(BLANKS))), WORD_GAP), lambda w: F.struct(F.xxhash64(F.array_join(w, " ")).alias("h"), F.size(w).alias("n"))),
    )
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
        .withColumn("_words", word_array(F.col("_text")))
        .withColumn("_lines", worded)
        .select(
            "_id",
            "_host",
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
            hashed.alias("_hashed"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )


def frequent_lines(measured: DataFrame, max_docs: int) -> DataFrame:
    """(_host, h, n_docs) of the lines in more than max_docs documents of a host."""
    lines = measured.select("_host", F.explode(F.array_distinct(F.transform("_hashed", lambda x: x["h"]))).alias("h"))
    return lines.groupBy("_host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS_PER_HOST, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per row of docs: the base counts, base_failed, n_lines_removed,
    n_words_left, kept, and removed_lines, the hashes of its lines above the
    limit (see :func:`without_lines`).

    Lines are compared in lower case with single spaces; blank lines are not
    counted. Every row is a document of its own, repeated ids included; a null
    host is a host, a null id is an id. Null, empty and blank texts have no
    words and fail the base rules. An empty table gives an empty result; other
    columns, whatever their names, are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    base = scratch.cut(_measured(docs, id_col, text_col, host_col))
    often = frequent_lines(base, max_docs).withColumnsRenamed({"_host": "_h"}).select("_h", "h")
    lines = base.select("_row", "_host", F.explode(F.array_distinct(F.transform("_hashed", lambda x: x["h"]))).alias("_l"))
    hits = lines.join(often, F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_l") == F.col("h")), "left_semi")
    hits = hits.groupBy("_row").agg(F.collect_set("_l").alias("removed_lines"))
    none = F.array().cast("array<bigint>")
    joined = base.join(hits, "_row", "left").withColumn("removed_lines", F.coalesce("removed_lines", none))
    gone = F.filter("_hashed", lambda x: F.array_contains(F.col("removed_lines"), x["h"]))
    left = F.col("n_words") - F.aggregate(F.col("_gone"), F.lit(0), lambda a, x: a + x["n"])
    return (
        joined.withColumn("_gone", gone)
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .withColumn("n_words_left", left.cast("long"))
        .select(
            F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & (F.col("n_words_left") >= min_left * F.col("n_words"))).alias("kept"),
            F.size("_gone").cast("long").alias("n_lines_removed"), "n_words_left", "removed_lines",
        )
    )


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hashes are in removed."""
    key = lambda x: F.xxhash64(F.array_join(F.split(F.lower(F.btrim(x, F.lit(BLANKS))), WORD_GAP), " "))
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed, key(x))), "\n")


#: DuckDB SQL of op5: lines compared by their text instead of its hash.
LINE_QUALITY_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM g),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i FROM r WHERE c > 1), (VALUES (0), (1), (2)) AS s(k) GROUP BY rid),
m AS (SELECT rid, source, lower(array_to_string(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> ''), ' ')) AS k,
             len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '')) AS n
      FROM (SELECT rid, source, unnest(l) AS x FROM d)),
f AS (SELECT source, k FROM m GROUP BY source, k HAVING count(DISTINCT rid) > {MAX_DOCS_PER_HOST}),
h AS (SELECT rid, count(*) AS lines, sum(n) AS words FROM m JOIN f ON m.source IS NOT DISTINCT FROM f.source AND m.k = f.k GROUP BY rid),
b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         coalesce(h.lines, 0)::BIGINT AS n_lines_removed, (len(w) - coalesce(h.words, 0))::BIGINT AS n_words_left
  FROM d LEFT JOIN c USING (rid) LEFT JOIN h USING (rid)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words_left >= {MIN_LEFT} * n_words AS kept, n_lines_removed, n_words_left
FROM v
"""

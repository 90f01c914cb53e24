"""Quality rules by cross-document line frequency.

Lines are normalised (lower case, digits as 0, white space folded) and hashed.
Per host, the documents that hold a line are counted; a line above the limit
(more than `floor` documents and more than `share` of the host's) is removed,
and a document that loses more than half of its words is rejected. Per-document
figures come from array expressions, so only line hashes and small rows are
shuffled; partial counts are formed before.

Edge cases: a null or empty text has no words, lines or hashes and fails the
base rule; a null host is a host of its own; repeated rows are documents of
their own; other columns of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm._session import cut

SHARE = 0.005
FLOOR = 20
BLANKS = r"[\x20\x09-\x0D]+"


def bound(value: Column, body) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def word_list(text: Column) -> Column:
    core = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(core) > 0, F.split(core, BLANKS)).otherwise(F.array().cast("array<string>"))


def line_list(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), BLANKS, " ")))


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the list has twice or more."""

    def positions(sorted_windows: Column) -> Column:
        def alike(x: Column, j: Column) -> Column:
            before = (j > 0) & (F.get(sorted_windows, j - 1)["h"] == x["h"])
            after = F.coalesce(F.get(sorted_windows, j + 1)["h"] == x["h"], F.lit(False))
            return F.when(before | after, x["i"])

        return F.sort_array(F.array_compact(F.transform(sorted_windows, alike)))

    def reach(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(bound(F.sort_array(windows), lambda s: bound(positions(s), reach)))


def measured(docs: DataFrame, id_column: str, text: str, host: str) -> DataFrame:
    """Figures of each document by itself, and its lines' hashes and word counts; written once, so texts are read once."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = bound(
        word_list(body),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words")),
    )

    def of_lines(x: Column) -> Column:
        dups = (F.size(x) - F.size(F.array_distinct(x))).cast("long")
        each = F.transform(x, lambda line: F.struct(line_hash(line).alias("line"), F.size(word_list(line)).alias("words")))
        return F.struct(dups.alias("n_dup_lines"), each.alias("lines"))

    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.xxhash64(body).alias("h"),
        F.col(host).cast("string").alias("host"),
        words.alias("w"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bound(line_list(body), of_lines).alias("x"),
    )
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "h", "host", "w.*", "n_symbols", "x.*"))


def boilerplate(rows: DataFrame, share: float, floor: int) -> DataFrame:
    """host, line, line_docs: hashes of lines above the limit, and how many documents of the host have them."""
    hosts = rows.groupBy(F.col("host").alias("host_")).agg(F.count(F.lit(1)).alias("host_docs"))
    lines = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    found = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("line_docs")).where(F.col("line_docs") > floor)
    found = found.join(hosts, F.col("host").eqNullSafe(F.col("host_"))).drop("host_")
    return found.where(F.col("line_docs") > F.col("host_docs") * share).select("host", "line", "line_docs")


def lost_lines(rows: DataFrame, share: float, floor: int) -> DataFrame:
    """row_, lost, gone: words and hashes of the lines that each row loses."""
    hot = boilerplate(rows, share, floor).select(F.col("host").alias("hot_host"), F.col("line").alias("hot_line"))
    lines = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.*")
    lost = lines.join(hot, (F.col("line") == F.col("hot_line")) & F.col("host").eqNullSafe(F.col("hot_host")))
    return lost.groupBy(F.col("row").alias("row_")).agg(F.sum("words").alias("lost"), F.collect_set("line").alias("gone"))


def verdicts(rows: DataFrame, share: float, floor: int) -> DataFrame:
    """The measured rows with lost, gone, base_failed and kept."""
    out = rows.drop("lines").join(lost_lines(rows, share, floor), F.col("row") == F.col("row_"), "left")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    removed = F.coalesce(F.col("lost"), F.lit(0)).cast("long")
    return out.withColumns({"base_failed": failed, "n_removed_words": removed, "kept": ~failed & (removed * 2 <= F.col("n_words"))})


def judged(docs: DataFrame, share: float = SHARE, floor: int = FLOOR, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Base figures, words in removed lines, and the verdict on every document."""
    out = verdicts(measured(docs, id_column, text, host), share, floor)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


def clean(docs: DataFrame, share: float = SHARE, floor: int = FLOOR, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """id and text of the documents that are kept, without the lines above the limit."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kept = verdicts(measured(docs, id_column, text, host), share, floor).where("kept").select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("host").alias("o"), "gone").dropDuplicates(["d", "g", "o"])
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(host).cast("string").alias("host"), body.alias("text"), F.xxhash64(body).alias("h"))
    out = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & F.col("host").eqNullSafe(F.col("o")))
    left = F.filter(F.split("text", "\n", -1), lambda x: ~F.coalesce(F.array_contains(F.col("gone"), line_hash(x)), F.lit(False)))
    return out.select(F.col("doc_id").alias(id_column), F.array_join(left, "\n").alias(text))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT doc_id, source, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
p AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t) WHERE n > 1),
r AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM p) GROUP BY doc_id),
x AS (SELECT doc_id, source, unnest(lines) AS line FROM b),
y AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM x),
h AS (SELECT source, count(*) AS host_docs FROM documents GROUP BY source),
f AS (SELECT y.source, line FROM y JOIN h ON y.source IS NOT DISTINCT FROM h.source GROUP BY y.source, line, host_docs
      HAVING count(DISTINCT doc_id) > {FLOOR} AND count(DISTINCT doc_id) > host_docs * {SHARE}),
l AS (SELECT doc_id, sum(words) AS lost FROM y JOIN f ON y.line = f.line AND y.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
o AS (SELECT b.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed_words
      FROM b LEFT JOIN r ON b.doc_id = r.doc_id LEFT JOIN l ON b.doc_id = l.doc_id),
v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM o)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, n_removed_words, (NOT base_failed AND 2 * n_removed_words <= n_words) AS kept FROM v
"""

"""Line dedup by overlapping windows of three lines.

Lines (compared without spaces and tabs at either end) are hashed by threes, at every line; windows of blank lines
alone don't count. A window that occurs again anywhere keeps its first occurrence, by document id, then line; the lines
that later occurrences cover, merged, are removed from their documents. Windows travel as two 64-bit hashes, an id and a
line number; occurrences are counted before the shuffle, and only repeated windows are joined back, those of very many
occurrences by broadcast.

With ``short``, as in the query, a document of fewer lines than the window, if not blank, is one window of all its lines, which
equals that of another such document of the same lines. Without it such documents have no window and stay whole, even as copies
of one another.

Null texts stay null; null ids come last; rows that have the first occurrence's id and line keep it together (repeated
rows). An empty table gives an empty result; further columns stay, those named n_lines or n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, unused, written

_LAST = 2**63 - 1


def _lines(text_col: str) -> Column:
    return F.split(F.col(text_col), "\n", -1)


def windows(docs: DataFrame, width: int, id_col: str, text_col: str, short: bool = False) -> DataFrame:
    """id, text hash, line number and window hash of every window; with ``short`` also the number of its last line."""
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(_LAST)).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), _lines(text_col).alias("_l"))
    rows = rows.filter(F.size("_l") >= (1 if short else width)).select("id", "th", F.transform("_l", lambda x: F.trim(F.translate(x, "\t\r", "  "))).alias("_l"))

    def at(i: Column) -> Column:
        part = [F.get(F.col("_l"), i + k) for k in range(width)]  # lines that a short document lacks are null, and add nothing to a hash
        filled = F.length(F.concat_ws("", *part)) > 0
        return F.when(filled, F.struct(F.xxhash64(*part).alias("a"), F.xxhash64(F.lit(1), *reversed(part)).alias("b")))

    n = F.size("_l")
    every = rows.select("id", "th", n.alias("_n"), F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), at)).alias("line", "w"))
    last = [(F.least(F.col("line") + width, "_n") - 1).cast("long").alias("last")] if short else []
    return every.filter(F.col("w").isNotNull()).select("id", "th", F.col("line").cast("long").alias("line"), *last, "w.a", "w.b")


def covered_lines(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """id, text hash and the sorted numbers of lines to remove, of the documents that lose any."""
    found = written(windows(docs, width, id_col, text_col, short), "every-window")
    # A count in each task first, so a window that every document holds is one row a task here.
    repeated = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "line")).alias("first")).filter("n > 1")
    again = join_hot(found, written(repeated, "windows"), ["a", "b"], "n", found.count()).filter(F.struct("id", "line") != F.col("first"))
    last = F.col("last") if short else F.col("line") + (width - 1)
    lines = again.select("id", "th", F.explode(F.sequence(F.col("line"), last)).alias("line"))
    return written(lines.groupBy("id", "th").agg(F.sort_array(F.collect_set("line")).alias("removed")), "covered")


def line_dedup(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 64 << 20,
               short: bool = False) -> DataFrame:
    """``docs`` with its columns, the text without the removed lines, n_lines (before) and n_removed.

    Lines to remove are broadcast up to ``broadcast_bytes`` (8 for a line, 200 more for a document and its place in a hash
    table), so texts stay where they are; more are joined by a shuffle."""
    docs = docs.drop("n_lines", "n_removed")
    own, th, removed = unused(docs.columns, "id", "th", "removed")
    cover = covered_lines(docs, width, id_col, text_col, short).withColumnsRenamed({"id": own, "th": th, "removed": removed})
    held = cover.agg(F.coalesce(F.sum(F.size(removed) * 8 + 200), F.lit(0))).first()[0]
    joined = docs.join(F.broadcast(cover) if held <= broadcast_bytes else cover, (F.coalesce(F.col(id_col), F.lit(_LAST)) == F.col(own)) & (F.xxhash64(text_col) == F.col(th)), "left")
    lines = _lines(text_col)
    keep = F.array_except(F.sequence(F.lit(0).cast("long"), (F.size(lines) - 1).cast("long")), F.col(removed))
    cleaned = F.array_join(F.transform(keep, lambda i: F.get(lines, i.cast("int"))), "\n")
    n = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    return joined.select(
        *[F.when(F.col(removed).isNull(), F.col(c)).otherwise(cleaned).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        n.alias("n_lines"), F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("n_removed"),
    )


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs, short=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


ORACLE = {
    "op9_line_dedup": r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS raw FROM documents),
t AS (SELECT doc_id, list_transform(raw, lambda x: trim(translate(x, chr(9) || chr(13), '  '))) AS ln, raw FROM l),
w AS (SELECT doc_id, i - 1 AS line, ln[i] AS x, ln[i + 1] AS y, ln[i + 2] AS z
      FROM (SELECT doc_id, ln, unnest(range(1, greatest(len(ln) - 1, 2))) AS i FROM t) WHERE len(ln[i] || coalesce(ln[i + 1], '') || coalesce(ln[i + 2], '')) > 0),
o AS (SELECT doc_id, line, z, y, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, line) AS k FROM w),
r AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(line, line + 1 + CAST(y IS NOT NULL AS INT) + CAST(z IS NOT NULL AS INT))) AS p FROM o WHERE k > 1) GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(raw), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(raw)), lambda i: NOT list_contains(gone, i)), lambda i: raw[i + 1]), chr(10)) END, '')) AS text_sha256
FROM l LEFT JOIN r USING (doc_id)
"""
}

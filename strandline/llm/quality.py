"""Quality rules from counts of each document and from line frequency across documents.

DataFrame operations only. A line is a part between line feeds that has a word. It is normalised (lower
case, white space collapsed and trimmed) and hashed; the documents of its host that have it are counted
over the whole table. A line in more than ``max_docs`` documents of one host is repeated matter: the
document of smallest id keeps it, all others lose it, so a group of copies keeps one whole copy. A
document that loses more than ``max_lost`` percent of its words is depleted and rejected.

Null text has no words (so it fails the base rules); a null host or id is a value like others, but the smallest id is
never null; rows that repeat an id are one document to the count, and each loses and keeps lines like a document of its own;
rows that agree in id and text share one verdict. Lines of equal count have no order: all above the limit go. A very
long text is one row's arrays of words and lines. An empty table gives no rows. Extra columns pass by unused, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACE, stored, table, unused

MAX_DOCS, MAX_LOST = 10, 70
MIN_WORDS, MAX_REPEAT = 50, 50
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def lines_of(text: Column) -> Column:
    """array<struct<pos, h, words>> of the lines that have a word."""
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), f"[{SPACE}]+", " "))
    rows = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), plain(x).alias("line")))
    full = F.filter(rows, lambda r: r["line"] != "")
    return F.transform(full, lambda r: F.struct(r["pos"].alias("pos"), F.xxhash64(r["line"]).alias("h"), F.size(F.split(r["line"], " ")).cast("long").alias("words")))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text_key and the base counts of every row; n_repeat_words covers words in repeated 3-word windows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), *keep)
    w = F.col("_w")
    d = d.select("doc_id", *keep, F.xxhash64("_text").alias("text_key"), words_of(F.col("_text")).alias("_w"), (F.length("_text") - F.length(F.translate(F.col("_text"), SYMBOLS, ""))).cast("long").alias("n_symbols"), F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("_lines"), F.length(F.regexp_replace("_text", f"[{SPACE}]+", "")).cast("long").alias("word_chars"))
    grams = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>"))
    d = d.select("doc_id", *keep, "text_key", "n_symbols", "word_chars", F.size("_w").cast("long").alias("n_words"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), grams.alias("_g"))
    g, s, p = F.col("_g"), F.col("_s"), F.col("_p")
    d = d.withColumn("_s", F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"]))
    d = d.withColumn("_p", F.when(s.isNotNull(), F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))))
    gaps = F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(F.lit(3), b - a))
    d = d.withColumn("n_repeat_words", F.coalesce(F.when(F.size(p) > 0, F.aggregate(gaps, F.lit(3), lambda a, x: a + x)), F.lit(0)).cast("long"))
    return d.drop("_g", "_s", "_p")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, text_key, lost array<struct<pos, words>>: the lines that each document loses.

    Lines are first made distinct by host and document, which spreads a line in every document over all tasks; the
    count is then combined before its shuffle. The lines meet the counts in a join that Spark can split at a hot line.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.xxhash64(text).alias("text_key"), lines_of(text).alias("_lines"))
    once = d.select("doc_id", "host", F.explode(F.array_distinct(F.transform("_lines", lambda r: r["h"]))).alias("h")).distinct()
    hot = once.groupBy("host", "h").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).filter(F.col("n_docs") > max_docs).select(F.col("host").alias("_host"), F.col("h").alias("_h"), "first_doc")
    every = d.select("doc_id", "host", "text_key", F.explode("_lines").alias("r")).select("doc_id", "host", "text_key", "r.*")
    found = every.join(hot, (F.col("h") == F.col("_h")) & F.col("host").eqNullSafe(F.col("_host")) & ~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    return found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("pos", "words")).alias("lost"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST, lost: DataFrame | None = None) -> DataFrame:
    """Every row's counts, the words it loses to repeated lines, base_failed and kept.

    Write the result before filtering it: a filter on it would be pushed into the counts and repeat them for each word.
    """
    lost = lost if lost is not None else repeated_lines(docs, id_col, text_col, host_col, max_docs)
    lost = lost.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.aggregate("lost", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("_lost"))
    d = counts(docs, id_col, text_col)
    d = d.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    d = d.withColumn("lost_words", F.coalesce("_lost", F.lit(0).cast("long"))).withColumn("base_failed", failed)
    return d.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_words") <= max_lost * F.col("n_words"))).drop("_id", "_key", "_lost")


def cleaned(docs: DataFrame, max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST) -> DataFrame:
    """The kept documents, all columns, without the repeated lines; n_chars follows the text where there is one."""
    lines = stored(repeated_lines(docs, max_docs=max_docs))
    v = stored(verdicts(docs, max_docs=max_docs, max_lost=max_lost, lost=lines).select("doc_id", "text_key", "kept"))
    at, key, own, pos, at2, key2 = unused(docs, "_id", "_key", "_own", "_pos", "_id2", "_key2")
    v = v.filter("kept").select(F.col("doc_id").alias(at), F.col("text_key").alias(key)).distinct()
    lost = lines.select(F.col("doc_id").alias(at2), F.col("text_key").alias(key2), F.transform("lost", lambda x: x["pos"]).alias(pos))
    v = v.join(lost, F.col(at).eqNullSafe(F.col(at2)) & (F.col(key) == F.col(key2)), "left").select(at, key, pos)
    d = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    d = d.join(v, F.col("doc_id").eqNullSafe(F.col(at)) & (F.col(own) == F.col(key)))
    text = F.when(F.col(pos).isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(pos), i)), "\n"))
    d = d.withColumn("text", text)
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*(f"`{c}`" for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


#: n_repeat_words: positions within two words after the start of a window that occurs again.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, row(w[i], w[i+1], w[i+2]) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM r) GROUP BY doc_id),
ln AS (SELECT doc_id, source, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM (SELECT doc_id, source, unnest(l) AS x FROM w)),
hot AS (SELECT source, line, min(doc_id) AS first_doc FROM ln GROUP BY ALL HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) > 10),
lost AS (SELECT ln.doc_id, sum(len(string_split(ln.line, ' '))) AS n FROM ln JOIN hot ON ln.source IS NOT DISTINCT FROM hot.source AND ln.line = hot.line WHERE ln.doc_id IS DISTINCT FROM hot.first_doc GROUP BY ALL),
a AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS lost_words
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_words <= 70 * n_words AS kept FROM a
"""

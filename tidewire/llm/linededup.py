"""Removal of passages that repeat within and across documents, in DataFrame functions only.

Winnowing over line hashes.

1. Select. The winnowing window at a line is the shortest run of lines from there on that holds `min_words` words. Of
   each window the rightmost smallest line hash is selected; neighbouring windows mostly select the same line, so only
   some lines become fingerprints, and any repeated run of `min_words` words holds one that is selected in both places.
2. Join positions. Fingerprints are counted over all selected positions. Those at a single position drop out here, and
   with them nearly all of the text; only windows around the others go on.
3. Extend. Around a position a match is extended backwards by the windows that start before it and forwards, line by
   line, past the end of each window until the next window takes over (fewer than `min_words` words). Every extension is
   compared, by a second hash of its lines, with the first place (smallest doc_id, then line) that has the same fingerprint
   and lines; so a run is found whatever other runs share its fingerprint, and no pair of places is enumerated.
4. Delete. All lines of runs that aren't the first go.

A document's lines are the parts of its text between \n characters. Lines without a word take part in
no window and stay. Two runs of the same document match only where they don't overlap. Fingerprint and
lines are hashed independently, so a match rests on 128 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words that a repeated run must have to be removed.
MIN_WORDS = 50


DOC = ["doc_id", "copy"]


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, copy (a hash of the text), line (from 0), words and two hashes of each line that has a word.

    Rows that repeat both doc_id and text give their lines once."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    lines = lines.select(*DOC, "line", F.regexp_count("content", F.lit(r"\S+")).alias("words"), F.xxhash64("content").alias("h1"), F.xxhash64(F.lit(1), "content").alias("h2")).where("words > 0")
    again = Window.partitionBy(*DOC, "line").orderBy("h1")
    return lines.repartition(*DOC).withColumn("again", F.row_number().over(again)).where("again = 1").drop("again")


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Whole windows by the line they start at: doc_id, copy, first, the selected fingerprint, whether its position is
    selected here for the first time, and runs (last, k: hash of the lines): the window and its extensions by a line each."""
    by_doc = Window.partitionBy(*DOC).orderBy("line")
    placed = lines.withColumn("until", F.sum("words").over(by_doc.rowsBetween(Window.unboundedPreceding, 0))).withColumn("since", F.col("until") - F.col("words"))
    ahead = Window.partitionBy(*DOC).orderBy("since").rangeBetween(0, min_words - 1)
    # extensions end where the lines after the first one reach min_words: from there on the next window holds them
    beyond = Window.partitionBy(*DOC).orderBy("until").rangeBetween(0, min_words - 1)
    least = F.min(F.struct("h1", (-F.col("line")).alias("at"))).over(ahead)
    found = placed.select(
        *DOC, F.col("line").alias("first"), "since", least.alias("least"), F.sum("words").over(ahead).alias("n"), F.count("*").over(ahead).alias("size"),
        F.collect_list(F.struct("line", "h2")).over(ahead).alias("inside"), F.collect_list(F.struct("line", "h2")).over(beyond).alias("through"),
    ).where(F.col("n") >= min_words)
    # both lists begin at the window's first line: the longer one holds the other
    found = found.withColumn("lines", F.when(F.size("through") > F.col("size"), F.col("through")).otherwise(F.col("inside")))
    ends = F.sequence(F.col("size").cast("int"), F.size("lines"))
    runs = F.transform(ends, lambda m: F.struct(F.element_at("lines", m)["line"].alias("last"), F.xxhash64(F.slice("lines", F.lit(1), m)["h2"]).alias("k")))
    new = F.coalesce(F.col("least.at") != F.lag("least.at").over(Window.partitionBy(*DOC).orderBy("since")), F.lit(True))
    return found.select(*DOC, "first", F.col("least.h1").alias("fingerprint"), new.alias("new"), runs.alias("runs"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Maximal runs of lines to remove: doc_id, copy, runs (array of first, last)."""
    found = common.materialize(windows(line_table(docs), min_words), "fingerprints")
    twice = found.where("new").groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    near = common.spread_join(found, common.materialize(twice, "repeated"), ["fingerprint"], "n", "left_semi")
    near = common.materialize(near.select(*DOC, "first", "fingerprint", F.explode("runs").alias("run")).select(*DOC, "first", "fingerprint", "run.*"), "positions")
    key = ["fingerprint", "k"]
    firsts = near.groupBy(*key).agg(F.min(F.struct(*DOC, "first", "last")).alias("origin"), F.count("*").alias("n")).where("n > 1")
    later = common.spread_join(near, common.materialize(firsts, "origins"), key, "n")
    later = later.where("doc_id <> origin.doc_id OR copy <> origin.copy OR first > origin.last").select(*DOC, "first", "last")
    by_doc = Window.partitionBy(*DOC).orderBy("first", "last")
    spread = later.distinct().withColumn("reach", F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)))
    runs = spread.withColumn("run", F.sum(F.when(F.col("first") <= F.col("reach") + 1, 0).otherwise(1)).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*DOC, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, removed: str = "n_removed_lines") -> DataFrame:
    """docs with later repeated runs taken out of `text`, and how many lines that were in column `removed`.

    Other columns stay, except that a column `n_chars` is set to the new length where lines went. Null
    and empty texts stay as they are; a text may become empty. Rows with a null doc_id are left alone
    and give no origin. Rows that repeat a doc_id are told apart by their text; equal rows count as one
    document and keep the same lines.
    """
    id_, copy, cut = (common.fresh(docs, c) for c in ("run_doc_id", "run_copy", "run_lines"))
    numbered = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    runs = repeated_runs(numbered, min_words).select(F.col("doc_id").alias(id_), F.col("copy").alias(copy), F.col("runs").alias(cut))
    wide = docs.join(runs, (docs["doc_id"] == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(copy)), "left")
    cut = F.col(cut)
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists(cut, lambda r: (i >= r["first"]) & (i <= r["last"])))
    gone = F.when(cut.isNull(), F.lit(0)).otherwise(F.aggregate(cut, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1))
    text = F.when(cut.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(text.alias("text"))
        elif c == "n_chars":
            out.append(F.when(cut.isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        elif c != removed:
            out.append(F.col(c))
    return wide.select(*out, gone.cast("long").alias(removed))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with repeated passages removed: doc_id, n_removed_lines, n_chars and text."""
    return remove_repeated_lines(common.table(spark, sf_dir, "documents")).select("doc_id", "n_removed_lines", "n_chars", "text")


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS content FROM documents WHERE text IS NOT NULL
), counted AS (
  SELECT doc_id, line, content, len(regexp_extract_all(content, '[^\x20\x09-\x0D]+')) AS words FROM lines
), placed AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS until, sum(words) OVER (PARTITION BY doc_id ORDER BY line) - words AS since FROM counted WHERE words > 0
), windows AS (
  SELECT doc_id, 0 AS kind, line AS first, max(line) OVER w AS last, sum(words) OVER w AS n, list(content) OVER w AS k FROM placed
  WINDOW w AS (PARTITION BY doc_id ORDER BY since RANGE BETWEEN 0 PRECEDING AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, 1, min(line) OVER w, line, sum(words) OVER w, list(content) OVER w FROM placed
  WINDOW w AS (PARTITION BY doc_id ORDER BY until RANGE BETWEEN 49 PRECEDING AND 0 FOLLOWING)
), full_windows AS (
  SELECT doc_id, kind, first, last, k FROM windows WHERE n >= 50
), origins AS (
  SELECT kind, k, min(struct_pack(doc_id := doc_id, first := first, last := last)) AS origin FROM full_windows GROUP BY kind, k HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT l.doc_id, l.line FROM full_windows w JOIN origins o ON w.kind = o.kind AND w.k = o.k
  JOIN lines l ON l.doc_id = w.doc_id AND l.line BETWEEN w.first AND w.last
  WHERE w.doc_id > o.origin.doc_id OR w.first > o.origin.last
), rest AS (
  SELECT l.doc_id, string_agg(CASE WHEN g.line IS NULL THEN l.content END, chr(10) ORDER BY l.line) AS text, count(g.line) AS n
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(r.n, 0) AS n_removed_lines, CASE WHEN r.n > 0 THEN length(coalesce(r.text, '')) ELSE d.n_chars END AS n_chars,
  CASE WHEN r.n > 0 THEN coalesce(r.text, '') ELSE d.text END AS text
FROM documents d LEFT JOIN rest r USING (doc_id)
"""

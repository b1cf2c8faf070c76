"""Operator 9: corpus-wide line deduplication with keep bitmaps, DataFrame functions only.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case.  Keys are
hashed (two 64-bit hashes); the (hash, document, position) rows are range-partitioned by hash *and* document
with a secondary sort by position, so that a hash which occurs in a third of all documents spreads over many
ranges.  The first occurrence of a key in each document streams out of the sorted ranges; its partial counts per
range meet as one row per key and range.  What comes back per document is not text but a sparse bitmap: the
64-bit words, by word number, in which at least one line goes.

Defined cases: very long texts are split whole, whatever the number of lines; a null or empty text is one empty line; lines whose key is shorter than ``min_chars`` always stay;
repeated rows (same id and text) count as one document and each get the result; rows with one id but different
texts count as different documents; an empty table gives an empty result; other columns are carried untouched
by :func:`drop_lines` and ignored by :func:`keep_bitmaps`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialised, table

#: The characters stripped from a line, and the letters lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _document(id_col: str, text_col: str) -> list[Column]:
    """What tells documents apart: the id and a hash of the text."""
    return [F.col(id_col).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("version")]


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, ranges: int | None = None) -> DataFrame:
    """(doc, version, drops): per document that loses lines a map from word number to the 64 line bits to drop.

    Bit ``i % 64`` of word ``i // 64`` is set if line ``i`` goes; absent words keep all their lines.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = F.transform(lines_of(F.col(text_col)), line_key)
    hashed = F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("#"), k).alias("h2"), (F.char_length(k) >= min_chars).alias("counts")))
    exploded = docs.select(*_document(id_col, text_col), F.posexplode(hashed).alias("pos", "line")).where("line.counts")
    # Four jobs read these narrow rows (two sample the ranges): hash the texts once and keep the hashes.
    lines = materialised(exploded.select("line.h1", "line.h2", "doc", "version", "pos"), "line-hashes")
    ranged = lines.repartitionByRange(ranges, "h1", "h2", "doc", "version").sortWithinPartitions("h1", "h2", "doc", "version", "pos")
    per_document = Window.partitionBy("h1", "h2", "doc", "version").orderBy("pos")
    first = ranged.withColumn("nth", F.row_number().over(per_document)).where("nth = 1")
    frequent = first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs).select("h1", "h2")
    # A frequent key can hold a large part of all lines: deal each key over 16 salts, the keys copied to every salt.
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc", "version"), F.lit(16)))
    keys = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    gone = salted.join(keys, ["h1", "h2", "salt"]).select("doc", "version", "pos")
    words = gone.groupBy("doc", "version", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("doc", "version").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """All columns of ``docs`` in a struct ``row`` plus kept (text), n_lines and n_dropped."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_docs, min_chars)
    left = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(f"own_{n}") for c, n in zip(_document(id_col, text_col), ("doc", "version"), strict=True)])
    joined = left.join(bitmaps, F.col("own_doc").eqNullSafe(F.col("doc")) & (F.col("own_version") == F.col("version")), "left")
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    parts = F.split(text, "\n", -1)

    def stays(_: Column, i: Column) -> Column:
        word = F.coalesce(F.element_at("drops", F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
        return F.getbit(word, i % 64) == 0

    kept = F.when(F.col("drops").isNull(), text).otherwise(F.array_join(F.filter(parts, stays), "\n"))
    dropped = F.when(F.col("drops").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(F.map_values("drops"), F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x)))
    return joined.select("row", kept.alias("kept"), F.size(parts).cast("long").alias("n_lines"), dropped.alias("n_dropped"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT r, doc_id, version, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT r, doc_id, md5(text) AS version, string_split(text, chr(10)) AS l FROM docs)
), keyed AS (
  SELECT r, doc_id, version, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT struct_pack(i := doc_id, v := version)) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
GROUP BY r, doc_id
"""

"""A deterministic DNA world derived from the general tables, the same in Spark and in SQL.

It is not biological: it only lets two engines be compared. Contigs are documents spelt in four letters, DOCS of
them in a row; variants are line items placed on them. Every document and every line item takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakweave.functions.sequence import fetch, reverse_complement
from breakweave.operators.cleaning import with_tile
from breakweave.sources.scratch import written

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BASES = ("ACGT" * 7)[: len(ALPHABET)]
#: Documents of a contig, by ascending doc_id.
DOCS = 16
#: Only contigs longer than this have variants, which stay at least 1000 bp from their ends.
SHORTEST = 2300
#: No allele is longer.
LONGEST = 31
#: Bases of the tiles that variants are spelt from: their alleles reach 128 bases at most, and each has its tile copied next to it.
SHORT_TILE = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr, seq. Every 17th contig has one N. Written once: variants, cleaning and contexts each cut it anew."""
    seq = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), ALPHABET, BASES)
    each = read(spark, sf_dir, "documents").select(F.expr(f"doc_id div {DOCS}").alias("n"), F.struct("doc_id", seq.alias("seq")).alias("d"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list("d")), lambda d: d["seq"]), "")  # DOCS texts at most
    contigs = each.groupBy("n").agg(whole.alias("seq"))
    marked = F.when((F.col("n") % 17 == 0) & (F.length("seq") > SHORTEST), F.overlay("seq", F.lit("N"), F.lit(1500))).otherwise(F.col("seq"))
    return written(contigs.select(F.col("n").cast("string").alias("chr"), marked.alias("seq")), "genome")


def contig_of(spark: SparkSession, sf_dir: str, rows: DataFrame, key: str) -> DataFrame:
    """Adds chr: the contig of the document that a key falls on."""
    docs = read(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("n_docs"))  # one number
    return rows.join(F.broadcast(docs)).withColumn("chr", F.expr(f"({key} % n_docs) div {DOCS}").cast("string")).drop("n_docs")


def variants(spark: SparkSession, sf_dir: str, contigs: DataFrame | None = None) -> DataFrame:
    """chr, pos (of the anchor base, from 1), ref, alt, ancestral (0, 1 or 2). `contigs`: the genome, if it is there already.

    Written once: filters would otherwise be pushed below the alleles, and spell them again for each of their uses.
    """
    contigs = genome(spark, sf_dir) if contigs is None else contigs
    rooms = contigs.select("chr", (F.length("seq") - 2200).alias("room")).where(F.col("room") > SHORTEST - 2200)
    placed = contig_of(spark, sf_dir, read(spark, sf_dir, "lineitem"), "l_orderkey").join(rooms, "chr").select(
        "chr",
        (1001 + (F.col("l_partkey") * 7919 + F.col("l_linenumber") * 104729) % F.col("room")).alias("pos"),
        (1 + F.col("l_quantity").cast("int") % 30).alias("n"),
        "l_linenumber",
        (F.col("l_suppkey") % 60).cast("int").alias("gap"),
        (F.col("l_orderkey") % 3).cast("int").alias("ancestral"),
    )
    near = with_tile(placed, contigs, 128, size=SHORT_TILE, deal=True)
    at = lambda start, length: fetch(F.col("tile_seq"), F.col("pos") - 1 + start, F.col("pos") - 1 + start + length, F.col("base"))
    copied = at(2 + F.col("gap"), F.col("n"))
    put = F.when(F.col("l_linenumber") % 4 == 2, reverse_complement(copied)).otherwise(copied)
    anchor, lost = at(F.lit(0), F.lit(1)), at(F.lit(0), F.col("n") + 1)
    deletes = F.col("l_linenumber") % 2 == 1
    spelt = near.select(
        "chr", "pos", F.when(deletes, lost).otherwise(anchor).alias("ref"), F.when(deletes, anchor).otherwise(F.concat(anchor, put)).alias("alt"), "ancestral"
    )
    return written(spelt, "variants")


#: The same tables for the SQL engine; queries are appended to it.
SQL = f"""
WITH contigs AS (
  SELECT doc_id // {DOCS} AS n, string_agg(translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{ALPHABET}', '{BASES}'), '' ORDER BY doc_id) AS raw FROM documents GROUP BY 1
), genome AS (
  SELECT CAST(n AS VARCHAR) AS chr,
    CASE WHEN n % 17 = 0 AND length(raw) > {SHORTEST} THEN substr(raw, 1, 1499) || 'N' || substr(raw, 1501) ELSE raw END AS seq
  FROM contigs
), placed AS (
  SELECT g.chr, 1001 + (l_partkey * 7919 + l_linenumber * 104729) % (length(seq) - 2200) AS pos,
    CAST(1 + CAST(floor(l_quantity) AS BIGINT) % 30 AS BIGINT) AS n, l_linenumber, l_suppkey % 60 AS gap, l_orderkey % 3 AS ancestral, seq
  FROM (SELECT *, CAST(l_orderkey % (SELECT max(doc_id) + 1 FROM documents) // {DOCS} AS VARCHAR) AS chr FROM lineitem) l JOIN genome g ON l.chr = g.chr
  WHERE length(seq) > {SHORTEST}
), pieces AS (
  SELECT *, substr(seq, pos, 1) AS anchor, substr(seq, pos, n + 1) AS lost, substr(seq, pos + 2 + gap, n) AS copied FROM placed
), variants AS (
  SELECT chr, pos, CASE WHEN l_linenumber % 2 = 1 THEN lost ELSE anchor END AS ref,
    CASE WHEN l_linenumber % 2 = 1 THEN anchor WHEN l_linenumber % 4 = 2 THEN anchor || reverse(translate(copied, 'ACTG', 'TGAC')) ELSE anchor || copied END AS alt,
    CAST(ancestral AS INTEGER) AS ancestral
  FROM pieces
)"""

"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrostrata.llm import canonical, contamination, crosssplit, matching, mojibake, packing, residue
from hydrostrata.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_restored(spark, folder).select("table_name", "record_id").distinct()


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Every garbled name with the cipher it went through and the original where it can be restored."""
    return mojibake.garbled_names(table(spark, folder, "districts"), table(spark, folder, "assessment_units"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_matches(spark, folder).select("review_id", "pub_id")


def p5_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matched crosswalk and published rows with the marginal probability of the match."""
    return matching.match_units(table(spark, folder, "crosswalk_fuzzy_review_sample"), table(spark, folder, "published_units"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_mentions(spark, folder).select("mention_id", "entity_id")


def p6_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Every mention with its entry or -1, the nearest entry, its scores and the reason."""
    return canonical.map_mentions(table(spark, folder, "errors_sample"), table(spark, folder, "gazetteer"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = crosssplit.overlaps(table(spark, folder, "ingres_bench_v1"))
    return pairs.select(F.least("train_id", "eval_id").alias("id_1"), F.greatest("train_id", "eval_id").alias("id_2")).distinct()


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation questions found in train, and pairs, by split and template."""
    bench = table(spark, folder, "ingres_bench_v1")
    rows = bench.select(F.col("id").alias("eval_id"), "split", "template_id").distinct()
    return crosssplit.overlaps(bench).join(rows, "eval_id").groupBy("split", "template_id").agg(F.countDistinct("eval_id").alias("n_questions"), F.count("*").alias("n_pairs"))


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The document-to-container plan for containers of 2,048 tokens."""
    return packing.pack(table(spark, folder, "documents"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are: containers and items by tenth of the capacity left free."""
    filled = packing.containers(p8_packing(spark, folder))
    return filled.groupBy(F.floor(F.col("free") * 10 / packing.CAPACITY).alias("tenth_free")).agg(F.count("*").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.leaks(table(spark, folder, "documents"), table(spark, folder, "heldout_items")).select("doc_id", "item_id")


def p9_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The longest verbatim match of every item in every document, with its places."""
    return contamination.leaks(table(spark, folder, "documents"), table(spark, folder, "heldout_items"))


def p9_clean_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return contamination.clean_documents(documents, p9_found(spark, folder)).select("doc_id", "source", "n_chars")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "documents")).where("kind <> 'prose'").select("doc_id")


def p10_report(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by source and kind."""
    documents = table(spark, folder, "documents")
    return residue.residue(documents).join(documents.select("doc_id", "source"), "doc_id").groupBy("source", "kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p3_found, p3_restored, p5_found, p5_matches, p6_found, p6_mentions, p7_found, p7_counts, p8_packing, p8_fill, p9_found, p9_matches, p9_clean_documents, p10_found, p10_report)}

#: Documents and items that share ten words in a row, by an index of all ten-word passages.
_SHARED = r"""WITH words AS (SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\pL\pM\pN\s\pZ]', '', 'g'), '[\s\pZ]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
  UNION ALL SELECT 'i', item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\pL\pM\pN\s\pZ]', '', 'g'), '[\s\pZ]+'), lambda x: x <> '') FROM heldout_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
passages AS (SELECT DISTINCT side, id, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT side, id, w, unnest(range(1, len(w) - 8)) AS k FROM words WHERE len(w) >= 10) u),
shared AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM passages d JOIN passages i USING (g) WHERE d.side = 'd' AND i.side = 'i')
"""
ORACLES: dict[str, str] = {
    "p9_found": f"{_SHARED} SELECT doc_id, item_id FROM shared",
    "p9_clean_documents": f"{_SHARED} SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM shared)",
}

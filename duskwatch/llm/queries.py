"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm import sql
from duskwatch.llm.common import table
from duskwatch.llm.decontamination import contaminated
from duskwatch.llm.divergence import audit_sources
from duskwatch.llm.jaccard import near_duplicates
from duskwatch.llm.language import identify_language, learn
from duskwatch.llm.lines import count_later_lines
from duskwatch.llm.negatives import mine_hard_negatives
from duskwatch.llm.packing import pack_documents
from duskwatch.llm.pages import extract_main_text
from duskwatch.llm.passages import repeated_passages
from duskwatch.llm.personal import find_personal_data
from duskwatch.llm.quality import judge_quality
from duskwatch.llm.secrets import scan_secrets
from duskwatch.llm.sharding import grow, hash_tree_shards, layout


TEMPLATE_DOCS = 5


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The owner of a document is its source, the repository its source and language."""
    docs = table(spark, folder, "documents")
    repo = F.concat_ws("/", "source", "lang")
    return scan_secrets(docs, repo, F.col("source"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The host of a document is its source; these are small hosts, so few documents make a line a template."""
    return judge_quality(table(spark, folder, "documents"), min_docs=TEMPLATE_DOCS).drop("row_key", "gone")


def op3_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(table(spark, folder, "documents"))


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages"))


def op5_hash_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    tree = layout(40)
    return hash_tree_shards(table(spark, folder, "documents"), tree, grow(tree))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return count_later_lines(table(spark, folder, "documents"))


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(table(spark, folder, "documents"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit_sources(table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of every seventh vector are moved on by one, as the contract has it."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), "embedding"))


def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the documents, chosen by a checksum of their ids, is never learned from."""
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = learn(docs.filter(~held_out), order=F.xxhash64("doc_id"))
    return identify_language(docs.withColumn("held_out", F.coalesce(held_out, F.lit(False))), model, keep=("held_out",))


#: Name, query, SQL for DuckDB (None where SQL cannot express it; then a test holds the query against brute force).
QUERIES = {
    "op1_secret_scan": (op1_secret_scan, None),
    "op2_quality_rules": (op2_quality_rules, sql.quality(TEMPLATE_DOCS)),
    "op3_repeated_passages": (op3_repeated_passages, None),
    "op4_main_text": (op4_main_text, None),
    "op5_hash_tree_shards": (op5_hash_tree_shards, None),
    "op6_decontamination": (op6_decontamination, None),
    "op7_line_dedup": (op7_line_dedup, sql.LINES),
    "op8_best_fit_packing": (op8_best_fit_packing, None),
    "op9_ngram_jaccard": (op9_ngram_jaccard, sql.COMPONENTS),
    "op10_personal_data": (op10_personal_data, None),
    "op11_source_divergence": (op11_source_divergence, sql.DIVERGENCE),
    "op12_hard_negatives": (op12_hard_negatives, sql.NEGATIVES),
    "op13_language_id": (op13_language_id, None),
}

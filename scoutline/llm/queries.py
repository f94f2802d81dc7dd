"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutline.llm.arc_to_warc import ARCHIVED_SQL, archived_pages
from scoutline.llm.chat_format import ADDED, CHAT_SQL, chat_digests
from scoutline.llm.decontamination import CONTAMINATED_SQL, contaminated
from scoutline.llm.divergence import DIVERGENCE_SQL, source_divergence
from scoutline.llm.hard_negatives import NEGATIVES_SQL, hard_negatives
from scoutline.llm.langid import identify
from scoutline.llm.learned_partitions import nearest_neighbours
from scoutline.llm.mixing import mix_sources
from scoutline.llm.ngram_join import JACCARD_SQL, ngram_jaccard_join
from scoutline.llm.pii import pii_spans
from scoutline.llm.quality_forest import quality_rules
from scoutline.llm.site_template import main_text
from scoutline.llm.url_list import URL_SQL, listed_captures, page_captures, page_list
from scoutline.session import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100).select(
        "doc_id", "n_shingles", "component_id"
    )


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id, turns = ADDED
    rows = ", ".join(f"({conv_id}L, {i}L, '{role}', '{text}')" for i, (role, text) in enumerate(turns))
    added = spark.sql(f"SELECT * FROM VALUES {rows} AS t(conv_id, turn, role, text)")
    return chat_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added))


def op4_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op7_temporal_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return listed_captures(page_captures(pages), page_list(pages)).withColumnsRenamed({"id": "page_id", "at": "fetch_day"})


def op8_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))


def op11_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where("vec_id % 50 = 0"))


def op12_voronoi_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    dealt = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", dealt))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_arc_to_warc": op2_arc_to_warc,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_site_templates": op4_site_templates,
    "op5_mixing_sources": op5_mixing_sources,
    "op6_language_id": op6_language_id,
    "op7_temporal_url_list": op7_temporal_url_list,
    "op8_quality_forest": op8_quality_forest,
    "op9_spaced_seed_decontamination": op9_spaced_seed_decontamination,
    "op10_pii_deobfuscation": op10_pii_deobfuscation,
    "op11_learned_partitions": op11_learned_partitions,
    "op12_voronoi_hard_negatives": op12_voronoi_hard_negatives,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": JACCARD_SQL,
    "op2_arc_to_warc": ARCHIVED_SQL,
    "op3_chat_formatting": CHAT_SQL,
    "op7_temporal_url_list": URL_SQL,
    "op9_spaced_seed_decontamination": CONTAMINATED_SQL,
    "op12_voronoi_hard_negatives": NEGATIVES_SQL,
    "op13_source_divergence": DIVERGENCE_SQL,
}

"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, mixing.

Each stage reads what its predecessor kept. All but the last return the columns of documents;
the last adds source_size, target and taken, the words that the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoutline.llm.decontamination import drop_contaminated
from scoutline.llm.mixing import mix_sources
from scoutline.llm.ngram_join import ngram_jaccard_join
from scoutline.llm.pii import mask_pii
from scoutline.llm.quality_forest import keep_good
from scoutline.llm.shared import Scratch, small
from scoutline.session import table


#: Columns that the last stage adds.
MIXED = ("source_size", "target", "taken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the forest keep; each is judged by its own text, and null and empty texts go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 of their five-word shingles the one of least doc_id.

    Rows without doc_id are linked with nothing and stay. Rows with an equal doc_id are one document: all of its different
    texts stay or go together, and of equal texts one stays. Null and empty texts are linked with nothing.
    """
    with Scratch(spark) as scratch:
        groups = ngram_jaccard_join(docs, n=5, num=80, den=100)
        gone = scratch.keep(groups.where("doc_id <> component_id").select("doc_id").distinct())
        twice = scratch.keep(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    kept = docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)
    if twice.isEmpty():
        return kept
    row, text = F.struct(*docs.columns), F.struct(F.col("doc_id"), F.col("text"))
    same = kept.join(small(twice), "doc_id", "left_semi").select(row.alias("row"), text.alias("id"))
    first = Window.partitionBy("id").orderBy(F.xxhash64("row"))
    one = same.withColumn("i", F.row_number().over(first)).where("i = 1").select("row.*")
    return kept.join(small(twice), "doc_id", "left_anti").select(docs.columns).unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no overlap with the benchmark; null and empty texts have none."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in text masked and n_chars counted anew; null texts stay null."""
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with source_size, target and taken, the words that it takes.

    Every row is a document of its own, also where doc_ids are null or repeated. Columns of docs that have one of
    these three names are replaced.
    """
    own = [c for c in docs.columns if c not in MIXED]
    mix = mix_sources(docs.select("doc_id", "text", "source", F.struct(*own).alias("row")), carry=("row",))
    return mix.where("taken > 0").select("row.*", *MIXED)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing sources", mixing),
]

#: No SQL: the forest and the seeded selection are outside of it; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.save(stage(spark, docs, sf_dir))
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir))

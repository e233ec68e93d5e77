"""From raw documents to token ids in five stages.

Each stage takes what the one before has kept and, but for the last, returns the columns of
``documents``; where a stage changes a text, ``n_chars`` follows. Rows of null id are treated
as one id, below all others. Rows that share an id are judged, mixed and encoded each by itself;
line dedup counts them as one document, and near duplicates go by text. Empty tables give empty
tables.

1. quality rules: documents that fail the base rule or a cutoff of their language go.
2. line dedup: lines found in three documents or more stay in the one of largest id only.
3. near duplicates: of each group the document of least id stays; of rows that share an id each
   belongs to the group of its text. Blank texts are in no group and stay.
4. mixing: documents as the mix takes them, a row for each time round; cut where a block is.
5. pieces: ids, their number, and the text they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.line_dedup import dedup_lines
from orrery.llm.mixing import Mix
from orrery.llm.pieces import recode
from orrery.llm.quality import fit_cutoffs, judge, measure
from orrery.llm.shingle_join import near_duplicates
from orrery.llm.store import stage as stage_table
from orrery.llm.store import stage_only


def n_chars():
    return F.char_length("text").cast("long")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    measured = stage_table(measure(docs), "measured")
    cutoffs = fit_cutoffs(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(measured, cutoffs).where("kept").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs).withColumn("n_chars", n_chars()).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates(docs).where("n_shingles > 0").groupBy("component_key", "id", "text_hash").agg(F.count("*").alias("rows"))
    first = found.groupBy("component_key").agg(F.min(F.struct("id", "text_hash", "rows")).alias("first"))
    first = stage_table(first.select(F.col("first.id").alias("_id"), F.col("first.text_hash").alias("_hash"), F.col("first.rows").alias("_rows")), "kept")
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.where(~blank).join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")))
    # Only rows that share an id and a text can still be copies of each other.
    if first.where("_rows > 1").isEmpty():
        return rows.select(docs.columns).unionByName(docs.where(blank))
    once = rows.where("_rows > 1").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return rows.where("_rows = 1").select(docs.columns).unionByName(once).unionByName(docs.where(blank))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return Mix(docs).mixed().withColumn("n_chars", n_chars()).select(docs.columns)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select("doc_id", "source", "lang", "text")
    return recode(rows, model).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_stage), ("mix", mix_stage), ("pieces", piece_stage)]
#: The mix and the piece ids cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), ()
    for name, stage in STAGES[:-1]:
        docs, path = stage_only(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, name, *done)
        done = (path,)
    return STAGES[-1][1](spark, docs, sf_dir)

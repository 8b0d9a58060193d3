"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a table of documents.

Stages run one after another over Parquet tables in the shared folder. All but the last return
the columns of documents, whatever further columns there are and whatever they are called; the last
returns each kept document's ids. An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenaudit.llm import decontaminate, jaccard, quality, spiece, suffix
from lumenaudit.llm.shared import table_path

#: Near duplicates: five-word shingles, similarity of 0.8 or more.
SHINGLE, SIMILARITY = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of the training fold, doesn't reject.

    Null and blank texts have the statistics of an empty text and are judged by them; repeated rows are each judged;
    a score on the cut is kept; without labels of both classes all have one score.
    """
    labels = quality.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    model = quality.fit(docs, labels)
    return quality.keep(docs, model)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near duplicates.

    Rows that repeat a doc_id are one document if they are linked. Null and blank texts are linked with nothing and stay; fewer than
    five words are one shingle; a row without a doc_id stays unless it is linked with one that has.
    """
    groups = jaccard.near_duplicates(docs, SHINGLE, SIMILARITY)
    first = groups.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id").distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["doc_id"]), "left_semi")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings that start earlier in the corpus; n_chars follows the text where bytes went.

    A null text becomes an empty one; a text that is removed whole stays as an empty one; a character that loses some of its bytes goes;
    rows that repeat doc_id and text keep the same bytes; a null doc_id counts as the last.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = {c: f"held_{i}" for i, c in enumerate(rest)}  # other columns may have any name
    cut = suffix.cut_repeats(docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(h) for c, h in held.items())), list(held.values()), with_text=True)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), **{c: F.col(h) for c, h in held.items()}}
    if "n_chars" in rest:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col(held["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return cut.select(*(columns[c].alias(c) for c in docs.columns))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget. Null and wordless texts hold none; rows of one doc_id go together; all rows without a doc_id go if one of them holds an item."""
    hits = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = hits.select("doc_id").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip) of each row's piece ids. A null text counts as empty and has none."""
    return spiece.digest(docs, spiece.model_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("suffix-array dedup", suffix_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("SentencePiece encoding", encode_stage),
]

#: Several stages (a fitted classifier, edit matching, piece ids) can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = table_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

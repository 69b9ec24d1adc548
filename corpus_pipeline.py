"""A corpus from raw documents to packed token windows, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return
the columns of documents. run() writes each result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm import fingerprints, jaccard, language, packing, toxicity
from spandrel.llm.common import durable, prepare, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxic passages score REJECT or more.

    Rows are judged one by one: null, empty and wordless texts stay, repeated rows and null ids need nothing special,
    columns of any name are carried, an empty table stays empty. Without labels nothing goes.
    """
    prepare(spark)
    model = toxicity.learn(docs, labels=table(spark, sf_dir, "labels"))
    return toxicity.screen(docs, model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no letters, or whose language is not told with confidence.

    Rows are judged one by one: null and empty texts go, a null lang becomes the predicted one, repeated rows and
    null ids need nothing special, columns of any name are carried, an empty table stays empty. Where no language
    can be learned, every row with a letter stays.
    """
    prepare(spark)
    return language.screen(docs, language.train_tagger(docs.where(~language.held_out())))


#: Near copies of the pipeline share so many per cent of their shingles of so many words. (Operator 10 by itself has
#: a contract of its own, 3 words and 90 %.)
NEAR_WIDTH, NEAR_PER_CENT = 5, 80


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, width: int = jaccard.WIDTH, per_cent: int = jaccard.PER_CENT) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id; rows without a doc_id stay.

    Texts without words link with nothing and stay. Of rows that repeat both doc_id and text one stays, the first by
    its other columns; rows of a kept doc_id with another text stay too. Columns of any name are carried, an empty
    table stays empty.
    """
    linked = jaccard.link_documents(docs, width=width, per_cent=per_cent)
    kept = linked.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if others:
        rest = F.struct(*(F.col(f"`{c}`") for c in others))
        one = named.groupBy("doc_id", "text").agg(F.min_by(rest, F.to_json(rest)).alias("rest"))
        one = one.select(*(F.col(c) if c not in others else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))
    else:
        one = named.distinct().select(docs.columns)
    return one.union(docs.where("doc_id is null"))


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """near_copy_stage with the pipeline's own width and similarity."""
    return near_copy_stage(spark, docs, sf_dir, NEAR_WIDTH, NEAR_PER_CENT)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand more than once; a text that has none is left as it is.

    Every row stays, null and empty texts too; repeated rows lose what they repeat. n_chars is counted anew for all
    rows, other columns of any name are carried, an empty table stays empty.
    """
    rest = tuple(c for c in docs.columns if c != "doc_id")
    out = fingerprints.remove_passages(docs, keep=rest)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("carried.text"))
    made = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.char_length(text).cast("bigint")}
    return out.select(*(made.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in windows of packing.SEQ_LEN tokens.

    A null or empty text is the end token alone; repeated rows are packed each by itself, a null doc_id stays null,
    other columns are not looked at, an empty table gives no pieces.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("ngram_jaccard", ngram_jaccard_stage),
    ("substring_dedup", passage_stage),
    ("packing", packing_stage),
]

#: Learned models and packing have no SQL form; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i + 1 < len(STAGES):
            out = durable(out, name)
    return out

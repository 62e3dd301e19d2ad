"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every result as Parquet in the shared folder and reads it back as the next
stage's docs, so a lost executor costs at most the stage it was working on.

1. ``language_id`` drops documents without a language: no letter at all, or
   ambiguous between codewords (by the calibrated gap) with a score little above that of
   a guess among the learned languages.
2. ``exact_dedup`` keeps the smallest id of each group of equal texts.
3. ``jaccard_join`` keeps the smallest id of each component of similar texts.
4. ``decontaminate`` drops documents that hold a window of a benchmark item.
5. ``sentencepiece`` adds the ids of every remaining document, decodes them and says
   whether the text came back.

Cases: null and empty texts have no letter and go in the first stage; empty tables
and extra columns pass through every stage; repeated rows are copies of each
other (see the operators for ties and repeated ids).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgrid.llm import decontaminate, exact_dedup, jaccard_join, language_id, pieces
from pressgrid.llm.common import free_name, load, stored
from pressgrid.llm.queries import vocabulary

# Times the score of a guess that an ambiguous document needs.
OVER_GUESS = 1.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(~language_id.held_out("doc_id")))
    names = tuple(free_name(docs, f"_{n}") for n in ("lang_pred", "score", "ambiguous"))
    lang, score, unsure = (F.col(n) for n in names)
    told = language_id.predict(docs, model, names=names)
    least = OVER_GUESS / max(len(model.languages), 2)
    return told.where((lang != language_id.UNKNOWN) & ~(unsure & (score < least))).drop(*names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_similar(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, load(spark, sf_dir, "benchmark", "item_id", "text"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    out = pieces.decode(pieces.encode(docs, path), path, out="_decoded")
    return out.select(*[c for c in out.columns if c != "_decoded"],
                      (F.octet_length("pieces") / 4).cast("long").alias("n_pieces"),
                      (F.col("_decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_similar),
    ("decontaminate", drop_benchmark),
    ("sentencepiece", encode_pieces),
]

# Trained classifiers and a tokenizer are not SQL; tests compare the stages with
# brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""The corpus pipeline: five stages from documents to token files, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, mixing, neardup, wavelet
from tidemark.llm.common import shielded, stored, table
from tidemark.llm.queries import MIX_SEED, mix_domain, mix_weights, tokenizer_path

# A text with letters is rejected only if the network is as sure as this that they are scrambled; short or mixed texts stay.
SCRAMBLED_SCORE = 0.98
# Share of the remaining tokens that the mixture takes.
PIPELINE_PERCENT = 90


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts the network takes for scrambled letters; a missing lang becomes the predicted one.

    Without a single labelled row nothing can be learned, and every text with a letter stays. Null and empty texts have no
    letter; repeated rows and long texts are judged like any other; an empty table stays empty; columns pass whatever their names.
    """
    held, back = shielded(docs, ["lang_pred", "score"])
    net = langid.fit(held.where(~langid.held_out()), with_reject=True)
    if net is None:
        return docs.where(F.col("text").rlike("\\p{L}"))
    unsure = F.col("score").between(1e-9, SCRAMBLED_SCORE)
    kept = langid.predict(held, net).where((F.col("lang_pred") != langid.UNDETERMINED) | unsure)
    return back(kept.withColumn("lang", F.coalesce("lang", "lang_pred")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest row of every group of texts with five-word similarity of 0.8, found by SimHash and MinHash bands; op7's contract is not this stage's."""
    return neardup.one_of_each_group(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window.

    Null, empty and wordless texts hold none and stay; repeated rows share their fate; texts are scanned whole; an empty table or
    benchmark drops nothing; columns pass whatever their names.
    """
    held, back = shielded(docs, decontam.ADDED)
    scanned = decontam.scan_documents(spark, held, table(spark, sf_dir, "benchmark"))
    return back(scanned.where(F.size("hit_starts") == 0))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the leaves' budgets reach in one epoch, whole.

    Null and empty texts count no words and stay where their leaf is read to its end; equal rows share a key and their
    fate; null languages and sources are leaves of their own; an empty table stays empty; columns pass whatever their names.
    """
    held, back = shielded(docs, ["_row"])
    keyed = held.withColumn("_row", neardup.row_key(held))
    chosen = mixing.mixed(keyed, mix_domain(), mix_weights(), MIX_SEED, PIPELINE_PERCENT, 1, ("_row",))
    return back(keyed.join(chosen.select("_row"), "_row", "left_semi"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and each document's place in them.

    Null and empty texts are documents of the end id alone; rows without id come first, rows that share one in order of their
    texts; long texts are encoded whole; an empty table gives no rows; other columns are not part of the result.
    """
    return wavelet.encode_documents(spark, docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("simhash_near_dedup", one_of_each_group),
    ("decontamination", decontaminate),
    ("mixture", mix),
    ("token_files", tokens),
]

# A trained network decides in the first stage, which SQL cannot express; tests compare stages two, three and five with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return docs

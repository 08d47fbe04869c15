"""The corpus pipeline: quality rules, near-dedup, secret redaction, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``; columns beyond those are carried along, whatever
their names.

Cases, in the order of the stages. Null and blank texts, and texts of fewer than
50 words, fail the quality rules and go; repeated rows are judged alike; a null
doc_id is never trusted. Near-dedup keeps one row of a group, that with the
least doc_id, null last; texts without words are copies of each other. A null
text holds no secret and stays null; n_chars changes with the text only. Rows
that agree in doc_id, source and text are taken as often as the mix takes them
together; a null source ranks last. A null text has no token ids. Very long
texts are worked on whole in each stage, ties fall to the row with the least
number, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import common, mixing, pieces, quality_rules, queries, secrets, simhash


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    trusted = quality_rules.trusted_ids(common.table(spark, sf_dir, "labels"))
    ratio = common.staged(quality_rules.ratios(docs, trusted), "quality-ratios")
    return quality_rules.kept_rows(docs, ratio)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least doc_id, null last.

    Near copies share four fifths of their five-word shingles or more, compared
    exactly; equal texts, null and blank ones among them, are copies too.
    """
    return simhash.keep_representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts replaced by a mark; n_chars follows the text."""
    found = secrets.scan(docs, secrets.REDACTION).select("row.*", secrets.redacted("t", "spans").alias("__clean"), (F.size("spans") > 0).alias("__found"))
    new = {"text": "__clean", "n_chars": "char_length(__clean)"}
    types = dict(docs.dtypes)
    return found.select(*[F.expr(f"CASE WHEN __found THEN cast({new[c]} AS {types[c]}) ELSE `{c}` END").alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.taken_rows(docs, common.staged(mixing.mix(common.staged(mixing.units(docs), "mix-units")), "mix"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return pieces.encode_documents(docs, queries.tokenizer_file("piece_bpe_32k.model"), ["doc_id", "lang", "source"])


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", keep_one_of_each),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: The stages hash with XXH64 and run a tokenizer, which SQL cannot; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

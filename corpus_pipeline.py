"""The corpus pipeline: documents in, a filtered, de-duplicated, mixed and tokenised corpus out.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read back as the next
stage's ``docs``.  All stages but the last return the columns of ``documents`` and leave others out;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.bpe import bpe_round_trip
from folio.llm.columns import SPACE_CLASS
from folio.llm.line_dedup import dedup_lines
from folio.llm.minhash_dedup import near_duplicate_classes, text_hashes
from folio.llm.mixing import domain_labels, mix_documents, without_domain
from folio.llm.quality_rules import quality_verdicts
from folio.sources.staging import scratch, scratch_path, staged

#: Rows of a key table that may be sent to every task; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Relative weights of the languages' tokens in the mix.  The smaller languages are written more often than they
#: occur, so that no document has to go; SCALE leaves room for the documents that are a little of another language.
MIX, SCALE = {"de": 0.18, "en": 0.52, "es": 0.12, "fr": 0.18}, 1.03
#: What the labels tell of a document.
KINDS = ["clean", "low", "toxic"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned quality list keeps.

    A null or empty text has too few words and goes; rows with a null id and repeated rows are judged
    like any other; without labels the base rules decide alone.
    """
    return quality_verdicts(docs, _labels(spark, sf_dir), keep_columns=COLUMNS).where("kept").select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a line found in ten or more of them stays at its first occurrence only; one that loses every word goes.

    Null and empty texts have no words and go; a null id comes first in the order of occurrences;
    rows repeated in full count once and get equal texts.
    """
    kept = dedup_lines(docs, min_docs=10, min_chars=1, keep_first=True, keep_columns=["lang", "source"])
    text = F.col("kept_text")
    return kept.where(text.rlike(SPACE_CLASS.replace("[", "[^"))).select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the least id; repeated rows leave one.

    Texts without words are one class; a null id stands for its class only if no row of it has an id.
    """
    classes = near_duplicate_classes(docs, with_hashes=True)
    # Rows are told apart by id and text: ids need not be unique.  A row that both stays and goes is repeated; all but one leave.
    fate = classes.groupBy("doc_id", "h1", "h2").agg(F.bool_or("keep").alias("stays"), F.bool_and("keep").alias("alone")).where("NOT alone")
    fate = staged(fate.select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "stays"), "fate")
    few = fate.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # else the texts are shuffled
    same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    rows = docs.select(*COLUMNS, *text_hashes(F.col("text")))
    kept = rows.join(F.broadcast(fate) if few else fate, same, "left_anti")
    repeated = fate.where("stays")
    if not repeated.limit(1).count():
        return kept.select(*COLUMNS)
    once = rows.join(F.broadcast(repeated) if few else repeated, same, "left_semi").dropDuplicates(["doc_id", "h1", "h2"])
    return kept.unionByName(once).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not likelier toxic than clean or low, however many there are; without labels all."""
    return without_domain(docs, domain_labels(_labels(spark, sf_dir)), KINDS, "toxic")


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its fitted rate says, rounded up or down by a hash, so that the written tokens have the languages' shares of MIX.

    The classifier learns the languages from the labelled documents that name one.  Null and empty texts
    have no tokens and the prior's rate; repeated rows fare alike; without such documents each is written once.
    """
    named = docs.where(F.col("lang").isin(list(MIX))).select("doc_id", F.col("lang").alias("domain"))
    labelled = named.join(_labels(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    named_some = {r["domain"] for r in labelled.select("domain").distinct().collect()}  # of the languages of MIX
    targets = {d: w for d, w in MIX.items() if d in named_some} or MIX  # a language that no label names can't be told
    mixed = mix_documents(docs, labelled, targets, scale=SCALE, keep_all=True, keep_columns=COLUMNS).where("copies >= 1")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the languages, after the toxic documents have gone; see :func:`drop_toxic` and :func:`mix_languages`."""
    return mix_languages(spark, staged(drop_toxic(spark, docs.select(*COLUMNS), sf_dir), "not_toxic"), sf_dir)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether they decode to the text; a null text has no ids and counts as empty."""
    import public_tokenizers

    coded = bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_text=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_common_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Learned rules, signatures and token ids are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with scratch():  # what the stage keeps on its way goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

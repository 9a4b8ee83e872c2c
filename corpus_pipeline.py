"""A training-data pipeline over ``documents``: quality, near-duplicates, repeated passages, contamination, mixing.

Each stage takes all rows that its predecessor kept, as Parquet, and returns the rows that it keeps with the
columns of documents; the last returns the mix: doc_id, size, source_size, target, taken.

Cases, for all stages: null and empty texts are documents without words, which no stage but the classifier judges; very long texts are read whole;
decisions hold for rows by id and text, so rows that share an id but not a text are told apart; null ids are kept, further columns are left out whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, mixing, quality, simhash, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL has no near-duplicate search over fingerprints, regression or packed draws.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the ordinal classifier gives the top grade with probability 0.5 or more (0.5 itself too).

    An empty text is judged by the shares alone; repeated rows are judged alike; without labels all grades are equally likely and nothing is kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, quality.graded(labels))
    return quality.score(docs, model, keep=("text", "lang", "source", "n_chars")).filter("keep").select(*COLUMNS)


def keyed(rows: DataFrame) -> DataFrame:
    """rows of (doc_id, body) as keys (out_id, out_body) of rows: body is xxhash64 of the text, a null id counts as one value."""
    return rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)).alias("out_id"), F.col("body").alias("out_body")).distinct()


def on_keys(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose id and text are (left_semi) or aren't (left_anti) in keys.

    Up to SMALL keys are broadcast, so that the texts stay where they are.
    """
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID))
    return docs.join(F.broadcast(keys) if keys.count() <= SMALL else keys, (ident == F.col("out_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("out_body")), how)


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows whose id and text are in rows (doc_id, body); rows without an id are told apart by their text."""
    return on_keys(docs, common.written(keyed(rows), "keys"), "left_anti")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: Jaccard similarity of five-word shingles from SIMILARITY on, pairs found by PRINTS fingerprints.

    Rows with one id that aren't near copies are documents of their own; of rows with one id and text one stays. Rows without an id stay. Texts without
    words are copies of each other. Of rows that tie for the smallest id the one with the smallest hash of its text stays.
    """
    groups = common.written(simhash.similar_groups(docs, shingle_words=5, max_bits=7, prints=PRINTS, similarity=SIMILARITY), "groups")
    known = groups.filter("doc_id is not null")
    first = F.min(F.struct("doc_id", "body"))
    least = known.groupBy("component").agg(first.alias("first"))
    kept = without(docs, known.join(least, "component").filter(F.struct("doc_id", "body") != F.col("first")).select("doc_id", "body"))
    repeated = common.written(keyed(known.groupBy("doc_id", "body").count().filter("count > 1")), "repeated")
    if not repeated.isEmpty():
        rows = on_keys(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
        kept = on_keys(kept, repeated, "left_anti").unionByName(rows)
    return kept.select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what strings of PASSAGE_BYTES cover that a document with a smaller id has too; every row stays, a null text becomes empty, null ids come first, rows of one id don't cut each other."""
    cut = suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES, keep=("lang", "source"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that are contaminated with benchmark windows (20 * n_hit >= n_words counts as contaminated), those without an id too; an empty benchmark drops none."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_body=True)
    return without(docs, found.filter("contaminated").select("doc_id", "body")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes what is left to the sources' target weights; each row keeps a row, a null source is a source, a text without words takes nothing."""
    return mixing.mix(docs)


#: So many keys of two longs (16 MB) may be broadcast.
SMALL = 1_000_000
#: Independent fingerprints of a text: at a similarity of 0.8 one finds some 23 in 100 pairs (binomial), ten 93.
PRINTS = 10
#: Documents are near copies from this Jaccard similarity of their sets of shingles on.
SIMILARITY = 0.8
#: Some 15 words: passages that documents share go, chance repeats of a few words stay.
PASSAGE_BYTES = 100

STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each result is written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        made = len(common.TABLES)
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, name.replace(" ", "-"))
            own = common.TABLES[-1]
            common.dropped(spark, [*common.TABLES[made:-1], *([before] if before else [])])
            before = own
    return docs

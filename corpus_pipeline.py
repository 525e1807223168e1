"""Corpus preparation: quality rules, language, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Null and empty texts have no words and go in the first stage; a stage that gets some keeps or packs them as its operator's
module says. Repeated rows and null ids are kept, but for the near-duplicate stage, where one row of each group stays: the smallest id,
a null id after all others, and of equal ids the first row. Ties of posterior quality and of language are settled as in `quality` and
`language_id`. An empty table gives an empty table. Extra columns are passed on, whatever their names; very long texts are read whole.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempestry.llm import byte_bpe, language_id, packing, quality, secret_scan, simhash
from tempestry.llm.common import stored, table

#: The least probability of the predicted language.
LEAST_LANGUAGE = 0.5

#: The sequences of the last stage come from a plan that SQL can't express.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is at least a half and that pass the base bounds; without any, no rows."""
    counted = quality.counted_documents(docs, keep=[F.struct("*").alias("row")], text_col="text")
    verdict = quality.judged(counted, quality.fit_supervision(counted))
    return counted.where(verdict["kept"]).select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter go, and all where no text has a known language."""
    model = language_id.fit(docs, ~language_id.held_out(F.col("doc_id")))
    found = language_id.predict_language(F.col("text"), model, spark)
    marked = docs.select(F.struct("*").alias("row"), found.alias("found"))
    known = (F.col("found.lang_pred") != language_id.UNKNOWN) & (F.col("found.score") >= LEAST_LANGUAGE)
    return marked.where(known).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash fingerprints of four-word shingles, at most 4 bits apart."""
    return simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind and n_chars following the text."""
    marked = docs.select(F.struct("*").alias("row"), secret_scan.find_secrets(F.col("text")).alias("spans"))
    clean = marked.select("row", "spans", secret_scan.redact(F.col("row.text"), F.col("spans")).alias("clean"))
    changed = {
        "text": F.col("clean"),
        "n_chars": F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("row.n_chars")),
    }
    return clean.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' tokens in sequences of 1024; a null or empty text is its end token."""
    return packing.pack(docs, byte_bpe.default_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language),
    ("simhash_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

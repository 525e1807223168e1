"""Token counts by an exact length histogram.

Documents are aggregated by encoded length; running sums over the histogram then answer, for every context
limit, how many tokens remain when longer documents are truncated to it or dropped, and every quantile.
The histogram has at most as many rows as there are different lengths. Sums run within ranges of lengths and
over the ranges' totals, so no task sees more than one range or one row per range.

Null and empty texts have length 0. Ids are not used; repeated rows count each time. An empty table gives an
empty histogram, no quantiles and only the limits asked for. Very long texts are encoded whole. Extra columns take no part.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.llm.byte_bpe import byte_bpe
from tempestry.llm.common import text_function

RANGE = 1024
#: Usual context limits and quantiles that are answered beside the lengths that occur.
CONTEXT_LIMITS = tuple(1 << n for n in range(7, 21))
SHARES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


def token_count(text: Column, path: str) -> Column:
    """Number of byte-level BPE ids of a text column, 0 for null."""

    def make():
        bpe = byte_bpe(path)

        def work(texts):
            sizes = [len(bpe.encode(t.decode() if t else None)) for t in texts]
            return pa.array(np.array(sizes, dtype=np.int64) // bpe.dtype.itemsize, pa.int64())

        return work

    return text_function(make, "bigint", "token_count")(text)


def length_histogram(docs: DataFrame, path: str, text="text") -> DataFrame:
    """(n_tokens, docs): how many documents have each encoded length."""
    lengths = docs.select(token_count(F.col(text), path).alias("n_tokens"))
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def limits(histogram: DataFrame, asked=()) -> DataFrame:
    """Per length, and per limit asked for whether it occurs or not, taken as a context limit, from suffix sums.

    docs_over, tokens_over: documents longer than the limit and their tokens; tokens_kept: tokens of the others;
    tokens_truncated: tokens when longer documents are cut to the limit; share_within: documents of at most
    that length, as a share (the length is the quantile of every share up to it and above the previous one).
    A limit asked for that is no length has 0 docs. Between two rows every answer is that of the lower one, but for
    tokens_truncated, which rises by docs_over with each token; so all limits are answered. A null limit is left out.
    """
    if asked:
        wanted = histogram.sparkSession.range(1).select(F.explode(F.array(*[F.lit(int(n)).cast("long") for n in asked])).alias("n_tokens"))
        histogram = histogram.unionByName(wanted.withColumn("docs", F.lit(0).cast("long"))).groupBy("n_tokens").agg(F.sum("docs").alias("docs"))
    tokens = F.col("n_tokens") * F.col("docs")
    cells = histogram.select("*", tokens.alias("tokens"), F.floor(F.col("n_tokens") / RANGE).alias("range"))
    totals = cells.groupBy("range").agg(F.sum("docs").alias("docs_in"), F.sum("tokens").alias("tokens_in"))
    over = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = totals.select(
        "range",
        F.coalesce(F.sum("docs_in").over(over), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("tokens_in").over(over), F.lit(0)).alias("tokens_later"),
        F.sum("docs_in").over(everything).alias("all_docs"),
        F.sum("tokens_in").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    docs_over = F.col("docs_later") + F.coalesce(F.sum("docs").over(inside), F.lit(0))
    tokens_over = F.col("tokens_later") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    return (
        cells.join(totals, "range")
        .withColumns({"docs_over": docs_over, "tokens_over": tokens_over})
        .select(
            "n_tokens",
            "docs",
            "tokens",
            "docs_over",
            "tokens_over",
            (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_kept"),
            (F.col("all_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias(
                "tokens_truncated"
            ),
            F.try_divide(F.col("all_docs") - F.col("docs_over"), F.col("all_docs")).alias("share_within"),
        )
    )


def quantiles(answers: DataFrame, shares) -> DataFrame:
    """(share, n_tokens): the smallest length that at least the share of documents does not exceed."""
    wanted = answers.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    at = answers.where("docs > 0").select(F.explode(F.array(*[F.when(F.col("share_within") >= float(s), F.lit(float(s))) for s in shares])).alias("share"), "n_tokens")
    return wanted.join(at.groupBy("share").agg(F.min("n_tokens").alias("n_tokens")), "share", "left")


def truncated_total(answers: DataFrame, limit: int) -> DataFrame:
    """One row (context_limit, tokens): tokens left when every document is cut to any limit, a length or not."""
    within = F.col("n_tokens") <= limit
    kept = F.sum(F.when(within, F.col("tokens")).otherwise(F.col("docs") * F.lit(limit)))
    return answers.agg(F.coalesce(kept, F.lit(0)).alias("tokens")).select(F.lit(limit).alias("context_limit"), "tokens")

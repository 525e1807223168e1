"""I-Match fingerprints with randomised lexicons.

The lexicon holds the words whose share of documents lies in a band, so neither function words nor accidents
count. A fingerprint is a row of hashes, each of the sorted distinct terms of the text that one random subset of
the lexicon keeps: all terms, a quarter, ... down to a 512th, so that small changes leave most hashes alone. Sparse subsets
are many: where half of a text is replaced, most of its terms change, and only subsets that keep one or two of them agree. Likeness is the share of equal hashes among subsets that keep a term of
either text; two texts without any word are alike (1).

The lexicon's size has a bound that does not depend on the number of documents: a share s of documents can be
reached by at most (mean distinct words of a document) / s words. So it is broadcast.

A text without lexicon terms is hashed by all its words. Words are runs outside ASCII white space, A to Z in
lower case. Null texts count as empty. An empty table gives no rows. Null ids come first, rows of equal id go by text, and
repeated rows are rows of their own. Very long texts are read whole. Ids are numbers.
"""

import hashlib
import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempestry.llm.common import shuffle_partitions, text_function
from tempestry.llm.vocabulary import document_frequencies, words_of

#: Shares of documents that bound the band of inverse document frequency.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.1
#: How many subsets keep which share of the lexicon.
SUBSETS = ((1, 1), (1, 4), (2, 8), (4, 16), (8, 32), (16, 64), (16, 128), (16, 256), (16, 512))
RATES = tuple(1 / part for times, part in SUBSETS for _ in range(times))
EMPTY = "0" * 8


def kept_by(word):
    """Numbers of the subsets that keep a term, drawn by hashes of the term."""
    from xxhash import xxh64_intdigest

    return tuple(k for k, rate in enumerate(RATES) if xxh64_intdigest(word, k) < rate * 2**64)


def build_lexicon(docs: DataFrame, text_col="text", least=LEAST_SHARE, most=MOST_SHARE) -> dict:
    """{term: subsets that keep it} from the document frequencies of the whole table."""
    documents = docs.count()
    # A word of a single document identifies nothing but its own copies in small tables; it stays in the band.
    found = document_frequencies(docs, text_col, math.ceil(least * documents), max(most * documents, 1))
    return {word: kept_by(word) for word in found.select("word").toArrow()["word"].to_pylist()}


def hashes(data, lexicon):
    """The fingerprint of a UTF-8 text: one hash per subset, EMPTY where the subset keeps no term."""
    from xxhash import xxh32_hexdigest

    terms = set(words_of(data))
    own = sorted(filter(lexicon.__contains__, terms))
    kept = [[] for _ in RATES]
    if own:
        for term in own:
            for k in lexicon[term]:
                kept[k].append(term)
    else:
        for term in sorted(terms):
            for k in kept_by(term):
                kept[k].append(term)
    return [xxh32_hexdigest(b" ".join(some), 1) if some else EMPTY for some in kept]


def alike(a, b):
    pairs = [(x, y) for x, y in zip(a, b) if x != EMPTY or y != EMPTY]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


def fingerprint(text: Column, lexicon: dict, spark) -> Column:
    """The fingerprint of a text column: the hashes of all subsets, 8 hexadecimal digits each."""
    sent = spark.sparkContext.broadcast(lexicon)

    def make():
        def work(texts):
            return pa.array(["".join(hashes(t or b"", sent.value)) for t in texts], pa.string())

        return work

    return text_function(make, "string", "imatch_fingerprint")(text)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes of two fingerprint columns."""
    places = F.sequence(F.lit(0), F.lit(len(RATES) - 1))

    def part(x, k):
        return F.substring(x, k * 8 + 1, F.lit(8))

    used = F.filter(places, lambda k: (part(a, k) != EMPTY) | (part(b, k) != EMPTY))
    equal = F.size(F.filter(used, lambda k: part(a, k) == part(b, k)))
    return F.when(F.size(used) == 0, 1.0).otherwise(equal / F.size(used))


def in_sequence(docs: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """(block, next_only, id, text): blocks of ascending ids, each followed by the first row of the next block.

    Blocks are cut at quantiles of the ids. Null ids come first; equal ids go by text. After the last row comes
    the first. Only one row per block is repeated.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shares = [i / blocks for i in range(1, blocks)]
    cuts = rows.select(F.percentile_approx("id", shares or [0.5], 100 * blocks).alias("cuts")).first()["cuts"] or []
    bounds = np.unique(np.array(cuts))

    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            at = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left").astype(np.int32)
            yield pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), np.int32(-1), at), pa.int32())

    rows = rows.select(F.arrow_udf(number, "int")(F.col("id")).alias("block"), "id", "text")
    # One row per block: its first id, then where that block's row goes.
    first = rows.groupBy("block").agg(F.min("id").alias("id"))
    order = Window.orderBy("block")
    first = first.select("block", "id", F.coalesce(F.lag("block").over(order), F.max("block").over(Window.partitionBy())).alias("to"))
    same = (rows["block"] == first["block"]) & rows["id"].eqNullSafe(first["id"])
    heads = rows.join(F.broadcast(first), same).groupBy(first["to"]).agg(F.min(rows["text"]).alias("text"), F.min(rows["id"]).alias("id"))
    heads = heads.select(F.col("to").alias("block"), F.lit(1).alias("next_only"), "id", "text")
    return rows.select("block", F.lit(0).alias("next_only"), "id", "text").unionAll(heads)


RESULT = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def edited(text, following):
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next document's beginning, and how alike they are."""
    spark = docs.sparkSession
    lexicon = spark.sparkContext.broadcast(build_lexicon(docs, text_col))
    blocks = max(2, shuffle_partitions(spark))
    names = [c.split(" ")[0] for c in RESULT.split(", ")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, held = lexicon.value, None
        for batch in batches:
            columns, sources = {name: [] for name in names}, []
            ids = batch.column(2)
            if held is not None:
                ids = pa.concat_arrays([held[2], ids])
            shift = 0 if held is None else 1
            for row, (block, next_only, text) in enumerate(
                zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))), start=shift
            ):
                prints = hashes(text.encode(), terms)
                if held is not None and held[0] == block:
                    changed = edited(held[1], text)
                    data = changed.encode()
                    own, other = held[3], hashes(data, terms)
                    values = (
                        len(held[1]), hashlib.sha256(data).hexdigest(), "".join(own), "".join(other),
                        alike(own, other), alike(own, prints),
                    )
                    for name, value in zip(names, values):
                        columns[name].append(value)
                    sources.append(row - 1)
                held = None if next_only else (block, text, ids.slice(row, 1), prints)
            arrays = [ids.take(pa.array(sources, pa.int64())), *(pa.array(columns[n]) for n in names)]
            if sources:
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *names])

    rows = in_sequence(docs, id_col, text_col, blocks)
    kind = dict(rows.dtypes)["id"]
    rows = rows.repartition(blocks, "block").sortWithinPartitions("block", "next_only", "id", "text")
    return rows.mapInArrow(compare, f"`{id_col}` {kind}, {RESULT}")

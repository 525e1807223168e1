"""Language identification by words first, backing off to shorter and shorter character n-grams.

A known word adds its log frequency in each language. An unseen word adds the mean log frequency of its longest
character n-grams that are known, from 5 characters down to 1, with marks at its ends. The sum, tempered to the
evidence of a few words, gives each language's probability.

The model is fitted on a bounded sample: at most about `sample_per_language` labelled training documents of each
language, chosen by a hash of each row, whole texts. So its size does not grow with the corpus and it is sent
to the executors whole. Prediction reads every whole text.

Words are runs of letters in lower case. Null, empty and other texts without a letter give `und` with score 0, as does
every text when there is no labelled training text. Of languages equally likely the first by name is given. Null
and repeated ids are ids like any other: a null id counts as the empty string where rows are held out. Repeated rows get equal results;
an empty table gives no rows. Very long texts are read whole, as one Arrow value. Extra columns take no part.
"""

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.llm.common import crc_bucket, stored, text_function

SAMPLE_PER_LANGUAGE = 4000
LONGEST = 5
LEAST_WORD, LEAST_GRAM = 2, 3
SMOOTHING = 0.1
#: So many words' worth of evidence decide how sure the answer is.
EVIDENCE = 12
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 50_000
UNKNOWN = "und"


def words_of(text):
    return WORD.findall(text.lower())


def grams_of(word, n):
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def training_sample(docs: DataFrame, training: Column, per_language: int) -> DataFrame:
    """(lang, text): labelled training texts, of each language about per_language at most.

    Each row is drawn apart, by a hash of its id, its text and its place in the table, so neither rows without an id nor
    copies are drawn or left out together.
    """
    labelled = docs.select("doc_id", "lang", "text").where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    hashed = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = labelled.withColumn("drawn", hashed).join(F.broadcast(sizes), "lang")
    return chosen.where(F.col("drawn") * F.col("n") < per_language).select("lang", "text")


def counted(rows: DataFrame, of, columns: str) -> DataFrame:
    """(lang, item, n): items of each task are counted before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                of(counts, *row)
        langs, items = zip(*counts) if counts else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(items, pa.string()), pa.array(counts.values(), pa.int64())],
            names=["lang", "item", "n"],
        )

    found = rows.select(*columns.split()).mapInArrow(count, "lang string, item string, n bigint")
    return found.groupBy("lang", "item").agg(F.sum("n").alias("n"))


def count_words(counts, lang, text):
    counts.update((lang, word) for word in words_of(text))


def count_grams(counts, lang, word, n):
    for size in range(1, LONGEST + 1):
        for gram in grams_of(word, size):
            counts[lang, gram] += n


@dataclass
class Model:
    """Log frequencies by language: a row of `table` for each word in `words` and n-gram in `grams`."""

    languages: list
    words: dict
    grams: dict
    table: np.ndarray

    def unseen(self, word):
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            found = [i for i in map(self.grams.get, grams_of(word, n)) if i is not None]
            if found:
                return self.table[found].mean(axis=0)
        return np.zeros(len(self.languages))

    def predictor(self):
        remembered = {}

        def predict(text):
            words = words_of(text) if text else []
            if not self.languages or not any(map(str.isalpha, chain.from_iterable(words))):
                return UNKNOWN, 0.0
            rows = list(map(self.words.get, words))
            known = [i for i in rows if i is not None]
            total = self.table[known].sum(axis=0) if known else np.zeros(len(self.languages))
            if len(known) < len(words):
                if len(remembered) > REMEMBERED:
                    remembered.clear()
                for word in (w for w, i in zip(words, rows) if i is None):
                    row = remembered.get(word)
                    if row is None:
                        row = remembered[word] = self.unseen(word)
                    total = total + row
            odds = total * min(1.0, EVIDENCE / len(words))
            odds = np.exp(odds - odds.max())
            best = int(np.argmax(odds))
            return self.languages[best], float(odds[best] / odds.sum())

        return predict


def frequencies(counts: DataFrame, least, group):
    """Languages, {item: row} and log frequencies, smoothed within each group of items (words, n-grams of one length)."""
    table = counts.toArrow().to_pydict()
    items = sorted(zip(table["lang"], table["item"], table["n"]))
    languages = sorted({lang for lang, _, _ in items})
    totals = Counter()
    for _, item, n in items:
        totals[item] += n
    index = {item: i for i, item in enumerate(sorted(item for item, n in totals.items() if n >= least))}
    counts = np.zeros((len(index), len(languages)))
    column = {lang: i for i, lang in enumerate(languages)}
    for lang, item, n in items:
        if item in index:
            counts[index[item], column[lang]] = n
    groups = np.array([group(item) for item in index], dtype=np.int64)
    for g in np.unique(groups):
        own = groups == g
        total = counts[own].sum(axis=0) + SMOOTHING * own.sum()
        counts[own] = np.log((counts[own] + SMOOTHING) / total)
    return languages, index, counts


def fit(docs: DataFrame, training: Column, per_language=SAMPLE_PER_LANGUAGE) -> Model:
    """The model of a table (doc_id, text, lang); only rows where `training` holds and lang is known count."""
    words = stored(counted(training_sample(docs, training, per_language), count_words, "lang text"), "language-words")
    languages, index, rows = frequencies(words, LEAST_WORD, lambda _: 0)
    grams = counted(words, count_grams, "lang item n")
    _, gram_index, gram_rows = frequencies(grams, LEAST_GRAM, len)
    grams = {gram: i + len(index) for gram, i in gram_index.items()}
    return Model(languages, index, grams, np.concatenate([rows, gram_rows]).astype(np.float64))


PREDICTION = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def predict_language(text: Column, model: Model, spark) -> Column:
    """struct<lang_pred, score> of a text column."""
    sent = spark.sparkContext.broadcast(model)

    def make():
        predict = sent.value.predictor()

        def work(texts):
            found = [predict(t.decode() if t else None) for t in texts]
            langs, scores = zip(*found) if found else ((), ())
            return pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"]
            )

        return work

    return text_function(make, "struct<lang_pred:string,score:double>", "predict_language")(text)


def held_out(id_column: Column) -> Column:
    return crc_bucket(id_column, 5) == 0

"""Embeddings of texts: by hash, and learned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """The bytes of a text's SHA-256, repeated to `dim` numbers and scaled to length 1."""
    hexed = F.sha2(text.cast("binary"), 256)
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(hexed, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double"))
    norm = F.sqrt(F.aggregate(bytes_, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(bytes_, lambda x: x / F.nullif(norm, F.lit(0.0)))


#: The most texts, by the order of a hash, that word vectors are fitted on.
MAX_FIT = 20_000
#: What passes shift 64-bit numbers by: each counts by twelve more of their leading bits.
_SHIFTS = (52, 40, 28, 16, 4, 0)


def first_rows(df: DataFrame, by: Sequence[Column], n: int) -> DataFrame:
    """The first n rows by 64-bit numbers, in that order, in one partition.

    Passes count rows by the numbers' leading bits, and the cell that holds the n-th is counted by more bits, until at most n / 8 rows more
    than n are left. Only these are sorted, so the task that does so reads no more of a larger table. Rows equal in all numbers are copies.
    """
    sure, cell, want = F.lit(False), F.lit(True), n
    for x, shift in [(x, shift) for x in by for shift in _SHIFTS]:
        lead = F.shiftright(x, shift)
        counts = sorted(df.where(cell).groupBy(lead.alias("_lead")).agg(F.count("*")).collect())  # 4096 rows at most
        for upto, here in counts:
            if here >= want:
                break
            want -= here
        else:
            return df.orderBy(*by).limit(n)  # fewer than n rows
        if here - want <= n // 8:
            return df.where(sure | (cell & (lead <= upto))).orderBy(*by).limit(n)
        sure, cell = sure | (cell & (lead < upto)), cell & (lead == upto)
    copies = df.where(cell).limit(1).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(want)))).drop("_copy")
    return df.where(sure).unionByName(copies).orderBy(*by).limit(n)


def learned_embedding(df: DataFrame, key: str, text: str, dim: int = 32, max_fit: int = MAX_FIT) -> DataFrame:
    """(key, embedding): the mean of word vectors learned from at most max_fit of the texts, of length 1; zeros for a text without known words."""
    rows = df.select(key, text)
    with_words = lambda d: d.select(key, F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("_w"))
    fitted = first_rows(rows, [F.xxhash64(key), F.xxhash64(text)], max_fit)
    model = Word2Vec(vectorSize=dim, minCount=5, maxIter=1, numPartitions=1, seed=7, inputCol="_w", outputCol="_v").fit(with_words(fitted))
    vectors = model.transform(with_words(rows)).select(key, vector_to_array("_v").alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.withColumn("_n", norm).select(key, F.transform("_v", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0)).alias("embedding"))

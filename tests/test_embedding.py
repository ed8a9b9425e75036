"""The rows that word vectors are fitted on: the first by a hash, without one task that reads all rows."""

from pyspark.sql import functions as F

from tidemark.functions import vectors as V


def rows(spark, n=5000, key="id"):
    return spark.range(0, n, 1, 8).select(F.expr(key).cast("bigint").alias("doc_id"), F.concat(F.lit("the same words again and "), F.col("id") % 7).alias("text"))


def test_one_task_reads_few_more_texts_than_are_fitted(spark, monkeypatch):
    seen = []

    def fit(self, data, real=V.Word2Vec.fit):
        ids = [r[0] for r in data.select("doc_id").rdd.collect()]
        again = data.select("*")
        again.rdd.count()
        metrics = again._jdf.queryExecution().executedPlan().metrics()
        seen.append((ids, metrics.apply("shuffleRecordsWritten").value()))
        return real(self, data)

    monkeypatch.setattr(V.Word2Vec, "fit", fit)
    df = rows(spark)
    assert V.learned_embedding(df, "doc_id", "text", dim=4, max_fit=64).count() == 5000
    (ids, read), = seen
    assert ids == [r[0] for r in df.orderBy(F.xxhash64("doc_id")).limit(64).collect()]
    assert 64 <= read <= 72, "the local limits of 8 tasks sent 64 rows each"


def test_first_rows_with_equal_numbers(spark):
    for key, n in (("id", 64), ("id", 4999), ("id", 5000), ("id", 9000), ("id % 3", 64), ("null", 64), ("if(id < 9, id, null)", 3000)):
        df = rows(spark, key=key)
        by = [F.xxhash64("doc_id"), F.xxhash64("text")]
        got = [tuple(r) for r in V.first_rows(df, by, n).collect()]
        assert got == [tuple(r) for r in df.orderBy(*by).limit(n).collect()], (key, n)
    assert V.first_rows(rows(spark).limit(0), by, 5).count() == 0

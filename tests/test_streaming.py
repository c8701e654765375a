import os

from pyspark.sql import functions as F

from lendscope.plans import model as ML
from lendscope.streaming.scoring import score_stream


def test_stream_scoring_equals_batch(spark, tmpdir_path):
    feats = ["x1", "x2"]
    base = spark.range(200).select(F.col("id").alias("account_id"),
                                   ((F.col("id") * 37 % 101) / 101.0).alias("x1"),
                                   ((F.col("id") * 53 % 97) / 97.0).alias("x2"))
    train = ML.assemble(base.withColumn("good_status_loan", (F.col("x1") > 0.5).cast("int")), feats)
    models = [ML.fit_logit(train, C=10.0)]
    src = os.path.join(tmpdir_path, "in")
    base.write.parquet(src)
    stream = spark.readStream.schema(base.schema).parquet(src)
    q = (score_stream(stream, models, cut=0.9, features=feats)
         .writeStream.format("memory").queryName("tiers_test").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = {r.account_id: r.tier for r in spark.sql("SELECT * FROM tiers_test").collect()}
    want = {r.account_id: r.tier for r in score_stream(base, models, cut=0.9, features=feats).collect()}
    assert got == want and len(got) == 200

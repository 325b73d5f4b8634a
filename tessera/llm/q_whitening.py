"""Registered query of embedding whitening."""

from pyspark.sql import functions as F

from .whitening import whiten


def components_of(vectors):
    """One row for each remaining vector and component."""
    rows, model = whiten(vectors)
    n, error = (model.n, model.identity_error) if model else (0, 0.0)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values]) if model and len(model.values) else F.array().cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))


def op12_embedding_whitening(spark, sf_dir):
    return components_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

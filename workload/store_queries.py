"""Indexes, stores and key joins between vectors, labels and families."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions.text import build_key, set_name
from spanforge.operators import quality as Q
from spanforge.session import shared_folder
from spanforge.sources import sinks, tables
from workload.registry import query, table
from workload.text_queries import SQL_CLEAN, cleaned_documents


@query("embedding_key_index", "protein_id:i key:s family:s length:i",
       """SELECT vec_id AS protein_id, vec_id || '-' || label AS key, CAST(label AS VARCHAR) AS family,
            length(embedding) AS length FROM embeddings""")
def embedding_key_index(spark, d):
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("protein_id"),
        build_key(F.col("vec_id"), F.col("label")).alias("key"),
        F.col("label").cast("string").alias("family"),
        F.size("embedding").alias("length"),
    )
    return tables.embedding_index(rows)


@query("last_label_shard", "protein_id:i shard:s",
       "SELECT l_orderkey AS protein_id, max('shard_' || l_linenumber) AS shard FROM lineitem GROUP BY l_orderkey")
def last_label_shard(spark, d):
    return tables.label_index(_shards(spark, d))


@query("labels_of_last_shard", "protein_id:i shard:s q:d",
       """WITH s AS (SELECT l_orderkey AS protein_id, 'shard_' || l_linenumber AS shard, l_quantity AS q FROM lineitem)
          SELECT protein_id, shard, q FROM s JOIN (SELECT protein_id, max(shard) AS shard FROM s GROUP BY protein_id)
          USING (protein_id, shard)""")
def labels_of_last_shard(spark, d):
    return tables.keep_last_shard(_shards(spark, d))


def _shards(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("protein_id"), F.concat(F.lit("shard_"), F.col("l_linenumber")).alias("shard"),
        F.col("l_quantity").alias("q"),
    )


@query("vector_store_round_trip", "protein_id:i pos:i dim:i total:d",
       """SELECT vec_id // 50 AS protein_id, vec_id % 50 AS pos, length(embedding) AS dim,
            list_sum([CAST(x AS DOUBLE) FOR x IN embedding]) AS total FROM embeddings""")
def vector_store_round_trip(spark, d):
    rows = table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 50).alias("protein_id"), (F.col("vec_id") % 50).alias("pos"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
    path = f"{shared_folder(spark)}/vectors"
    sinks.write_vectors(rows, path, buckets=8)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(path).select("protein_id", "pos", F.size("vec").alias("dim"), total.alias("total"))


@query("sequence_families", "id:i length:i family:s",
       f"SELECT doc_id AS id, length({SQL_CLEAN}) AS length, CAST(doc_id % 13 AS VARCHAR) AS family FROM documents")
def sequence_families(spark, d):
    docs = cleaned_documents(spark, d).select(F.col("doc_id").alias("id"), F.length("sequence").alias("length"))
    families = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.col("doc_id") % 13, F.lit(".0")).alias("family")
    )
    return Q.attach_families(docs, families)


@query("trainable_ids", "id:i length:i",
       f"""SELECT doc_id AS id, length({SQL_CLEAN}) AS length FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def trainable_ids(spark, d):
    docs = cleaned_documents(spark, d).select(F.col("doc_id").alias("id"), F.length("sequence").alias("length"))
    labelled = docs.join(table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return Q.trainable_ids(docs, labelled)


@query("run_statuses", "set_name:s status:s n:i",
       """SELECT 'set_' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS set_name,
            CASE WHEN s_suppkey % 5 > 0 AND s_acctbal > 0 THEN 'OK' ELSE 'NO_VALID_SCORE' END AS status, count(*) AS n
          FROM supplier GROUP BY ALL""")
def run_statuses(spark, d):
    metric = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).otherwise(float("nan"))
    status = Q.run_status(F.col("s_suppkey") % 5 - 1, metric)
    return table(spark, d, "supplier").groupBy(set_name(F.col("s_nationkey")).alias("set_name"), status.alias("status")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("selected_codes", "CodeName:s LabelSource:s",
       """SELECT 'C' || p_partkey AS CodeName, 'nonreactive' AS LabelSource FROM part WHERE p_partkey % 3 = 1""")
def selected_codes(spark, d):
    from spanforge.operators.assay import labelled_codes
    from workload.assay_queries import code_sets

    return labelled_codes(*code_sets(spark, d), mode="nonreactive")

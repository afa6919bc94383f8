"""Headers, keys, cleaning, sources and sinks over parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.operators import quality as Q
from spanforge.operators.ranking import first_k, round_robin_shards
from spanforge.operators.ranking import contiguous_chunks as chunked
from spanforge.session import cut_lineage, shared_folder
from spanforge.sources import sinks, tables
from spanforge.sources.fasta import fasta_lines, number_missing_headers, read_fasta, write_fasta
from workload.registry import query, table


# Parts as designed peptides: a strict header with an alignment suffix.
def part_headers(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    oxx = F.concat_ws(",", size.cast("string"), (k % 7).cast("string"), F.concat_ws("_", k % 13, k % 90, k % 90 + size))
    good = F.concat(F.lit("ID=P"), k, F.lit("_X AC=A"), k, F.lit(" OXX="), oxx)
    return table(spark, d, "part").select(
        "p_partkey", F.when(k % 10 == 3, F.concat(F.lit("free text "), F.col("p_name"))).otherwise(good).alias("name")
    )


SQL_PART_HEADERS = """part_headers AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN 'free text ' || p_name
    ELSE 'ID=P' || p_partkey || '_X AC=A' || p_partkey || ' OXX=' || p_size || ',' || (p_partkey % 7) || ','
         || (p_partkey % 13) || '_' || (p_partkey % 90) || '_' || (p_partkey % 90 + p_size) END AS name FROM part)"""


@query("parse_headers", "p_partkey:i id:s ac:s oxx:s family:s start:i stop:i stripped:s rebuilt:s",
       f"""WITH {SQL_PART_HEADERS}
       SELECT p_partkey, CASE WHEN ok THEN 'P' || p_partkey || '_X' END AS id, CASE WHEN ok THEN 'A' || p_partkey END AS ac,
         CASE WHEN ok THEN split_part(name, 'OXX=', 2) END AS oxx,
         CASE WHEN ok THEN list_last(string_split(name, ',')) END AS family,
         CASE WHEN ok THEN p_partkey % 90 END AS start,
         CASE WHEN ok THEN CAST(list_last(string_split(name, '_')) AS BIGINT) END AS stop,
         CASE WHEN ok THEN left(name, length(name) - length('_' || list_last(string_split(name, '_')))
              - length('_' || (p_partkey % 90))) ELSE name END AS stripped,
         'ID=' || p_partkey || ' AC=' || p_partkey || ' OXX=0,0,0,' || (p_partkey % 13) AS rebuilt
       FROM (SELECT *, name LIKE 'ID=%' AS ok FROM part_headers)""")
def parse_headers(spark, d):
    name = F.col("name")
    return part_headers(spark, d).select(
        "p_partkey",
        *[X.fullname_part(name, g).alias(n) for g, n in ((1, "id"), (2, "ac"), (3, "oxx"))],
        X.family_of(X.fullname_part(name, 3)).alias("family"),
        X.align_suffix(name, 1).alias("start"),
        X.align_suffix(name, 2).alias("stop"),
        X.strip_align_suffix(name).alias("stripped"),
        X.build_fullname(F.col("p_partkey").cast("string"), F.col("p_partkey") % 13).alias("rebuilt"),
    )


@query("header_accessions", "p_partkey:i accession:s prediction:s",
       f"""WITH {SQL_PART_HEADERS}, h AS (SELECT p_partkey, name, CASE p_partkey % 4 WHEN 0 THEN 'tr|A' || p_partkey || '|N x'
           WHEN 1 THEN 'sp|| ' || p_name WHEN 2 THEN 'B' || p_partkey || ' ' || p_name ELSE 'sp|C' || p_partkey END AS header
           FROM part_headers JOIN part USING (p_partkey))
       SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'A' || p_partkey WHEN 1 THEN 'sp||'
           WHEN 2 THEN 'B' || p_partkey ELSE 'C' || p_partkey END AS accession,
         CASE WHEN name LIKE 'ID=%' THEN 'P' || p_partkey || '_X' ELSE 'free' END AS prediction FROM h""")
def header_accessions(spark, d):
    k = F.col("p_partkey")
    header = (
        F.when(k % 4 == 0, F.concat(F.lit("tr|A"), k, F.lit("|N x")))
        .when(k % 4 == 1, F.concat(F.lit("sp|| "), F.col("p_name")))
        .when(k % 4 == 2, F.concat(F.lit("B"), k, F.lit(" "), F.col("p_name")))
        .otherwise(F.concat(F.lit("sp|C"), k))
    )
    rows = part_headers(spark, d).join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    return rows.select("p_partkey", X.accession_of(header).alias("accession"),
                       X.prediction_id(F.col("name")).alias("prediction"))


@query("embedding_keys", "p_partkey:i key:s id:s family:s scheme:s cleaned:s",
       """WITH k AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '12.0' WHEN 2 THEN ' NaN '
              ELSE CAST(p_size AS VARCHAR) END AS raw FROM part),
          f AS (SELECT *, CASE p_partkey % 4 WHEN 1 THEN '12' WHEN 3 THEN CAST(p_size AS VARCHAR) ELSE '' END AS fam FROM k)
          SELECT p_partkey, 'A-' || p_partkey || CASE WHEN fam = '' THEN '' ELSE '-' || fam END AS key,
            CASE WHEN fam = '' THEN 'A' ELSE 'A-' || p_partkey END AS id,
            CASE WHEN fam = '' THEN CAST(p_partkey AS VARCHAR) ELSE fam END AS family, 'id-family' AS scheme,
            fam AS cleaned FROM f""")
def embedding_keys(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 1, "12.0").when(k % 4 == 2, " NaN ").when(k % 4 == 3, F.col("p_size").cast("string"))
    fam = X.normalize_family(raw)
    key = X.build_key(F.concat(F.lit("A-"), k), fam)
    rows = table(spark, d, "part").select("p_partkey", key.alias("key"), fam.alias("cleaned"))
    return rows.select("p_partkey", "key", "cleaned", X.parse_key(F.col("key")).alias("p")).select(
        "p_partkey", "key", "p.*", "cleaned"
    )


@query("rekey_outcomes", "shard:s key:s new_key:s outcome:s",
       """WITH fam AS (SELECT 'P' || p_partkey AS id, CAST(p_size AS VARCHAR) AS family FROM part WHERE p_partkey % 11 <> 0),
         keys AS (SELECT CAST(p_partkey % 4 AS VARCHAR) AS shard, 'P' || p_partkey
                    || CASE WHEN p_partkey % 5 = 0 THEN '-' || p_size ELSE '' END AS key FROM part
                  UNION ALL SELECT CAST(p_partkey % 4 AS VARCHAR), 'P' || p_partkey || '-' || p_size FROM part
                  WHERE p_partkey % 7 = 1 AND p_partkey % 5 <> 0),
         named AS (SELECT shard, key, f.id, f.family, regexp_extract(key, '^(.+)-(\\d+)$', 1) AS pid,
                     regexp_extract(key, '^(.+)-(\\d+)$', 2) AS pfam FROM keys LEFT JOIN fam f ON f.id = key)
         SELECT n.shard, n.key, CASE WHEN n.id IS NOT NULL THEN n.key || '-' || n.family END AS new_key,
           CASE WHEN n.id IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM keys k WHERE k.shard = n.shard
                  AND k.key = n.key || '-' || n.family) THEN 'collision' ELSE 'renamed' END
                WHEN EXISTS (SELECT 1 FROM fam f WHERE f.id = n.pid AND f.family = n.pfam) THEN 'already'
                ELSE 'missing_id' END AS outcome FROM named n""")
def rekey_outcomes(spark, d):
    part = table(spark, d, "part")
    k, fam = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.concat(F.lit("P"), k)
    shard = (k % 4).cast("string").alias("shard")
    long = F.concat_ws("-", name, fam)
    keys = part.select(shard, F.when(k % 5 == 0, long).otherwise(name).alias("key")).unionByName(
        part.filter((k % 7 == 1) & (k % 5 != 0)).select(shard, long.alias("key"))
    )
    families = part.filter(k % 11 != 0).select(name.alias("id"), fam.alias("family"))
    return Q.rekey_outcome(keys, families)


SQL_CLEAN = "regexp_replace(upper(replace(text, 'ß', 'SS')), '[^ACDEFGHIKLMNPQRSTVWYBZXUO]', '', 'g')"


def cleaned_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", X.clean_sequence(F.col("text")).alias("sequence"))


@query("clean_sequences", "doc_id:i length:i digest:s",
       f"SELECT doc_id, length(s) AS length, md5(s) AS digest FROM (SELECT doc_id, {SQL_CLEAN} AS s FROM documents)")
def clean_sequences(spark, d):
    return cleaned_documents(spark, d).select("doc_id", F.length("sequence").alias("length"),
                                              F.md5("sequence").alias("digest"))


@query("fasta_records", "digest:s",
       f"""SELECT md5('>' || CASE WHEN doc_id % 3 = 0 THEN 'sequence_' || lpad(CAST(pos AS VARCHAR), 5, '0')
             ELSE 'D' || doc_id END || chr(10) || s) AS digest
           FROM (SELECT doc_id, {SQL_CLEAN} AS s, row_number() OVER (ORDER BY doc_id) AS pos FROM documents)""")
def fasta_records(spark, d):
    docs = cleaned_documents(spark, d).withColumn(
        "header", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("D"), F.col("doc_id")))
    )
    return fasta_lines(number_missing_headers(docs, [F.col("doc_id")])).select(F.md5("value").alias("digest"))


@query("fasta_round_trip", "id:s ac:s oxx:s length:i digest:s",
       f"""SELECT 'D' || doc_id AS id, 'A' || doc_id AS ac, '1,2,' || doc_id AS oxx, length(s) AS length, md5(s) AS digest
           FROM (SELECT doc_id, {SQL_CLEAN} AS s FROM documents)""")
def fasta_round_trip(spark, d):
    k = F.col("doc_id").cast("string")
    header = F.concat(F.lit("ID=D"), k, F.lit(" AC=A"), k, F.lit(" OXX=1,2,"), k)
    path = f"{shared_folder(spark)}/targets"
    write_fasta(cleaned_documents(spark, d).withColumn("header", header), path)
    return read_fasta(spark, path, mode="strict").select(
        "id", "ac", "oxx", F.length("sequence").alias("length"), F.md5("sequence").alias("digest")
    )


@query("tsv_metadata_source", "CodeName:s FullName:s AlignStart:i AlignStop:i Peptide:s",
       """SELECT 'C' || p_partkey AS CodeName, 'ID=P' || p_partkey || ' AC=A OXX=1,' || p_size AS FullName,
            p_partkey % 90 AS AlignStart, p_partkey % 90 + p_size AS AlignStop,
            CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE p_name END AS Peptide
          FROM part WHERE p_type = 'ECONOMY'""")
def tsv_metadata_source(spark, d):
    k = F.col("p_partkey").cast("string")
    rows = table(spark, d, "part").select(
        F.concat(F.lit("C"), k).alias("CodeName"),
        F.when(F.col("p_type") == "ECONOMY", "SetCover").otherwise(F.col("p_type")).alias("Category"),
        F.concat(F.lit("ID=P"), k, F.lit(" AC=A OXX=1,"), F.col("p_size"), F.lit("_"), F.col("p_partkey") % 90,
                 F.lit("_"), F.col("p_partkey") % 90 + F.col("p_size")).alias("FullName"),
        F.when(F.col("p_brand") == "Brand#1", "NA").otherwise(F.col("p_name")).alias("Peptide"),
    )
    path = f"{shared_folder(spark)}/meta"
    sinks.write_table(rows, path, sep="\t")
    return tables.read_assay_metadata(spark, path, drop_cols=["Category"])


@query("code_list_source", "CodeName:s", "SELECT DISTINCT p_brand AS CodeName FROM part")
def code_list_source(spark, d):
    path = f"{shared_folder(spark)}/codes"
    rows = table(spark, d, "part").select(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")).alias("Sequence name"), "p_name")
    sinks.write_table(rows, path, sep="\t")
    return tables.read_codes(spark, path)


@query("run_log_append", "fold:s n_rows:i",
       "SELECT l_returnflag AS fold, 2 * count(*) AS n_rows FROM lineitem GROUP BY l_returnflag")
def run_log_append(spark, d):
    path = f"{shared_folder(spark)}/runs"
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("fold"), "l_quantity")
    sinks.append_runs(rows, path)
    sinks.append_runs(rows, path)
    return spark.read.parquet(path).groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))


@query("strict_json_documents", "c_custkey:i name:s balance:d first:d",
       """SELECT c_custkey, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance,
            CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS DOUBLE) END AS first FROM customer""")
def strict_json_documents(spark, d):
    nan = F.lit(float("nan"))
    rows = table(spark, d, "customer").select(
        "c_custkey",
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(float("inf")).alias("balance"),
        F.array(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("double")).otherwise(nan)).alias("values"),
    )
    schema = "c_custkey bigint, name string, balance double, values array<double>"
    back = sinks.strict_json(rows).select(F.from_json("value", schema).alias("j")).select("j.*")
    return back.withColumn("first", F.col("values")[0])


@query("union_by_keys", "key:i name:s nation:i segment:s",
       """SELECT c_custkey AS key, c_name AS name, NULL AS nation, c_mktsegment AS segment FROM customer
          UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL FROM supplier""")
def union_by_keys(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                                              F.col("c_mktsegment").alias("segment"))
    right = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
                                               F.col("s_nationkey").alias("nation"))
    return sinks.union_by_keys(left, right)


@query("ambiguous_sequences", "accession:s ambiguous:b digest:s",
       f"""SELECT accession, min(s) <> max(s) AS ambiguous, md5(min(s)) AS digest FROM (
             SELECT lang || ':' || source || ':' || n_chars AS accession, {SQL_CLEAN} AS s FROM documents)
           GROUP BY accession""")
def ambiguous_sequences(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select(F.concat_ws(":", "lang", "source", "n_chars").alias("accession"),
                       X.clean_sequence(F.col("text")).alias("sequence"))
    return Q.resolve_sequences(rows, "accession").withColumn("digest", F.md5("sequence"))


@query("deduplicated_keys", "key:s n_dropped:i conflict:b",
       f"""SELECT md5(s) AS key, count(*) - 1 AS n_dropped, min(lang) <> max(lang) AS conflict FROM (
             SELECT {SQL_CLEAN} AS s, lang FROM documents) GROUP BY md5(s)""")
def deduplicated_keys(spark, d):
    rows = cleaned_documents(spark, d).select(F.md5("sequence").alias("key"), F.col("lang").alias("sequence"))
    return Q.dedupe_keys(rows, "key")


@query("family_consistency", "id:i family:s n_duplicates:i conflict:b",
       """SELECT l_partkey AS id, min(l_returnflag) AS family, count(*) - 1 AS n_duplicates,
            min(l_returnflag) <> max(l_returnflag) AS conflict FROM lineitem GROUP BY l_partkey""")
def family_consistency(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("family"))
    return Q.family_map(rows, "id", "family")


@query("ids_in_several_shards", "id:i n_shards:i",
       """SELECT l_suppkey AS id, count(DISTINCT l_linenumber) AS n_shards FROM lineitem
          GROUP BY l_suppkey HAVING count(DISTINCT l_linenumber) > 1""")
def ids_in_several_shards(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("shard"))
    return Q.shared_across(rows, "id", "shard")


@query("missing_id_report", "n_missing:i examples:s",
       """WITH gone AS (SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
          SELECT count(*) AS n_missing, (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FROM
            (SELECT doc_id FROM gone ORDER BY doc_id LIMIT 20)) AS examples FROM gone""")
def missing_id_report(spark, d):
    report = Q.missing_report(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")
    return report.withColumn("examples", F.array_join("examples", ","))


@query("numeric_coalesce", "event_id:i number:d parsed:s",
       """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN CAST(event_id AS DOUBLE) END AS number,
            CASE WHEN event_id % 4 = 0 THEN event_type ELSE '' END AS parsed FROM events""")
def numeric_coalesce(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select(
        "event_id",
        F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("value"))).when(k % 3 == 1, "n/a").otherwise("NaN").alias("a"),
        F.when(k % 3 == 2, "x1").otherwise(k.cast("string")).alias("b"),
        F.when(k % 4 == 0, F.concat(F.lit("  "), F.col("event_type"))).when(k % 4 == 1, " nan").when(k % 4 == 2, "\t")
        .alias("c"),
    )
    return rows.select("event_id", X.first_numeric(["a", "b"]).alias("number"), X.clean_text(F.col("c")).alias("parsed"))


@query("length_sorted_shards", "doc_id:i shard:i",
       f"""SELECT doc_id, (row_number() OVER (ORDER BY length(s), doc_id) - 1) % 7 AS shard
           FROM (SELECT doc_id, {SQL_CLEAN} AS s FROM documents)""")
def length_sorted_shards(spark, d):
    # Ranking reads its input several times: clean the texts once.
    sizes = cut_lineage(cleaned_documents(spark, d).select("doc_id", F.length("sequence").alias("length")))
    return round_robin_shards(sizes, [F.col("length"), F.col("doc_id")], 7)


@query("contiguous_chunks", "doc_id:i chunk:i",
       "SELECT doc_id, ntile(9) OVER (ORDER BY doc_id) - 1 AS chunk FROM documents")
def contiguous_chunks(spark, d):
    return chunked(table(spark, d, "documents").select("doc_id"), [F.col("doc_id")], 9)


@query("first_sorted_ids", "o_orderkey:i", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50")
def first_sorted_ids(spark, d):
    return first_k(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], 50)


@query("length_features", "vec_id:i size:i last_raw:d last_inverse:d",
       """SELECT vec_id, length(embedding) + 1 AS size, CAST(vec_id % 50 + 1 AS DOUBLE) AS last_raw,
            1.0 / (vec_id % 50 + 1) AS last_inverse FROM embeddings""")
def length_features(spark, d):
    n = F.col("vec_id") % 50 + 1
    raw = X.length_feature(F.col("embedding"), n, "raw")
    inverse = X.length_feature(F.col("embedding"), n, "inverse")
    return table(spark, d, "embeddings").select(
        "vec_id", F.size(raw).alias("size"), F.element_at(raw, -1).alias("last_raw"),
        F.element_at(inverse, -1).alias("last_inverse"),
    )


@query("parsed_lists", "p_partkey:i n:i total:i",
       "SELECT p_partkey, 3 AS n, p_partkey + p_size + 7 AS total FROM part")
def parsed_lists(spark, d):
    raw = F.concat(F.col("p_partkey"), F.lit(" ,, "), F.col("p_size"), F.lit(",7"))
    values = X.parse_list(raw, "bigint", "seeds")
    return table(spark, d, "part").select(
        "p_partkey", F.size(values).alias("n"),
        F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"),
    )

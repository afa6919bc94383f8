"""Assay preparation: reactivity classes, quarantine, group ids, prepared contracts.

Mapping: parts are peptides, documents are proteins (cleaned text), line items
are code-list metadata rows, line numbers or event types are subjects.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import assay as A
from spanforge.operators import quality as Q
from spanforge.plans.prepare import finalize, prepare_evaluation, prepare_listed
from spanforge.session import shared_folder
from spanforge.sources.sinks import write_table
from spanforge.sources.tables import read_zscores, unpivot_scores
from workload.registry import query, table
from workload.text_queries import SQL_CLEAN, cleaned_documents

_ROW = "n_reactive:i n_nonreactive:i is_def:i is_unc:i is_not:i"
_SQL_CLASSES = """SELECT id, n_reactive, n_nonreactive, CASE WHEN d THEN 1 ELSE 0 END AS is_def,
    CASE WHEN NOT d AND NOT n THEN 1 ELSE 0 END AS is_unc, CASE WHEN n THEN 1 ELSE 0 END AS is_not FROM classed"""


def _class_names(df):
    return df.withColumnsRenamed({"Def epitope": "is_def", "Uncertain": "is_unc", "Not epitope": "is_not"})


def part_zscores(spark, d):
    """Best quantity per part and line number; seven subjects by design."""
    return table(spark, d, "lineitem").groupBy(
        F.col("l_partkey").alias("CodeName"), F.col("l_linenumber").alias("subject")
    ).agg(F.max("l_quantity").alias("z")).withColumn("n_subjects", F.lit(7))


_SQL_PART_Z = """z AS (SELECT l_partkey AS id, l_linenumber AS subject, max(l_quantity) AS z FROM lineitem GROUP BY ALL),
    counted AS (SELECT id, count(*) FILTER (WHERE z >= 40) AS n_reactive, count(*) FILTER (WHERE z < 30) AS n_nonreactive
                FROM z GROUP BY id)"""
_THRESHOLDS = {"reactive_min": 40.0, "min_subjects": 4, "nonreactive_max": 30.0}


@query("reactivity_classes", f"CodeName:i {_ROW}",
       f"""WITH {_SQL_PART_Z}, classed AS (SELECT *, n_reactive >= 4 AS d, n_nonreactive = 7 AS n FROM counted)
           SELECT id AS CodeName, * FROM ({_SQL_CLASSES})""")
def reactivity_classes(spark, d):
    return _class_names(A.classify_reactivity(part_zscores(spark, d), **_THRESHOLDS))


@query("reactivity_classes_max_subjects", f"CodeName:i {_ROW}",
       f"""WITH {_SQL_PART_Z}, classed AS (SELECT *, n_reactive >= 4 AS d, n_nonreactive >= 3 AND n_reactive = 0 AS n
           FROM counted) SELECT id AS CodeName, * FROM ({_SQL_CLASSES})""")
def reactivity_classes_max_subjects(spark, d):
    return _class_names(A.classify_reactivity(part_zscores(spark, d), max_subjects=3, **_THRESHOLDS))


@query("metadata_with_classes", "CodeName:i p_name:s is_def:i is_not:i",
       f"""WITH {_SQL_PART_Z} SELECT p_partkey + 100 AS CodeName, p_name,
             CASE WHEN n_reactive IS NOT NULL THEN CASE WHEN n_reactive >= 4 THEN 1 ELSE 0 END END AS is_def,
             CASE WHEN n_reactive IS NOT NULL THEN CASE WHEN n_nonreactive = 7 THEN 1 ELSE 0 END END AS is_not
           FROM part LEFT JOIN counted ON counted.id = p_partkey + 100""")
def metadata_with_classes(spark, d):
    metadata = table(spark, d, "part").select((F.col("p_partkey") + 100).alias("CodeName"), "p_name")
    return _class_names(A.attach_classes(metadata, A.classify_reactivity(part_zscores(spark, d), **_THRESHOLDS)))


_TYPES = """SELECT user_id AS id, event_type, avg(value) AS z FROM events GROUP BY user_id, event_type"""


@query("wide_matrix_classes", "CodeName:s n_reactive:i n_nonreactive:i is_def:i is_unc:i is_not:i",
       f"""WITH z AS ({_TYPES}), counted AS (SELECT id, count(*) FILTER (WHERE z >= 12) AS n_reactive,
             count(*) FILTER (WHERE z < 11) AS n_nonreactive FROM z GROUP BY id),
           classed AS (SELECT *, n_reactive >= 2 AS d,
             n_nonreactive = (SELECT count(DISTINCT event_type) FROM events) AS n FROM counted)
           SELECT 'U' || id AS CodeName, * FROM ({_SQL_CLASSES})""")
def wide_matrix_classes(spark, d):
    events = table(spark, d, "events")
    # The header of a wide matrix: its subjects, one per event type.
    types = sorted(r[0] for r in events.select("event_type").distinct().collect())
    wide = events.groupBy(F.concat(F.lit("U"), F.col("user_id")).alias("Sequence name")).pivot("event_type", types).agg(
        F.avg("value")
    ).withColumnsRenamed({t: f"VW_{t}" for t in types})
    path = f"{shared_folder(spark)}/zscores"
    write_table(wide, path, sep="\t")
    long = read_zscores(spark, path)
    return _class_names(A.classify_reactivity(long, reactive_min=12, min_subjects=2, nonreactive_max=11))


@query("unpivoted_balances", "id:i subject:s z:d",
       """SELECT c_custkey AS id, 'c_acctbal' AS subject, c_acctbal AS z FROM customer
          UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey FROM customer""")
def unpivoted_balances(spark, d):
    wide = table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    return unpivot_scores(wide, "id", ["c_acctbal", "c_nationkey"])


# --- code-list source ------------------------------------------------------


#: Rows are dealt over all documents and a twentieth more names that no document has.
_NAMES = "(SELECT count(*) + count(*) // 20 + 1 FROM documents)"
_TOKENS = "(SELECT (count(*) + count(*) // 20 + 1) // 12 + 1 FROM documents)"


def protein_names(spark, d):
    n = table(spark, d, "documents").count()
    return n + n // 20 + 1


def listed_metadata(spark, d):
    items = table(spark, d, "lineitem")
    names = protein_names(spark, d)
    key, part = F.col("l_orderkey"), F.col("l_partkey")
    start = (part * 7 + F.col("l_linenumber") * 13) % 150
    return items.select(
        F.concat(F.lit("C"), part).alias("CodeName"),
        F.when(key % 41 == 0, " nan ").otherwise(F.concat(F.lit("D"), key % names)).alias("SequenceAccession"),
        F.when(F.col("l_suppkey") % 17 == 0, "").otherwise(F.concat(F.lit("id50_"), key % names % (names // 12 + 1))).alias("Cluster50ID"),
        F.when(part % 29 == 0, "x").when(part % 31 == 0, "3.5").otherwise(F.concat(start, F.lit(".0"))).alias("StartIndex"),
        (start + F.col("l_quantity").cast("int")).cast("string").alias("StopIndex"),
        F.when(part % 5 != 0, F.concat(F.lit("PEP"), part)).alias("PeptideSequence"),
        F.struct(key, F.col("l_linenumber")).alias("source_order"),
    )


def protein_records(spark, d):
    """A record per document with a sequence, a second one with another sequence for one in fifty; each text is cleaned once."""
    name = F.concat(F.lit("tr|D"), F.col("doc_id"), F.lit("|X"))
    both = F.when(F.col("doc_id") % 50 == 7, F.array("sequence", F.concat("sequence", F.lit("A")))).otherwise(F.array("sequence"))
    variants = F.when(F.length("sequence") > 0, both)
    return cleaned_documents(spark, d).select(name.alias("header"), F.explode(variants).alias("sequence"))


def code_sets(spark, d):
    part = table(spark, d, "part")
    code = F.concat(F.lit("C"), F.col("p_partkey")).alias("CodeName")
    return (part.filter(F.col("p_partkey") % 3 == 0).select(code), part.filter(F.col("p_partkey") % 3 == 1).select(code))


SQL_LISTED = f"""
    docs AS (SELECT doc_id, {SQL_CLEAN} AS s FROM documents),
    items AS (SELECT 'C' || l_partkey AS code, l_partkey, l_orderkey, l_linenumber, l_suppkey,
        CASE WHEN l_orderkey % 41 = 0 THEN '' ELSE 'D' || (l_orderkey % {_NAMES}) END AS pid,
        CASE WHEN l_suppkey % 17 = 0 THEN '' ELSE 'id50_' || (l_orderkey % {_NAMES} % {_TOKENS}) END AS token,
        (l_partkey * 7 + l_linenumber * 13) % 150 AS start0, CAST(trunc(l_quantity) AS BIGINT) AS q,
        l_partkey % 3 = 0 AS reactive FROM lineitem WHERE l_partkey % 3 IN (0, 1)
        AND l_partkey IN (SELECT p_partkey FROM part)),
    judged AS (SELECT items.*, s, start0 + q AS stop0, CASE
        WHEN pid = '' THEN 'missing_protein_id'
        WHEN doc_id % 50 = 7 THEN 'ambiguous_protein_sequence'
        WHEN doc_id IS NULL THEN 'missing_protein_sequence'
        WHEN token = '' THEN 'missing_group_token'
        WHEN l_partkey % 29 = 0 THEN 'missing_align_bounds'
        WHEN l_partkey % 31 = 0 THEN 'invalid_align_bounds'
        WHEN q <= 0 OR start0 + q > length(s) THEN 'out_of_bounds_align' END AS reason
        FROM items LEFT JOIN (SELECT * FROM docs WHERE length(s) > 0) docs ON pid = 'D' || doc_id),
    marked AS (SELECT *, CASE
        WHEN reason IN ('missing_protein_id', 'missing_group_token', 'missing_align_bounds', 'invalid_align_bounds') THEN code
        WHEN reason = 'out_of_bounds_align' THEN code || ':' || start0 || ':' || stop0 || ':' || length(s)
        ELSE pid END AS example FROM judged)"""


@query("quarantine_report", "reason:s n_rows:i examples:s",
       f"""WITH {SQL_LISTED},
       per AS (SELECT reason, example, count(*) AS n, min(l_orderkey * 100 + l_linenumber) AS seen FROM marked
               WHERE reason IS NOT NULL GROUP BY reason, example),
       placed AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY seen, example) AS spot FROM per)
       SELECT reason, sum(n) AS n_rows, string_agg(example, ',' ORDER BY spot) FILTER (WHERE spot <= 20) AS examples
       FROM placed GROUP BY reason""")
def quarantine_report(spark, d):
    sequences = A.listed_sequences(protein_records(spark, d))
    rows = A.quarantine_listed(listed_metadata(spark, d), *code_sets(spark, d), sequences, "cwp")
    return Q.drop_report(rows).withColumn("examples", F.array_join("examples", ","))


CONTRACT_SPEC = "CodeName:s FullName:s Peptide:s AlignStart:i AlignStop:i is_def:i is_unc:i is_not:i ProteinID:s GroupToken:s GroupID:i"
SQL_CONTRACT = """
    kept AS (SELECT * FROM marked WHERE reason IS NULL),
    numbered AS (SELECT token, 100000000 + row_number() OVER (ORDER BY token) AS gid FROM (SELECT DISTINCT token FROM kept)),
    contract AS (SELECT code AS CodeName, 'ID=' || pid || ' AC=' || pid || ' OXX=0,0,0,' || gid AS FullName,
        CASE WHEN l_partkey % 5 <> 0 THEN 'PEP' || l_partkey ELSE substr(s, start0 + 1, q) END AS Peptide,
        start0 AS AlignStart, stop0 AS AlignStop, CASE WHEN reactive THEN 1 ELSE 0 END AS is_def, 0 AS is_unc,
        CASE WHEN reactive THEN 0 ELSE 1 END AS is_not, pid AS ProteinID, token AS GroupToken, gid AS GroupID
        FROM kept JOIN numbered USING (token))"""


def prepared(spark, d):
    return prepare_listed(listed_metadata(spark, d), *code_sets(spark, d), protein_records(spark, d), "cwp", 100_000_000)


@query("prepared_contract", CONTRACT_SPEC, f"WITH {SQL_LISTED}, {SQL_CONTRACT} SELECT * FROM contract")
def prepared_contract(spark, d):
    return _class_names(prepared(spark, d).contract)


@query("prepared_targets", "header:s length:i digest:s",
       f"""WITH {SQL_LISTED}, {SQL_CONTRACT} SELECT DISTINCT FullName AS header, length(s) AS length, md5(s) AS digest
           FROM contract JOIN docs ON ProteinID = 'D' || doc_id""")
def prepared_targets(spark, d):
    return prepared(spark, d).targets.select("header", F.length("sequence").alias("length"),
                                             F.md5("sequence").alias("digest"))


@query("prepared_embedding_names", "Name:s Family:i",
       f"WITH {SQL_LISTED}, {SQL_CONTRACT} SELECT DISTINCT FullName AS Name, GroupID AS Family FROM contract")
def prepared_embedding_names(spark, d):
    names = prepared(spark, d).embedding_names
    return A.distinct_names(A.union_sources(names, names))


@query("prepare_summary", "dataset_kind:s n_label_rows:i n_label_proteins:i n_targets:i n_reasons:i",
       f"""WITH {SQL_LISTED}, {SQL_CONTRACT} SELECT 'cwp' AS dataset_kind, count(*) AS n_label_rows,
             count(DISTINCT ProteinID) AS n_label_proteins, count(DISTINCT ProteinID) AS n_targets,
             (SELECT count(DISTINCT reason) FROM marked) AS n_reasons FROM contract""")
def prepare_summary(spark, d):
    return prepared(spark, d).summary.withColumn("n_reasons", F.size("drop_counts"))


@query("group_numbers", "token:s GroupID:i",
       """SELECT token, 1000 + row_number() OVER (ORDER BY token) AS GroupID FROM
            (SELECT DISTINCT lang || '/' || source AS token FROM documents)""")
def group_numbers(spark, d):
    tokens = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("token"))
    return A.group_ids(tokens, "token", 1000)


# --- designed-library source ----------------------------------------------


_SQL_SCORED = f"""{_SQL_PART_Z},
       meta AS (SELECT p_partkey, 'C' || p_partkey AS code, 'D' || (p_partkey % {_NAMES}) AS pid, p_partkey % {_NAMES} AS did,
         CASE WHEN p_partkey % 19 = 0 THEN 'fam' WHEN p_partkey % 23 = 0 THEN CAST(p_partkey % 7 AS VARCHAR)
              ELSE CAST(p_partkey % {_NAMES} AS VARCHAR) END AS fam,
         p_partkey % 90 AS start0, p_partkey % 90 + p_size AS stop0, p_partkey % 17 = 0 AS broken,
         p_partkey % 27 = 0 AS no_z FROM part),
       z_judged AS (SELECT *, CASE WHEN broken THEN 'invalid_fullname' WHEN fam = 'fam' THEN 'invalid_family'
         WHEN did % 50 = 7 THEN 'ambiguous_protein_sequence' WHEN s IS NULL THEN 'missing_protein_sequence'
         WHEN stop0 > length(s) OR stop0 <= start0 THEN 'out_of_bounds_align'
         WHEN no_z OR p_partkey NOT IN (SELECT id FROM counted) THEN 'missing_zscore' END AS reason
         FROM meta LEFT JOIN (SELECT * FROM docs WHERE length(s) > 0) docs ON did = doc_id),
       firsts AS (SELECT pid, arg_min(fam, p_partkey) AS fixed FROM z_judged WHERE reason IS NULL GROUP BY pid),
       settled AS (SELECT z_judged.* EXCLUDE (reason), fixed, CASE WHEN reason IS NULL AND fam <> fixed
         THEN 'conflicting_family_for_protein' ELSE reason END AS reason FROM z_judged LEFT JOIN firsts USING (pid))"""


def scored_rows(spark, d):
    """Judged rows of the designed library, and its sequences."""
    k, names = F.col("p_partkey"), protein_names(spark, d)
    family = F.when(k % 19 == 0, "fam").when(k % 23 == 0, (k % 7).cast("string")).otherwise((k % names).cast("string"))
    name = F.concat(F.lit("ID=D"), k % names, F.lit(" AC=A OXX=1,2,"), family)
    metadata = table(spark, d, "part").select(
        F.concat(F.lit("C"), k).alias("CodeName"),
        F.when(k % 17 == 0, "unnamed").otherwise(name).alias("FullName"),
        F.col("p_name").alias("Peptide"),
        (k % 90).alias("AlignStart"),
        (k % 90 + F.col("p_size")).alias("AlignStop"),
        k.alias("source_order"),
    )
    z = part_zscores(spark, d).filter(F.col("CodeName") % 27 != 0)
    classes = A.classify_reactivity(z.withColumn("CodeName", F.concat(F.lit("C"), F.col("CodeName"))), **_THRESHOLDS)
    plain = protein_records(spark, d).withColumn(
        "header", F.concat(F.lit("ID="), F.split("header", r"\|")[1], F.lit(" AC=A OXX=1"))
    )
    sequences = A.scored_sequences(plain)
    return A.quarantine_scored(metadata, classes, sequences), sequences


@query("scored_quarantine_report", "reason:s n_rows:i examples:s",
       f"""WITH docs AS (SELECT doc_id, {SQL_CLEAN} AS s FROM documents), {_SQL_SCORED},
       marked AS (SELECT *, CASE reason WHEN 'invalid_family' THEN pid || ':' || fam
         WHEN 'out_of_bounds_align' THEN code || ':' || start0 || ':' || stop0 || ':' || length(s)
         WHEN 'conflicting_family_for_protein' THEN pid || ':' || fixed || ':' || fam
         WHEN 'invalid_fullname' THEN code WHEN 'missing_zscore' THEN code ELSE pid END AS example FROM settled),
       per AS (SELECT reason, example, count(*) AS n, min(p_partkey) AS seen FROM marked WHERE reason IS NOT NULL
               GROUP BY reason, example),
       placed AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY seen, example) AS spot FROM per)
       SELECT reason, sum(n) AS n_rows, string_agg(example, ',' ORDER BY spot) FILTER (WHERE spot <= 20) AS examples
       FROM placed GROUP BY reason""")
def scored_quarantine_report(spark, d):
    return Q.drop_report(scored_rows(spark, d)[0]).withColumn("examples", F.array_join("examples", ","))


@query("three_source_names", "Name:s Family:i n_sources:i",
       f"""WITH {SQL_LISTED}, {SQL_CONTRACT}, {_SQL_SCORED},
       named AS (SELECT DISTINCT 'cwp' AS kind, FullName AS Name, GroupID AS Family FROM contract
         UNION ALL SELECT DISTINCT 'bkp', 'ID=' || ProteinID || ' AC=' || ProteinID || ' OXX=0,0,0,' || (GroupID + 100000000), GroupID + 100000000 FROM contract
         UNION ALL SELECT DISTINCT 'pv1', 'ID=' || pid || ' AC=' || pid || ' OXX=0,0,0,' || fam, CAST(fam AS BIGINT) FROM settled WHERE reason IS NULL)
       SELECT Name, Family, (SELECT count(DISTINCT kind) FROM named) AS n_sources FROM named GROUP BY Name, Family""")
def three_source_names(spark, d):
    """The embedding metadata of all three kinds of source, each prepared by its own rules, without repeats."""
    rows, sequences = scored_rows(spark, d)
    codes, records = code_sets(spark, d), protein_records(spark, d)
    other = listed_metadata(spark, d).withColumnRenamed("Cluster50ID", "reClusterID_70")
    sources = [finalize(rows, sequences, "pv1"), prepared(spark, d), prepare_listed(other, *codes, records, "bkp", 200_000_000)]
    names = A.union_sources(*[s.embedding_names for s in sources])
    return A.distinct_names(names).withColumn("n_sources", F.lit(len(sources)))


# --- evaluation subset -----------------------------------------------------

_SQL_EVAL = f"""{SQL_LISTED},
    staged AS (SELECT code, l_partkey, l_orderkey, l_linenumber, reactive, s, start0, stop0,
        CASE WHEN l_orderkey % 41 = 0 THEN 'nan' ELSE 'tr|D' || (l_orderkey % {_NAMES}) || '|X' END AS pid, doc_id
        FROM (SELECT items.*, start0 + q AS stop0, s, doc_id FROM items LEFT JOIN (SELECT * FROM docs WHERE length(s) > 0)
              docs ON l_orderkey % 41 <> 0 AND l_orderkey % {_NAMES} = doc_id)),
    first_pass AS (SELECT *, CASE WHEN l_partkey % 29 = 0 OR l_partkey % 31 = 0 THEN 'missing_align'
        WHEN doc_id IS NULL THEN 'missing_protein' WHEN doc_id % 50 = 7 THEN 'ambiguous_protein'
        WHEN stop0 > length(s) THEN 'out_of_bounds_align' END AS r1 FROM staged),
    judged2 AS (SELECT *, CASE WHEN r1 IS NULL AND code IN (SELECT code FROM first_pass WHERE r1 = 'out_of_bounds_align')
        THEN 'out_of_bounds_align' ELSE r1 END AS r FROM first_pass)"""


def evaluation_subset(spark, d):
    metadata = listed_metadata(spark, d).withColumn(
        "SequenceAccession",
        F.when(F.col("SequenceAccession") == " nan ", "nan").otherwise(
            F.concat(F.lit("tr|"), F.col("SequenceAccession"), F.lit("|X"))),
    )
    return prepare_evaluation(metadata, protein_records(spark, d), *code_sets(spark, d))


@query("evaluation_drop_report", "reason:s n_dropped:i examples:s",
       f"""WITH {_SQL_EVAL}, per AS (SELECT r AS reason, CASE WHEN r IN ('missing_align', 'out_of_bounds_align') THEN code
             ELSE pid END AS example, count(*) AS n, min(l_orderkey * 100 + l_linenumber) AS seen FROM judged2
             WHERE r IS NOT NULL GROUP BY ALL),
           placed AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY seen, example) AS spot FROM per)
           SELECT reason, CASE WHEN reason = 'missing_align' THEN sum(n) ELSE count(*) END AS n_dropped,
             string_agg(example, ',' ORDER BY spot) FILTER (WHERE spot <= 20) AS examples FROM placed GROUP BY reason""")
def evaluation_drop_report(spark, d):
    return evaluation_subset(spark, d).dropped.withColumn("examples", F.array_join("examples", ","))


@query("evaluation_length_summary",
       "n_selected_rows:i n_selected_reactive_rows:i n_selected_nonreactive_rows:i peptide_len_min:i peptide_len_max:i "
       "peptide_len_mean:d",
       f"""WITH {_SQL_EVAL} SELECT count(*) AS n_selected_rows, count(*) FILTER (WHERE reactive) AS n_selected_reactive_rows,
             count(*) FILTER (WHERE NOT reactive) AS n_selected_nonreactive_rows, min(stop0 - start0) AS peptide_len_min,
             max(stop0 - start0) AS peptide_len_max, avg(stop0 - start0) AS peptide_len_mean FROM judged2 WHERE r IS NULL""")
def evaluation_length_summary(spark, d):
    return evaluation_subset(spark, d).summary


# --- set operations --------------------------------------------------------


@query("code_union", "nation:i", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def code_union(spark, d):
    return _nations(spark, d, "customer", "c_").union(_nations(spark, d, "supplier", "s_")).distinct()


@query("code_intersection", "nation:i",
       "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def code_intersection(spark, d):
    return _nations(spark, d, "customer", "c_").intersect(_nations(spark, d, "supplier", "s_"))


@query("missing_codes", "doc_id:i", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_codes(spark, d):
    return Q.missing_ids(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


def _nations(spark, d, name, prefix):
    return table(spark, d, name).select(F.col(f"{prefix}nationkey").alias("nation"))

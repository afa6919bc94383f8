import json

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import intervals as I
from spanforge.operators import quality as Q
from spanforge.operators import splits as S
from spanforge.operators.assay import classify_reactivity, distinct_names, union_sources
from spanforge.plans.label import build_labels
from spanforge.plans.prepare import prepare_dataset
from spanforge.sources.tables import unpivot_scores


def tsv(path, header, *rows):
    path.write_text("\n".join("\t".join(map(str, r)) for r in (header, *rows)) + "\n")
    return str(path)


def text(path, content):
    path.write_text(content)
    return str(path)


LISTED = {
    "cwp": (["CodeName", "SequenceAccession", "Cluster50ID", "StartIndex", "StopIndex", "PeptideSequence"],
            [("CWP_000001", "A0CWP1", "Cocci_id50_010", 0, 4, "ACDE"), ("CWP_000002", "A0CWP1", "Cocci_id50_010", 1, 5, "CDEF")],
            ">tr|A0CWP1|A0CWP1_FAKE\nACDEFG\n", 100_000_000),
    "bkp": (["CodeName", "SequenceAccession", "reClusterID_70", "alignStart", "alignStop", "PeptideSequence"],
            [("BKP_000001", "A0BKP1", "BKP1_id70_200", "0.0", "4.0", "WXYZ"), ("BKP_000002", "A0BKP1", "BKP1_id70_200", "1.0", "5.0", "XYZA")],
            ">tr|A0BKP1|A0BKP1_FAKE\nWXYZAB\n", 200_000_000),
}


def listed(spark, tmp_path, kind, rows=None, fasta=None, offset=None, reactive=None, nonreactive=None):
    header, default_rows, default_fasta, default_offset = LISTED[kind]
    rows = default_rows if rows is None else rows
    codes = [r[0] for r in rows]
    return prepare_dataset(
        spark, kind,
        meta=tsv(tmp_path / f"{kind}.tsv", header, *rows),
        fasta=text(tmp_path / f"{kind}.faa", fasta or default_fasta),
        reactive_codes=tsv(tmp_path / f"{kind}_r.tsv", ["Sequence name"], *[[c] for c in (reactive or codes[:1])]),
        nonreactive_codes=tsv(tmp_path / f"{kind}_n.tsv", ["Sequence name"],
                              *[[c] for c in (codes[1:] if nonreactive is None else nonreactive)]),
        group_id_offset=default_offset if offset is None else offset,
    )


def scored(spark, tmp_path):
    return prepare_dataset(
        spark, "pv1",
        meta=tsv(tmp_path / "m.tsv", ["CodeName", "Category", "SpeciesID", "Species", "Protein", "FullName", "Peptide", "Encoding"],
                 ("pv1_pep_1", "SetCover", 1, "PV1", "Prot", "ID=PV1P001 AC=A1 OXX=11,22,301_0_4", "MNPQ", "enc"),
                 ("pv1_pep_2", "SetCover", 1, "PV1", "Prot", "ID=PV1P001 AC=A1 OXX=11,22,301_2_6", "PQRS", "enc")),
        z_scores=tsv(tmp_path / "z.tsv", ["Sequence name", "VW_001", "VW_002"], ("pv1_pep_1", 30, 0), ("pv1_pep_2", 1, 2)),
        fasta=text(tmp_path / "t.fasta", ">ID=PV1P001 AC=A1 OXX=11,22,301\nMNPQRS\n"),
        min_subjects=1,
    )


def test_three_sources_to_labels(spark, tmp_path):
    parts = [scored(spark, tmp_path), listed(spark, tmp_path, "cwp"), listed(spark, tmp_path, "bkp")]
    contract = union_sources(*[p.contract for p in parts])
    names = distinct_names(union_sources(*[p.embedding_names for p in parts]))
    assert {(r["ProteinID"], r["Family"]) for r in names.collect()} == {
        ("PV1P001", 301), ("A0CWP1", 100_000_001), ("A0BKP1", 200_000_001)}
    targets = union_sources(*[p.targets for p in parts])
    lengths = targets.select(F.col("ProteinID").alias("id"), F.length("sequence").alias("length"))
    labels = build_labels(contract, lengths)
    strings = {r["id"]: r["labels"] for r in I.label_strings(labels.segments).collect()}
    assert strings == {"PV1P001": "ddddnn", "A0CWP1": "ddddnu", "A0BKP1": "ddddnu"}
    stats = labels.stats.first()
    assert (stats["pos_count"], stats["neg_count"]) == (12, 4) and stats["pos_weight"] == pytest.approx(1 / 3)
    assert {r["id"]: len(r["peptides"]) for r in labels.proteins.collect()} == {"PV1P001": 2, "A0CWP1": 2, "A0BKP1": 2}
    split = S.split_grouped(lengths.select("id"), names.select(F.col("ProteinID").alias("id"), F.col("Family").alias("group")), .34, 11)
    sides = {r["group"]: r["role"] for r in split.collect()}
    assert len(sides) == 3 and list(sides.values()).count("validation") == 1
    parted = build_labels(contract, lengths, list_parts=3).proteins
    assert parted.select(F.sum(F.size("peptides"))).first()[0] == 6
    labels.write(str(tmp_path / "labels"))
    assert spark.read.parquet(str(tmp_path / "labels/class_stats")).count() == 1


def test_quarantine_counts_and_groups(spark, tmp_path):
    rows = [("c1", "A0A111", "Cocci_id50_010", 0, 4, "MNPQ"), ("c2", "WP_200.1", "Cocci_id50_001", 1, 5, "QWER"),
            ("c3", "MISSING_ACC", "Cocci_id50_001", 0, 3, "AAA")]
    out = listed(spark, tmp_path, "cwp", rows, ">tr|A0A111|x\nMNPQRS\n>WP_200.1 thing\nAQWERT\n", 1000)
    got = {r["ProteinID"]: r["GroupID"] for r in out.contract.collect()}
    assert got == {"WP_200.1": 1001, "A0A111": 1002}
    assert [(r["reason"], r["n_rows"], r["examples"]) for r in out.dropped.collect()] == [("missing_protein_sequence", 1, ["MISSING_ACC"])]
    out.write(str(tmp_path / "prep"))
    summary = json.loads(spark.read.text(str(tmp_path / "prep/prepare_summary.json")).first()[0])
    assert summary["n_label_rows"] == 2 and summary["drop_counts"] == {"missing_protein_sequence": 1}
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "prep/prepared_embedding_metadata.tsv")).count() == 2


def test_derived_peptide_and_empty_nonreactive(spark, tmp_path):
    rows = [("b1", "P1", "tok", "0.0", "4.0", "")]
    out = listed(spark, tmp_path, "bkp", rows, ">P1\nMNPQRS\n", 2000, reactive=["b1"], nonreactive=[])
    row = out.contract.first()
    assert (row["Peptide"], row["AlignStart"], row["AlignStop"], row["GroupID"]) == ("MNPQ", 0, 4, 2001)


def test_overlapping_codes_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="overlap"):
        listed(spark, tmp_path, "cwp", nonreactive=["CWP_000001"])


def test_nan_subject_blocks_not(spark):
    wide = spark.createDataFrame([("a", 30.0, 25.0), ("b", 1.0, 2.0), ("c", 15.0, 5.0), ("d", 1.0, float("nan"))],
                                 "CodeName string, VW_1 double, VW_2 double")
    rows = classify_reactivity(unpivot_scores(wide, "CodeName", ["VW_1", "VW_2"]), min_subjects=1)
    got = {r["CodeName"]: (r["Def epitope"], r["Uncertain"], r["Not epitope"]) for r in rows.collect()}
    assert got == {"a": (1, 0, 0), "b": (0, 0, 1), "c": (0, 1, 0), "d": (0, 1, 0)}


def test_label_builder_rejects_bad_rows(spark):
    contract = spark.createDataFrame([("c", "ID=P AC=P OXX=1", "MN", 0, 9, 1, 0, 0)],
                                     "CodeName string, FullName string, Peptide string, AlignStart int, AlignStop int, "
                                     "`Def epitope` int, Uncertain int, `Not epitope` int")
    lengths = spark.createDataFrame([("P", 6)], "id string, length int")
    with pytest.raises(Exception, match="outside"):
        build_labels(contract, lengths).segments.collect()
    with pytest.raises(ValueError, match="no peptide"):
        build_labels(contract, lengths.filter("id = 'Q'"), restrict_to_lengths=True)


def test_a_guard_over_many_partitions_is_one_job(spark):
    """Nothing to find: all partitions are tried at once, not a few and then a few more."""
    rows = spark.range(0, 6400, 1, 64).select(F.col("id").cast("string").alias("CodeName"), "id")
    context = spark.sparkContext
    try:
        context.setJobGroup("guard", "guard")
        Q.guard_empty(rows.filter("id < 0"), "wrong", "CodeName")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("guard")) == 1
    with pytest.raises(ValueError, match=r"wrong, examples: \['0', '1', '10'\]"):
        Q.guard_empty(rows.filter("id <= 10 and id <> 2"), "wrong", "CodeName", limit=3)


def test_cells_are_stripped_without_a_pattern(spark):
    cells = [None, "", " ", " \t\n\x0b\f\r", " 1.5\n", "\tnan ", "NaN", "x", "7", " a b ", "\u00a0q"]
    frame = spark.createDataFrame([(c,) for c in cells], "c string")
    got = frame.select(T.strip(F.col("c")), T.numeric(F.col("c")), T.clean_text(F.col("c")))
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
    space = " \t\n\x0b\f\r"
    stripped = [None if c is None else c.strip(space) for c in cells]
    numbers = [{"1.5": 1.5, "7": 7.0}.get(c) for c in stripped]
    assert [tuple(r) for r in got.collect()] == list(zip(stripped, numbers, ["" if (c or "").lower() in ("", "nan") else c for c in stripped]))

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.operators import quality as Q
from spanforge.sources import sinks, tables
from spanforge.sources.fasta import read_fasta, record_numbers, write_fasta


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_fullname_and_family(spark):
    name = F.lit("ID=P001 AC=A1 OXX=10,20,333")
    assert [one(spark, X.fullname_part(name, g)) for g in (1, 2, 3)] == ["P001", "A1", "10,20,333"]
    assert one(spark, X.family_of(F.lit("10,20, 333 ,"))) == "333"
    assert one(spark, X.fullname_part(F.lit("P001 x"), 1)) is None


def test_normalize_family(spark):
    cases = {None: "", "nan": "", "123.0": "123", " 456 ": "456", "1.5": "1.5"}
    for raw, want in cases.items():
        assert one(spark, X.normalize_family(F.lit(raw).cast("string"))) == want


def test_keys(spark):
    assert one(spark, X.build_key(F.lit("P001"), F.lit("111"))) == "P001-111"
    assert tuple(one(spark, X.parse_key(F.lit("P001-111")))) == ("P001", "111", "id-family")
    assert tuple(one(spark, X.parse_key(F.lit("P002")))) == ("P002", None, "id")
    assert tuple(one(spark, X.parse_key(F.lit("A-B-7")))) == ("A-B", "7", "id-family")
    with pytest.raises(Exception, match="numeric"):
        one(spark, X.build_key(F.lit("P"), F.lit("abc")))


def test_clean_sequence_and_suffix(spark):
    assert one(spark, X.clean_sequence(F.lit("acdx-*\n"))) == "ACDX"
    name = F.lit("ID=P001 AC=A1 OXX=11,22,33_2_5")
    assert [one(spark, X.align_suffix(name, g)) for g in (1, 2)] == [2, 5]
    assert one(spark, X.strip_align_suffix(name)) == "ID=P001 AC=A1 OXX=11,22,33"
    assert one(spark, X.align_suffix(F.lit("ID=P OXX=1"), 1)) is None


def test_nan_is_not_a_large_number(spark):
    assert one(spark, X.numeric(F.lit("NaN"))) is None
    assert one(spark, X.numeric(F.lit(" 4.5 "))) == 4.5


def test_lists_and_length_feature(spark):
    assert one(spark, X.parse_list(F.lit("1, 2,,3"), "bigint")) == [1, 2, 3]
    with pytest.raises(Exception, match="not a number"):
        one(spark, X.parse_list(F.lit("1,x"), "bigint"))
    with pytest.raises(Exception, match="empty"):
        one(spark, X.parse_list(F.lit(" , "), "double"))
    vec = F.array(F.lit(0.5))
    assert one(spark, X.length_feature(vec, F.lit(5), "inverse")) == [0.5, 0.2]
    assert one(spark, X.length_feature(vec, F.lit(5), "raw")) == [0.5, 5.0]
    with pytest.raises(ValueError):
        X.length_feature(vec, F.lit(5), "log")


def test_fasta_modes(spark, tmp_path):
    path = tmp_path / "in.fasta"
    path.write_bytes(b"preamble\r\nmore\n>ID=P1 AC=A OXX=1,2\r\nMNP\r\n\r\nQ RS\n>ID=P2 AC=B OXX=3\n>ID=P3 AC=C OXX=4\nAC\n")
    rows = read_fasta(spark, str(path), mode="strict").orderBy("id").collect()
    assert [(r["id"], r["sequence"]) for r in rows] == [("P1", "MNPQRS"), ("P2", ""), ("P3", "AC")]
    (tmp_path / "free.fasta").write_text(">tr|X1|N some > text\nAA\n")
    free = str(tmp_path / "free.fasta")
    assert read_fasta(spark, free).first()["header"] == "tr|X1|N some > text"
    assert read_fasta(spark, free, mode="fullname").first()["header"] == "tr|X1|N some"
    with pytest.raises(Exception, match="ID= AC= OXX="):
        read_fasta(spark, free, mode="strict").collect()


def test_fasta_many_splits(spark, tmp_path):
    path = tmp_path / "big.fasta"
    path.write_text("".join(f">s{i} x\n{'ACDE' * (i % 9)}\n{'FGH' * 5}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = read_fasta(spark, str(path))
        assert rows.rdd.getNumPartitions() > 5
        got = {r["header"]: r["sequence"] for r in rows.collect()}
        first = [r["header"] for r in rows.orderBy("source_order").limit(3).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"s{i} x": "ACDE" * (i % 9) + "FGH" * 5 for i in range(3000)}
    assert first == ["s0 x", "s1 x", "s2 x"]


def test_fasta_write_read(spark, tmp_path):
    rows = spark.createDataFrame([("b", "CC"), ("a", "AA")], "header string, sequence string")
    write_fasta(rows, str(tmp_path / "out"), order=[F.col("header")])
    back = {(r["header"], r["sequence"]) for r in read_fasta(spark, str(tmp_path / "out")).collect()}
    assert back == {("a", "AA"), ("b", "CC")}


def test_assay_metadata(spark, tmp_path):
    (tmp_path / "m.tsv").write_text(
        "CodeName\tCategory\tFullName\tPeptide\tEncoding\n"
        "c1\tSetCover\tID=P001 AC=A1 OXX=11,22,33_2_5\tMNP\tx\nc2\tOther\tID=P AC=A OXX=1_2_3\tM\tx\n"
    )
    rows = tables.read_assay_metadata(spark, str(tmp_path / "m.tsv"), drop_cols=["Encoding", "Absent"]).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row["AlignStart"], row["AlignStop"], row["FullName"]) == (2, 5, "ID=P001 AC=A1 OXX=11,22,33")
    with pytest.raises(ValueError, match="missing required"):
        tables.read_tsv(spark, str(tmp_path / "m.tsv"), ["Nope"])


def test_codes_and_runs(spark, tmp_path):
    (tmp_path / "codes.tsv").write_text("Sequence name\nA\n\n B \nA\tx\nCode_Name\n")
    assert {r[0] for r in tables.read_codes(spark, str(tmp_path / "codes.tsv")).collect()} == {"A", "B"}
    row = spark.createDataFrame([(1, .5)], "RunIndex int, F1 double")
    for _ in range(2):
        sinks.append_runs(row, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_strict_json(spark):
    rows = spark.createDataFrame([(float("nan"), [1.0, float("inf")])], "a double, b array<double>")
    assert sinks.strict_json(rows).first()["value"] == '{"a":null,"b":[1.0,null]}'


def test_indexes(spark):
    labels = spark.createDataFrame([("p", "s1", 1), ("p", "s2", 2), ("q", "s1", 3)], "protein_id string, shard string, v int")
    assert {(r["protein_id"], r["v"]) for r in tables.keep_last_shard(labels).collect()} == {("p", 2), ("q", 3)}
    vectors = spark.createDataFrame([("p", "p-1", "1", 5), ("p", "p-2", "2", 5)],
                                    "protein_id string, key string, family string, length int")
    with pytest.raises(Exception, match="several embeddings"):
        tables.embedding_index(vectors).collect()
    assert tables.embedding_index(vectors.limit(1)).count() == 1


def test_family_map_conflict(spark):
    same = spark.createDataFrame([("P", "333"), ("Q", "1"), ("P", "333")], "id string, family string")
    assert {r["id"]: r["n_duplicates"] for r in Q.guarded_family_map(same, "id", "family").collect()} == {"P": 1, "Q": 0}
    clash = spark.createDataFrame([("P", "333"), ("P", "444")], "id string, family string")
    with pytest.raises(ValueError, match="conflicting"):
        Q.guarded_family_map(clash, "id", "family")


def test_one_hot_guard(spark):
    rows = spark.createDataFrame([("a", 1, 0, 1)], "name string, d int, u int, n int")
    with pytest.raises(Exception, match="one-hot"):
        Q.check_one_hot(rows, ["d", "u", "n"], "name").collect()


def test_family_and_length_guards(spark):
    seqs = spark.createDataFrame([("a", 3), ("b", 4)], "id string, length int")
    one = spark.createDataFrame([("a", "7.0")], "id string, family string")
    with pytest.raises(ValueError, match="without a family"):
        Q.attach_families(seqs, one)
    blank = spark.createDataFrame([("a", "7.0"), ("b", " nan")], "id string, family string")
    with pytest.raises(ValueError, match="empty family"):
        Q.attach_families(seqs, blank)
    assert {r["id"]: r["family"] for r in Q.attach_families(seqs, blank, required=False).collect()} == {"a": "7", "b": ""}
    other = spark.createDataFrame([("a", 3), ("b", 5)], "id string, length int")
    with pytest.raises(Exception, match="lengths differ"):
        Q.trainable_ids(seqs, other).collect()


def test_record_numbers_do_not_depend_on_packing(spark, tmp_path):
    """Blocks of 200 bytes and whole files number the same records alike."""
    for k in range(3):
        body = "".join(f">f{k}r{i:03d}\n{'ACDE' * (1 + (i * 7 + k) % 9)}\n" for i in range(60))
        (tmp_path / f"part{k}.fasta").write_text(("stray text\n" if k == 1 else "") + body)
    seen = []
    for size in (200, 1 << 27):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            numbered = record_numbers(read_fasta(spark, str(tmp_path)))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        seen.append({r["header"]: r["id"] for r in numbered.collect()})
    assert seen[0] == seen[1]
    assert seen[0] == {f"f{k}r{i:03d}": 60 * k + i + 1 for k in range(3) for i in range(60)}

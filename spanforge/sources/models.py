"""Model store: the members of an ensemble as tables of named parameters.

A store is a folder with two Parquet tables: ``checkpoints`` (checkpoint, threshold,
seq_len_feature) and ``parameters`` (checkpoint, name, shape, values). A member's path in a
manifest is ``<folder of the store>/<checkpoint>``. Members are joined to their parameters
and thresholds as rows; what reaches the driver, and from there every task, is the chosen
members alone, and their size is checked before.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators.ensemble import decision_threshold

#: What may be appended to a vector.
LENGTH_FEATURES = ("none", "raw", "inverse")
CHECKPOINTS = "checkpoint string, threshold double, seq_len_feature string"
PARAMETERS = "checkpoint string, name string, shape array<int>, values array<double>"
#: Parameters of an ensemble that may be broadcast (8 bytes each).
MAX_PARAMETERS = 1 << 27


@dataclass(frozen=True)
class Member:
    """A member that was read: its parameters by name, as flat values with a shape."""

    name: str
    threshold: float
    seq_len_feature: str
    tensors: Mapping[str, np.ndarray]


def named_tensors(head: Mapping) -> dict[str, np.ndarray]:
    """The parameters of a head (see ``operators.scoring``) by name."""
    found = {"w": np.asarray(head["w"], float), "b": np.asarray(head["b"], float)}
    for i, layer in enumerate(head.get("conv", ())):
        found |= {f"conv.{i}.{k}": np.asarray(layer[k], float) for k in ("w", "b")}
    for i, block in enumerate(head["blocks"]):
        found |= {f"blocks.{i}.{k}": np.asarray(block[k], float) for k in ("w", "b", "gain", "shift") if block.get(k) is not None}
        skip = block.get("skip")
        if skip == "same":
            found[f"blocks.{i}.skip.same"] = np.zeros(0)
        elif skip:
            found |= {f"blocks.{i}.skip.{k}": np.asarray(skip[k], float) for k in ("w", "b")}
    return found


def head_of(tensors: Mapping[str, np.ndarray]) -> dict:
    """The head that ``named_tensors`` took apart."""
    def layers(prefix: str) -> list[dict]:
        count = len({name.split(".")[1] for name in tensors if name.startswith(f"{prefix}.")})
        start = [f"{prefix}.{i}." for i in range(count)]
        return [{name[len(s):]: t for name, t in tensors.items() if name.startswith(s)} for s in start]

    blocks = []
    for flat in layers("blocks"):
        block = {k: v for k, v in flat.items() if not k.startswith("skip.")}
        if "skip.same" in flat:
            block["skip"] = "same"
        elif "skip.w" in flat:
            block["skip"] = {"w": flat["skip.w"], "b": flat["skip.b"]}
        blocks.append(block)
    head = {"blocks": blocks, "w": tensors["w"].reshape(-1), "b": float(tensors["b"].reshape(-1)[0])}
    conv = layers("conv")
    return head | ({"conv": conv} if conv else {})


def input_width(tensors: Mapping[str, np.ndarray]) -> int:
    """Length of the vectors that a member takes."""
    if "conv.0.w" in tensors:
        return tensors["conv.0.w"].shape[1]
    return tensors["blocks.0.w"].shape[1] if "blocks.0.w" in tensors else tensors["w"].reshape(-1).shape[0]


def write_models(spark: SparkSession, folder: str, models: Mapping[str, Mapping]) -> None:
    """Add heads to a store: checkpoint name -> {head, threshold, seq_len_feature}."""
    rows = [(name, m.get("threshold"), m.get("seq_len_feature")) for name, m in models.items()]
    tensors = [
        (name, key, list(t.shape), t.reshape(-1).tolist()) for name, m in models.items() for key, t in named_tensors(m["head"]).items()]
    _append(spark.createDataFrame(rows, CHECKPOINTS), spark.createDataFrame(tensors, PARAMETERS), folder)


def write_runs(runs: DataFrame, folder: str) -> None:
    """Add the linear models of cross-validated runs, under the names their manifest gives them."""
    name = F.concat(F.lit("run_"), F.format_string("%03d", "RunIndex")).alias("checkpoint")
    checkpoints = runs.select(name, F.col("Threshold").alias("threshold"), F.lit(None).cast("string").alias("seq_len_feature"))
    parts = F.array(
        F.struct(F.lit("w").alias("name"), F.array(F.size("weights")).alias("shape"), F.col("weights").alias("values")),
        F.struct(F.lit("b").alias("name"), F.array().cast("array<int>").alias("shape"), F.array("bias").alias("values")))
    _append(checkpoints, runs.select(name, F.inline(parts)), folder)


def _append(checkpoints: DataFrame, parameters: DataFrame, folder: str) -> None:
    # Parameters first: a checkpoint that is listed has all of them.
    parameters.write.mode("append").parquet(f"{folder}/parameters")
    checkpoints.write.mode("append").parquet(f"{folder}/checkpoints")


def checkpoint_rows(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """A member table for plain checkpoint paths, as ``read_members`` gives it for a manifest."""
    rows = [(number, path, None) for number, path in enumerate(paths, start=1)]
    return spark.createDataFrame(rows, "member int, checkpoint string, threshold double")


def load_members(
    members: DataFrame, *, threshold: float | None = None, seq_len_feature: str = "auto", max_parameters: int = MAX_PARAMETERS,
) -> list[Member]:
    """The members ``(member, checkpoint, threshold)`` with their parameters, in member order.

    The decision threshold is the override, else the manifest's, else the checkpoint's,
    else 0.5. Members must agree in the length of their vectors and in the length feature.
    """
    if threshold is not None and not 0.0 < threshold < 1.0:
        raise ValueError("threshold must be between 0 and 1")
    if seq_len_feature not in ("auto", *LENGTH_FEATURES):
        raise ValueError(f"seq_len_feature must be auto or one of {LENGTH_FEATURES}")
    spark = members.sparkSession
    place = members.select(
        "member", F.regexp_extract("checkpoint", "^(.*)/([^/]+)$", 1).alias("folder"),
        F.regexp_extract("checkpoint", "([^/]+)$", 1).alias("checkpoint"), F.col("threshold").alias("given"))
    folders = sorted(r["folder"] for r in place.select("folder").distinct().collect())
    stored, values = (_tables(spark, folders, name, schema) for name, schema in (("checkpoints", CHECKPOINTS), ("parameters", PARAMETERS)))
    keys = ["folder", "checkpoint"]
    chosen = place.join(stored.withColumn("found", F.lit(True)), keys, "left").select(
        "member", *keys, "found", F.coalesce("seq_len_feature", F.lit("none")).alias("feature"),
        decision_threshold(threshold, F.col("given"), F.col("threshold")).alias("threshold"))
    listed = chosen.orderBy("member").collect()
    gone = [f"{r['folder']}/{r['checkpoint']}" for r in listed if not r["found"]]
    if gone:
        raise FileNotFoundError(f"checkpoints not in their store: {gone}")
    features = {r["feature"] if seq_len_feature == "auto" else seq_len_feature for r in listed}
    if len(features) != 1:
        raise ValueError(f"all members must share seq_len_feature, got {sorted(features)}")
    own = place.select("member", *keys).join(values, keys)
    size = own.agg(F.sum(F.size("values")).alias("n")).first()["n"] or 0
    if size > max_parameters:
        raise ValueError(f"{size} parameters are too many to broadcast (limit {max_parameters})")
    tensors: dict[int, dict[str, np.ndarray]] = {}
    for r in own.select("member", "name", "shape", "values").collect():
        if math.prod(r["shape"]) != len(r["values"]):
            raise ValueError(f"parameter {r['name']} of member {r['member']} does not fit its shape {r['shape']}")
        tensors.setdefault(r["member"], {})[r["name"]] = np.array(r["values"], float).reshape(r["shape"])
    widths = {input_width(t) for t in tensors.values()}
    if len(widths) != 1:
        raise ValueError(f"all members must share the length of their vectors, got {sorted(widths)}")
    names = [r["checkpoint"] for r in listed]
    unique = len(set(names)) == len(names)
    return [
        Member(r["checkpoint"] if unique else f"{r['member']:03d}-{r['checkpoint']}", r["threshold"], next(iter(features)), tensors[r["member"]])
        for r in listed]


def _tables(spark: SparkSession, folders: Sequence[str], name: str, schema: str) -> DataFrame:
    found = None
    for folder in folders:
        rows = spark.read.schema(schema).parquet(f"{folder}/{name}").withColumn("folder", F.lit(folder))
        found = rows if found is None else found.unionByName(rows)
    return found

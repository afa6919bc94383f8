"""Batch prediction: sequences to binary masks through an embedding function and heads."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.text import clean_sequence
from spanforge.operators.blocks import VOTES, Finish, Rule, all_stretches, assemble, finish_windows, reach_of, voter
from spanforge.operators.ensemble import AGGREGATIONS, read_members, votes_needed
from spanforge.operators.metrics import check_probability
from spanforge.operators.scoring import embed_windows, failed_ids, score_members, score_members_conv, stitch
from spanforge.session import cut_lineage
from spanforge.sources.fasta import fasta_lines, read_fasta, record_numbers
from spanforge.sources.models import checkpoint_rows, head_of, load_members


@dataclass(frozen=True)
class Predictor:
    """An embedding function with one or more heads.

    ``heads`` maps a member name to its head (see ``operators.scoring``),
    ``thresholds`` the same names to decision thresholds.
    """

    embed: Callable[[Sequence[str]], Sequence[np.ndarray]]
    heads: Mapping[str, Mapping]
    thresholds: Mapping[str, float]
    aggregation: str = "majority"
    ensemble_threshold: float | None = None
    length_feature: str = "none"
    meta: Mapping[str, str] | None = None

    def __post_init__(self) -> None:
        if self.aggregation not in AGGREGATIONS:
            raise ValueError(f"aggregation must be one of {AGGREGATIONS}")
        if set(self.heads) != set(self.thresholds):
            raise ValueError("heads and thresholds must name the same members")

    def _reported_threshold(self) -> float | None:
        if len(self.thresholds) == 1:
            return next(iter(self.thresholds.values()))
        if self.aggregation == "majority":
            return None
        return self._mean_cut()

    @classmethod
    def from_artifact(
        cls,
        spark: SparkSession,
        artifact: str,
        embed: Callable[[Sequence[str]], Sequence[np.ndarray]],
        *,
        set_index: int = 1,
        k_folds: int | None = None,
        threshold: float | None = None,
        aggregation: str = "majority",
        ensemble_threshold: float | None = None,
        seq_len_feature: str = "auto",
    ) -> Predictor:
        """The members of a manifest (``.json``) or one checkpoint of a model store.

        ``set_index`` chooses the set of a manifest of several, ``k_folds`` keeps the first
        members in order, ``threshold`` overrides those of all members. The mean of an
        ensemble is judged by ``ensemble_threshold``, else the override, else the members' mean.
        """
        if set_index < 1:
            raise ValueError("set_index must be >= 1")
        if artifact.endswith(".json"):
            members = read_members(spark, artifact, set_index=set_index, k_folds=k_folds)
        else:
            members = checkpoint_rows(spark, [artifact])
        loaded = load_members(members, threshold=threshold, seq_len_feature=seq_len_feature)
        return cls(
            embed,
            {m.name: head_of(m.tensors) for m in loaded},
            {m.name: m.threshold for m in loaded},
            aggregation=aggregation,
            ensemble_threshold=ensemble_threshold if ensemble_threshold is not None else threshold,
            length_feature=loaded[0].seq_len_feature,
            meta={"engine": "spanforge", "artifact": artifact, "set_index": str(set_index)},
        )

    def _rule(self) -> Rule:
        limits = tuple(check_probability(float(self.thresholds[name]), "threshold") for name in self.heads)
        return Rule(limits, None if self.aggregation == "majority" else check_probability(self._mean_cut(), "ensemble_threshold"))

    def _mean_cut(self) -> float:
        given = self.ensemble_threshold
        return given if given is not None else sum(self.thresholds.values()) / len(self.thresholds)

    def score(self, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Member probabilities ``(id, pos, ps)`` and the failed ids, for ``(id, sequence)``."""
        cleaned = sequences.select("id", clean_sequence(F.col("sequence")).alias("sequence"))
        # Embedding is the costly step and feeds vectors and failures: run it once.
        windows = cut_lineage(embed_windows(cleaned, self.embed, feature=self.length_feature))
        vectors = stitch(windows)
        if any("conv" in h for h in self.heads.values()):
            scores = score_members_conv(vectors, self.heads)
        else:
            scores = score_members(vectors, self.heads)
        blank = cleaned.filter(F.length("sequence") == 0).select("id", F.lit("empty after cleaning").alias("error"))
        return scores, failed_ids(windows).unionByName(blank)

    def masks(self, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Mask and summary per id and the failures: scored and voted in the windows (see ``operators.blocks``)."""
        cleaned = sequences.select("id", clean_sequence(F.col("sequence")).alias("sequence"))
        held = sequences.sparkSession.sparkContext.broadcast(list(self.heads.values()))  # one copy per executor
        rule = self._rule()

        def finish() -> Finish:
            return voter(held.value, rule)

        shape = {"reach": reach_of(list(self.heads.values())), "feature": self.length_feature}
        pieces = cut_lineage(finish_windows(cleaned, self.embed, finish, VOTES, **shape))
        stretches, failures = all_stretches(pieces, finish, VOTES, **shape)
        payloads = assemble(stretches, self._reported_threshold())
        blank = cleaned.filter(F.length("sequence") == 0).select("id", F.lit("empty after cleaning").alias("error"))
        return payloads, failures.unionByName(blank)

    def predict(self, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One result row per ``(id, header, sequence)`` and the failures."""
        payload, failures = self.masks(sequences)
        limits = {name: self.thresholds[name] for name in self.heads}
        n = len(self.heads)
        meta = F.create_map(*[F.lit(str(x)) for kv in (self.meta or {"engine": "spanforge"}).items() for x in kv])
        needed = votes_needed(n) if n > 1 and self.aggregation == "majority" else None
        results = sequences.select("id", "header", clean_sequence(F.col("sequence")).alias("sequence")).join(
            payload, "id"
        ).select(
            "id",
            "header",
            "sequence",
            "binary_mask",
            "length",
            "n_epitopes",
            "frac_epitope",
            "p_epitope_mean",
            "p_epitope_max",
            "threshold",
            F.lit("single-checkpoint" if n == 1 else "ensemble-manifest").alias("artifact_mode"),
            F.lit(n).alias("n_members"),
            F.lit(needed).cast("int").alias("votes_needed"),
            F.array(*[F.lit(float(t)) for t in limits.values()]).alias("member_thresholds"),
            meta.alias("meta"),
        )
        return results, failures

    def predict_fasta(self, spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        """Predict the records of a FASTA path; the record position is the id."""
        records = record_numbers(read_fasta(spark, path))
        return self.predict(records.select("id", "header", "sequence"))

    def predict_sequences(
        self, spark: SparkSession, sequences: Mapping[str, str] | Iterable[str]
    ) -> tuple[DataFrame, DataFrame]:
        """Predict in-memory sequences: a header -> sequence mapping, or plain strings."""
        if isinstance(sequences, Mapping):
            rows = [(i, h, s) for i, (h, s) in enumerate(sequences.items(), start=1)]
        else:
            rows = [(i, f"sequence_{i:05d}", s) for i, s in enumerate(sequences, start=1)]
        return self.predict(spark.createDataFrame(rows, "id bigint, header string, sequence string"))


def mask_records(results: DataFrame) -> DataFrame:
    """FASTA lines with the mask in place of the sequence, for the text sink."""
    return fasta_lines(results, "header", "binary_mask")

"""Group-aware train/validation splits, folds and balanced partitions.

Greedy rules look sequential over groups, yet groups of one size are
interchangeable to them: the decision depends on sizes alone, and which group
of a size is meant follows from its rank. So the rules run on the histogram of
sizes (at most sqrt(2 x ids) rows, since distinct sizes must add up to the ids)
and are applied to the groups by distributed rank. No group table passes
through the driver or one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.ranking import ordered_rank, seeded_digest, seeded_rank, hash_block
from spanforge.session import cut_lineage, shuffle_width

def with_groups(ids: DataFrame, groups: DataFrame | None, *, id_col: str = "id", group: str = "group") -> DataFrame:
    """Attach a group to every id; an id without one is its own group."""
    own = F.col(id_col).cast("string")
    if groups is None:
        return ids.select(id_col, own.alias(group))
    joined = ids.select(id_col).join(groups.select(id_col, F.col(group).cast("string").alias(group)), id_col, "left")
    return joined.withColumn(group, F.coalesce(F.col(group), own))


def missing_family_groups(ids: DataFrame, families: DataFrame, *, id_col: str = "id", family: str = "family") -> DataFrame:
    """Families as groups; an id without a family becomes a marked singleton."""
    joined = ids.select(id_col).join(families.select(id_col, family), id_col, "left")
    text = F.col(family).cast("string")
    alone = F.concat(F.lit("__missing_family__:"), F.col(id_col).cast("string"))
    return joined.select(id_col, F.when(text.isNull() | (text == ""), alone).otherwise(text).alias("group"))


def split_ids(ids: DataFrame, val_frac: float, seed: int, *, id_col: str = "id") -> DataFrame:
    """Random split: the first floor(n x f) ids of the shuffle validate.
    A fraction outside [0, 1] trains on everything."""
    if not 0.0 <= val_frac <= 1.0:
        return ids.select(id_col, F.lit("train").alias("role"))
    ranked = seeded_rank(ids.select(id_col), seed, id_col)
    cut = F.floor(F.col("total_n") * F.lit(float(val_frac)))
    role = F.when(F.col("rank") <= cut, "validation").otherwise("train")
    return ranked.select(id_col, role.alias("role"))


def kfold(ids: DataFrame, n_folds: int, seed: int, *, id_col: str = "id") -> DataFrame:
    """Shuffled position modulo k; ``fold_index`` is 1-based."""
    if n_folds < 2:
        raise ValueError("n_folds must be >= 2")
    ranked = seeded_rank(ids.select(id_col), seed, id_col)
    short = F.raise_error(F.lit(f"n_folds={n_folds} exceeds the number of ids")).cast("bigint")
    fold = F.when(F.col("total_n") < n_folds, short).otherwise(F.pmod(F.col("rank") - 1, F.lit(n_folds)) + 1)
    return ranked.select(id_col, fold.cast("int").alias("fold_index"))


# --- size classes ----------------------------------------------------------


def group_sizes(grouped: DataFrame, *, group: str = "group") -> DataFrame:
    """``(group, size)``."""
    return grouped.groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def _histogram(sizes: DataFrame, size: str) -> list[tuple]:
    """(size, count) pairs, largest size first: one row per distinct size."""
    rows = sizes.groupBy(size).agg(F.count(F.lit(1)).alias("n"))
    return sorted(((r[size], int(r["n"])) for r in rows.collect()), reverse=True)


def _rank_in_class(sizes: DataFrame, size: str, seed: int) -> DataFrame:
    """Rank of each group among the groups of its size, in seeded order."""
    tagged = sizes.withColumn("_digest", seeded_digest(seed, F.col("group")))
    block = hash_block(F.col("_digest"), shuffle_width(sizes))
    return ordered_rank(tagged, [F.col("_digest"), F.col("group")], [size], block=block).drop("_digest")


def holdout_plan(histogram: Sequence[tuple[int, int]], target: int) -> list[tuple[int, int, int]]:
    """Which ranks of each size class validate: ``(size, first t, extra rank or 0)``.

    A group is taken while it brings the count strictly closer to the target,
    that is while size < 2 x gap, or when without it the rest cannot reach the
    target. Within a class the gap shrinks by one size per taken group, so the
    number taken is arithmetic; a forced group closes the gap, so there is at
    most one.
    """
    taken, left = 0, sum(s * c for s, c in histogram)
    plan = []
    for size, count in histogram:
        gap = target - taken
        if gap <= 0:
            break
        natural = min(count, (2 * gap - size - 1) // (2 * size) + 1) if size < 2 * gap else 0
        taken += natural * size
        left -= natural * size
        rest, forced = count - natural, 0
        if rest and taken < target:
            # After j skipped groups, left - j x size must still cover the gap.
            j = (taken + left - target) // size + 1
            if j <= rest:
                forced = natural + j
                taken += size
        left -= rest * size
        plan.append((size, natural, forced))
    return plan


def split_grouped(
    ids: DataFrame,
    groups: DataFrame | None,
    val_frac: float,
    seed: int,
    *,
    id_col: str = "id",
) -> DataFrame:
    """Split with whole groups: largest groups first, as close to floor(n x f) as they get."""
    grouped = with_groups(ids, groups, id_col=id_col)
    if not 0.0 < val_frac < 1.0:
        role = "validation" if val_frac == 1.0 else "train"
        return grouped.withColumn("role", F.lit(role))
    sizes = group_sizes(grouped)
    histogram = _histogram(sizes, "size")
    target = int(sum(s * c for s, c in histogram) * val_frac)
    plan = ids.sparkSession.createDataFrame(
        holdout_plan(histogram, target) or [(0, 0, 0)], "size bigint, first_n bigint, forced bigint"
    )
    ranked = _rank_in_class(sizes, "size", seed)
    # One row per distinct size: at most sqrt(2 x ids) rows.
    chosen = ranked.join(F.broadcast(plan), "size", "left")
    picked = (F.col("rank") <= F.col("first_n")) | (F.col("rank") == F.col("forced"))
    roles = chosen.select("group", F.when(picked, "validation").otherwise("train").alias("role"))
    return grouped.join(roles, "group").select(id_col, "group", "role")


def longest_first_plan(
    histogram: Sequence[tuple[int, int]], n_bins: int
) -> list[tuple[int, int, int, list[int]]]:
    """Bin of every rank in every weight class under longest-first greedy.

    The next item goes to the lightest bin (ties: fewer items, lower index).
    Bins within one weight of the lightest take turns in a fixed cycle until the
    next heavier bin comes within reach, so a class is at most ``n_bins + 1``
    runs ``(weight, first rank, last rank, cycle of bins)``. Loads are exact
    fractions, so weights need not be whole numbers.
    """
    loads, items = [0] * n_bins, [0] * n_bins
    runs = []
    for value, count in histogram:
        weight, done = Fraction(value), 0
        while done < count:
            floor_ = min(loads)
            cycle = sorted((b for b in range(n_bins) if loads[b] < floor_ + weight),
                           key=lambda b: (loads[b], items[b], b))
            heavier = [loads[b] for b in range(n_bins) if loads[b] >= floor_ + weight]
            rounds = (count - done) // len(cycle)
            if heavier:
                rounds = min(rounds, int((min(heavier) - floor_) // weight))
            if rounds == 0:
                cycle, rounds = cycle[: count - done], 1
            span = rounds * len(cycle)
            runs.append((value, done + 1, done + span, cycle))
            for b in cycle:
                loads[b] += rounds * weight
                items[b] += rounds
            done += span
    return runs


def _assign_bins(ranked: DataFrame, runs, weight: str, out: str) -> DataFrame:
    """Attach the 0-based bin of each (weight, rank) from the run table."""
    spark = ranked.sparkSession
    table = spark.createDataFrame(
        runs, f"{weight} {ranked.schema[weight].dataType.simpleString()}, first_rank bigint, last_rank bigint, cycle array<int>"
    )
    joined = ranked.join(table, weight).filter(F.col("rank").between(F.col("first_rank"), F.col("last_rank")))
    turn = F.pmod(F.col("rank") - F.col("first_rank"), F.size("cycle")).cast("int")
    return joined.withColumn(out, F.get(F.col("cycle"), turn)).drop("first_rank", "last_rank", "cycle")


def kfold_grouped(
    ids: DataFrame, groups: DataFrame | None, n_folds: int, seed: int, *, id_col: str = "id"
) -> DataFrame:
    """Folds of whole groups: the largest group goes to the smallest fold."""
    if n_folds < 2:
        raise ValueError("n_folds must be >= 2")
    grouped = with_groups(ids, groups, id_col=id_col)
    sizes = group_sizes(grouped)
    histogram = _histogram(sizes, "size")
    if not histogram:
        raise ValueError("ids cannot be empty")
    n_groups = sum(c for _, c in histogram)
    if n_groups < n_folds:
        raise ValueError(f"n_folds={n_folds} exceeds the number of groups {n_groups}")
    placed = _assign_bins(_rank_in_class(sizes, "size", seed), longest_first_plan(histogram, n_folds),
                          "size", "_bin")
    folds = placed.select("group", (F.col("_bin") + 1).alias("fold_index"))
    return grouped.join(folds, "group").select(id_col, "group", "fold_index")


def partition_weighted(
    ids: DataFrame, n_parts: int, *, id_col: str = "id", weight: str = "weight", group: str | None = None,
    require_all: bool = False,
) -> DataFrame:
    """Longest-first partitions by weight; missing or bad weights count 1.

    Equal weights are placed in (group, id) order. The driver walks the distinct
    weights (not the ids); the run table has at most (n_parts + 1) rows for each.
    """
    if n_parts < 1:
        raise ValueError("n_parts must be >= 1")
    raw = F.col(weight).cast("double")
    usable = F.when((raw > 0) & ~F.isnan(raw) & (raw < F.lit(float("inf"))), raw).otherwise(1.0)
    home = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    items = ids.select(id_col, usable.alias("weight"), home.alias("group"))
    histogram = _histogram(items, "weight")
    n_ids = sum(c for _, c in histogram)
    if require_all and n_ids < n_parts:
        raise ValueError(f"{n_ids} ids cannot fill {n_parts} partitions")
    if not histogram:
        return items.withColumn("part", F.lit(0))
    ranked = ordered_rank(items, [F.col("group"), F.col(id_col)], ["weight"])
    return _assign_bins(ranked, longest_first_plan(histogram, n_parts), "weight", "part").select(
        id_col, "group", "weight", "part"
    )


# --- label-stratified splits ----------------------------------------------

# Weights of the balance score.
BALANCE_WEIGHTS = {"proteins": 1.0, "valid": 0.5, "pos": 2.0, "neg": 2.0, "rate": 3.0, "empty": 0.25}
_STATS = ("proteins", "valid", "pos", "neg")


def balance_score(stats: np.ndarray, target: np.ndarray, total: np.ndarray, overall_rate: float | None) -> np.ndarray:
    """Distance of (.., 4) statistics [proteins, valid, pos, neg] from their target."""
    w = BALANCE_WEIGHTS
    error = np.abs(stats - target) / np.maximum(total, 1.0)
    score = np.zeros(error.shape[:-1])
    for i, name in enumerate(_STATS):  # fixed order, so equal candidates tie exactly
        score = score + w[name] * error[..., i]
    valid = stats[..., 1]
    if overall_rate is not None:
        rate = stats[..., 2] / np.maximum(valid, 1.0)
        score = score + np.where(valid > 0, w["rate"] * np.abs(rate - overall_rate), 0.0)
    if target[1] > 0:
        score = score + np.where(valid == 0, w["empty"], 0.0)
    return score


def _by_rate_deviation(stats: np.ndarray, names: np.ndarray, overall: float | None) -> np.ndarray:
    base = overall if overall is not None else 0.0
    rate = np.where(stats[:, 1] > 0, stats[:, 2] / np.maximum(stats[:, 1], 1.0), base)
    deviation = np.abs(rate - overall) if overall is not None else np.zeros(len(stats))
    return np.lexsort((names, -stats[:, 0], -stats[:, 1], -deviation))


def greedy_holdout(stats: np.ndarray, names: np.ndarray, val_frac: float, overall: float | None) -> np.ndarray:
    """Boolean mask of the groups that validate: repeatedly the best-scoring group."""
    total = stats.sum(axis=0)
    target = np.array([float(int(total[0] * val_frac)), *(total[1:] * val_frac)])
    chosen = np.zeros(len(stats), dtype=bool)
    if target[0] <= 0:
        return chosen
    order = _by_rate_deviation(stats, names, overall)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    current = np.zeros(4)
    while chosen.sum() + 1 < len(stats):
        open_ = np.flatnonzero(~chosen)
        after = current + stats[open_]
        scores = balance_score(after, target, total, overall)
        ties = np.lexsort((place[open_], names[open_], -after[:, 1], np.abs(after[:, 0] - target[0]), scores))
        best = ties[0]
        improves = scores[best] < balance_score(current, target, total, overall)
        if not (current[0] < target[0] or improves):
            break
        chosen[open_[best]] = True
        current = after[best]
    return chosen


def greedy_folds(stats: np.ndarray, names: np.ndarray, n_folds: int, total: np.ndarray) -> np.ndarray:
    """0-based fold of every group, each placed where the summed score is least.
    ``total`` are the statistics of all groups, also of those not placed here."""
    overall = total[2] / total[1] if total[1] > 0 else None
    target = total / n_folds
    fold = np.empty(len(stats), dtype=np.int64)
    state, members = np.zeros((n_folds, 4)), np.zeros(n_folds)
    now = balance_score(state, target, total, overall)
    for g in _by_rate_deviation(stats, names, overall):
        after = balance_score(state + stats[g], target, total, overall)
        swapped = np.tile(now, (n_folds, 1))
        np.fill_diagonal(swapped, after)
        # Left-to-right sums, so equal candidates tie exactly.
        summed = np.add.accumulate(swapped, axis=1)[:, -1]
        pick = np.lexsort((np.arange(n_folds), members, state[:, 0], summed))[0]
        fold[g] = pick
        state[pick] += stats[g]
        members[pick] += 1
        now[pick] = after[pick]
    return fold


def group_support(grouped: DataFrame, support: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Label support summed per group; ids without support add only themselves."""
    joined = grouped.join(
        support.select(id_col, "valid_residues", "positive_residues", "negative_residues"), id_col, "left"
    )
    return joined.groupBy("group").agg(
        F.count(F.lit(1)).alias("protein_count"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("valid_residues", "positive_residues", "negative_residues")],
    )


#: A group is heavy if it holds a 1/HEAVY share of any statistic, so at most 4 x HEAVY are.
HEAVY = 1000
_SUPPORT = ("protein_count", "valid_residues", "positive_residues", "negative_residues")
#: The golden ratio: its multiples modulo 1 spread any run of consecutive ranks evenly.
_GOLDEN = 0.6180339887498949


def _weigh_groups(table: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray, int]:
    """(light groups, heavy statistics, heavy names, totals, number of groups)."""
    sums = table.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUPPORT], F.count(F.lit(1)).alias("n")).first()
    heavy = F.lit(False)
    for c in _SUPPORT:
        if sums[c] > 0:
            heavy = heavy | (F.col(c) * HEAVY >= F.lit(sums[c]))
    rows = table.filter(heavy).collect()
    stats = np.array([[r[c] for c in _SUPPORT] for r in rows], float).reshape(-1, 4)
    names = np.array([r["group"] for r in rows], dtype=str)
    return table.filter(~heavy), stats, names, np.array([sums[c] for c in _SUPPORT], float), sums["n"]


def _light_shares(light: DataFrame, overall: float | None, target: np.ndarray, placed: np.ndarray) -> tuple[Column, np.ndarray]:
    """Which light groups are rich (rate above ``overall``), and the share of the rich
    and of the other ones that each side needs to come from ``placed`` to ``target``.

    Positives and negatives still wanted are two equations in the two shares. Shares
    below nothing are set to nothing. Without such equations the shares are equal and
    follow the valid residues, or the ids where there are none.
    """
    rich = F.lit(False) if overall is None else F.coalesce(F.col("positive_residues") / F.nullif("valid_residues", F.lit(0)) > overall, F.lit(False))
    names = _SUPPORT[2:]
    sums = light.agg(*[F.coalesce(F.sum(F.when(rich if k == 0 else ~rich, F.col(c))), F.lit(0)) for c in names for k in (0, 1)]).first()
    held = np.array(sums, float).reshape(2, 2)
    want = target - placed
    if held[0, 0] * held[1, 1] != held[0, 1] * held[1, 0]:
        shares = np.linalg.solve(held, want[:, 2:].T)
    else:
        shares = np.tile(want[:, 1 if target[:, 1].sum() > 0 else 0], (2, 1))
    shares = np.maximum(shares, 0.0)
    whole = shares.sum(axis=1, keepdims=True)
    return rich, np.where(whole > 0, shares / np.maximum(whole, 1e-300), 1 / len(target))


def _deal_light(light: DataFrame, rich: Column, shares: np.ndarray, first: Sequence[int] = ()) -> DataFrame:
    """``(group, pick)``: side ``i`` gets ``shares[0, i]`` of the rich light groups and
    ``shares[1, i]`` of the others.

    Groups are ranked by positive rate, valid residues and ids; the rank's golden
    multiple picks the side, so every run of similar groups is divided by the shares.
    The ranks at the front go to the sides in ``first``, one each.
    """
    rate = F.when(F.col("valid_residues") > 0, F.col("positive_residues") / F.col("valid_residues")).otherwise(-1.0)
    keyed = light.withColumns({"_rate": rate, "_rich": rich})
    ranked = ordered_rank(keyed, [F.col("_rate"), -F.col("valid_residues"), -F.col("protein_count"), F.col("group")])
    at = F.pmod(F.col("rank") * F.lit(_GOLDEN), F.lit(1.0))
    pick = F.lit(shares.shape[1] - 1)
    for side, (above, below) in reversed(list(enumerate(np.cumsum(shares, axis=1)[:, :-1].T.tolist()))):
        pick = F.when(at < F.when(F.col("_rich"), above).otherwise(below), side).otherwise(pick)
    for rank, side in enumerate(first, 1):
        pick = F.when(F.col("rank") == rank, int(side)).otherwise(pick)
    return ranked.select("group", pick.cast("bigint").alias("pick"))


def _place(table: DataFrame, light: DataFrame, names, stats, picks, overall, target, first: Sequence[int] = ()) -> DataFrame:
    """``(group, pick)`` of all groups: the heavy ones as picked, the light ones dealt."""
    placed = np.zeros_like(target)
    np.add.at(placed, np.asarray(picks, int), stats)
    rich, shares = _light_shares(light, overall, target, placed)
    heavy = table.sparkSession.createDataFrame([(str(g), int(p)) for g, p in zip(names, picks)], "group string, pick bigint")
    return heavy.unionByName(_deal_light(light, rich, shares, first))


def split_stratified(
    ids: DataFrame, groups: DataFrame | None, support: DataFrame, val_frac: float, *, id_col: str = "id",
) -> DataFrame:
    """Group split balancing label support, by one rule at every size.

    Heavy groups (at least a 1/HEAVY share of some statistic, so a bounded number) are
    placed one by one by the balance score; where all groups are heavy that is the whole
    rule. Light groups are dealt by rank so that validation reaches its share of
    positives and negatives. This is not the one-by-one search over all groups, which is sequential. The seed of the
    original rule decides nothing, so none is taken.
    """
    grouped = with_groups(ids, groups, id_col=id_col)
    if not 0.0 < val_frac < 1.0:
        return grouped.withColumn("role", F.lit("validation" if val_frac == 1.0 else "train"))
    table = cut_lineage(group_support(grouped, support, id_col=id_col))
    light, stats, names, total, _ = _weigh_groups(table)
    overall = total[2] / total[1] if total[1] > 0 else None
    chosen = greedy_holdout(stats, names, val_frac, overall)
    target = np.outer([1 - val_frac, val_frac], total)
    picks = _place(table, light, names, stats, chosen, overall, target)
    roles = picks.select("group", F.when(F.col("pick") == 1, "validation").otherwise("train").alias("role"))
    return grouped.join(roles, "group").select(id_col, "group", "role")


def kfold_stratified(
    ids: DataFrame, groups: DataFrame | None, support: DataFrame, n_folds: int, *, id_col: str = "id",
) -> DataFrame:
    """Folds of whole groups with balanced label support, by the rule of
    :func:`split_stratified`; no fold stays empty."""
    if n_folds < 2:
        raise ValueError("n_folds must be >= 2")
    grouped = with_groups(ids, groups, id_col=id_col)
    table = cut_lineage(group_support(grouped, support, id_col=id_col))
    light, stats, names, total, n_groups = _weigh_groups(table)
    if n_groups < n_folds:
        raise ValueError(f"n_folds={n_folds} exceeds the number of groups {n_groups}")
    fold = greedy_folds(stats, names, n_folds, total)
    empty = sorted(set(range(n_folds)) - set(fold.tolist()))
    if len(empty) > n_groups - len(names):
        raise ValueError(f"folds {[f + 1 for f in empty]} would stay empty; use fewer folds")
    overall = total[2] / total[1] if total[1] > 0 else None
    picks = _place(table, light, names, stats, fold, overall, np.tile(total / n_folds, (n_folds, 1)), empty)
    folds = picks.select("group", (F.col("pick") + 1).cast("int").alias("fold_index"))
    return grouped.join(folds, "group").select(id_col, "group", "fold_index")


# --- plans and reports -----------------------------------------------------


@dataclass(frozen=True)
class FoldPlan:
    """Which fold an id validates in, once per seed pair; runs and reports follow from it.

    ``rows`` is ``(set_number, id, group, fold)``; an id in fold 0 validates in no run.
    With one fold a plan is a holdout: a single run per seed pair.
    """

    rows: DataFrame
    n_folds: int
    split_seeds: tuple[int, ...]
    train_seeds: tuple[int, ...]
    id_col: str = "id"

    def _run(self) -> list[Column]:
        """run_index, set_index and fold_index of the run that fold ``_fold`` validates."""
        if self.n_folds == 1:
            none = F.lit(None).cast("int")
            return [F.col("set_number").alias("run_index"), none.alias("set_index"), none.alias("fold_index")]
        run = (F.col("set_number") - 1) * self.n_folds + F.col("_fold")
        return [run.cast("int").alias("run_index"), F.col("set_number").alias("set_index"), F.col("_fold").alias("fold_index")]

    def _folds(self) -> Column:
        return F.explode(F.sequence(F.lit(1), F.lit(self.n_folds))).alias("_fold")

    def runs(self) -> DataFrame:
        """Long plan ``(run_index, set_index, fold_index, split_seed, train_seed, id, group, role)``:
        every id once per run, for those who read one run at a time."""
        def seed(values: Sequence[int]) -> Column:
            return F.get(F.array(*[F.lit(v) for v in values]), F.col("set_number") - 1)

        long = self.rows.select("*", self._folds())
        role = F.when(F.col("fold") == F.col("_fold"), "validation").otherwise("train")
        return long.select(
            *self._run(), seed(self.split_seeds).alias("split_seed"), seed(self.train_seeds).alias("train_seed"), self.id_col, "group",
            role.alias("role"))

    def sums(self, rows: DataFrame, measures: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
        """Sums of ``measures`` per run, role and ``keys``; ``rows`` are the plan's, with more columns.

        Rows are summed once per fold; a run's training side is the total less its own fold.
        """
        keys = list(keys)
        per_fold = rows.groupBy("set_number", *keys, "fold").agg(*[c.alias(m) for m, c in measures.items()])
        cell = F.struct(F.col("fold"), *measures)  # at most one per fold
        packed = per_fold.groupBy("set_number", *keys).agg(F.collect_list(cell).alias("cells"), *[F.sum(m).alias(f"all_{m}") for m in measures])
        spread = packed.select("*", self._folds())
        own = F.get(F.filter("cells", lambda c: c["fold"] == F.col("_fold")), F.lit(0))
        sides = spread.select(*self._run(), *keys, own.alias("own"), *[f"all_{m}" for m in measures])
        held = {m: F.coalesce(F.col(f"own.{m}"), F.lit(0)) for m in measures}
        both = F.array(
            F.struct(F.lit("train").alias("role"), *[(F.col(f"all_{m}") - held[m]).alias(m) for m in measures]),
            F.struct(F.lit("validation").alias("role"), *[held[m].alias(m) for m in measures]))
        return sides.select("run_index", *keys, F.inline(both)).select("run_index", "role", *keys, *measures)


def fold_plan(
    ids: DataFrame,
    groups: DataFrame | None,
    *,
    n_folds: int,
    val_frac: float = 0.2,
    split_seeds: Sequence[int] | None = None,
    train_seeds: Sequence[int] | None = None,
    seed: int = 42,
    strategy: str = "size-balanced",
    support: DataFrame | None = None,
    id_col: str = "id",
) -> FoldPlan:
    """The folds (or the holdout) of every seed pair.

    Split and train seeds are paired by position; give both or neither.
    """
    if n_folds < 1:
        raise ValueError("n_folds must be >= 1")
    if (split_seeds is None) != (train_seeds is None):
        raise ValueError("give split_seeds and train_seeds together")
    if strategy not in ("size-balanced", "label-stratified"):
        raise ValueError("strategy must be size-balanced or label-stratified")
    if strategy == "label-stratified" and support is None:
        raise ValueError("label-stratified splits need label support")
    split_seeds = [seed] if split_seeds is None else list(split_seeds)
    train_seeds = [seed] if train_seeds is None else list(train_seeds)
    if len(split_seeds) != len(train_seeds):
        raise ValueError("split_seeds and train_seeds must have the same length")

    every = None
    for number, split_seed in enumerate(split_seeds, start=1):
        if strategy == "label-stratified" and n_folds == 1:
            placed = split_stratified(ids, groups, support, val_frac, id_col=id_col)
        elif strategy == "label-stratified":
            placed = kfold_stratified(ids, groups, support, n_folds, id_col=id_col)
        elif groups is not None and n_folds == 1:
            placed = split_grouped(ids, groups, val_frac, split_seed, id_col=id_col)
        elif groups is not None:
            placed = kfold_grouped(ids, groups, n_folds, split_seed, id_col=id_col)
        else:  # without groups an id is its own
            alone = split_ids(ids, val_frac, split_seed, id_col=id_col) if n_folds == 1 else kfold(ids, n_folds, split_seed, id_col=id_col)
            placed = alone.withColumn("group", F.col(id_col).cast("string"))
        fold = F.when(F.col("role") == "validation", 1).otherwise(0) if n_folds == 1 else F.col("fold_index").cast("int")
        rows = placed.select(F.lit(number).alias("set_number"), id_col, "group", fold.alias("fold"))
        every = rows if every is None else every.unionByName(rows)
    return FoldPlan(every, n_folds, tuple(map(int, split_seeds)), tuple(map(int, train_seeds)), id_col)


def run_plans(ids: DataFrame, groups: DataFrame | None, **options) -> DataFrame:
    """The long plan of :func:`fold_plan`: every id in every run."""
    return fold_plan(ids, groups, **options).runs()


def leaked_groups(plan: FoldPlan, groups: DataFrame | None = None) -> DataFrame:
    """``(run_index, group)`` of groups on both sides of a run; empty for a clean plan.

    A group in several folds leaks in the run of each. ``groups`` ``(id, group)`` checks the
    plan against other groups than its own.
    """
    rows = plan.rows if groups is None else plan.rows.drop("group").join(groups.select(plan.id_col, F.col("group").cast("string").alias("group")), plan.id_col)
    folds = rows.groupBy("set_number", "group").agg(F.collect_set("fold").alias("folds")).filter(F.size("folds") > 1)
    each = folds.select("set_number", "group", F.explode("folds").alias("_fold")).filter("_fold > 0")
    return each.select(*plan._run(), "group").select("run_index", "group")


def split_report(plan: FoldPlan, support: DataFrame) -> DataFrame:
    """Support per run and role, plus one row over all ids (nulls as keys)."""
    names = ("valid_residues", "positive_residues", "negative_residues")
    joined = plan.rows.join(support.select(plan.id_col, *names), plan.id_col, "left")
    measures = {"protein_count": F.count(F.lit(1)), **{c: F.coalesce(F.sum(c), F.lit(0)) for c in names}}
    per_role = cut_lineage(plan.sums(joined, measures))  # two rows a run
    # The two sides of any run are all ids.
    every = per_role.filter("run_index = 1").agg(*[F.sum(m).alias(m) for m in measures]).select(
        F.lit(None).cast("int").alias("run_index"), F.lit("all").alias("role"), *measures)
    rate = F.when(F.col("valid_residues") > 0, F.col("positive_residues") / F.col("valid_residues"))
    return per_role.filter("protein_count > 0").unionByName(every).withColumn("positive_rate", rate)


def family_counts(plan: FoldPlan, families: DataFrame | None = None, *, family: str = "group") -> DataFrame:
    """Ids per run, role and family, as rows (a family map is as long as the families).
    ``families`` ``(id, family)`` stands for the plan's own groups."""
    rows = plan.rows if families is None else plan.rows.drop(family).join(families.select(plan.id_col, family), plan.id_col)
    return plan.sums(rows, {"n_ids": F.count(F.lit(1))}, [family]).filter("n_ids > 0")


def shard_counts(plan: FoldPlan, support: DataFrame) -> DataFrame:
    """Ids per run, role and label shard; ids without labels under a marker."""
    shards = plan.rows.join(support.select(plan.id_col, "label_shard"), plan.id_col, "left")
    named = shards.withColumn("label_shard", F.coalesce("label_shard", F.lit("__missing_label__")))
    return plan.sums(named, {"n_ids": F.count(F.lit(1))}, ["label_shard"]).filter("n_ids > 0")


def as_maps(counts: DataFrame, key: str, out: str, *, run: str = "run_index") -> DataFrame:
    """Fold a (bounded) count table into one sorted map per run and role for a JSON report."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col("n_ids").alias("v"))))
    return counts.groupBy(run, "role").agg(F.map_from_entries(entries).alias(out))


def locality_order(ids: DataFrame, *, group: str = "group", id_col: str = "id") -> DataFrame:
    """Members of a group sit together: range partitions on (group, id), sorted inside."""
    home = F.coalesce(F.col(group).cast("string"), F.lit(""))
    return ids.repartitionByRange(home, F.col(id_col)).sortWithinPartitions(home, F.col(id_col))


def group_block_order(ids: DataFrame, seed: int, *, group: str = "group", id_col: str = "id") -> DataFrame:
    """Seeded order of groups with contiguous members; ``block_digest`` sorts the groups."""
    home = F.coalesce(F.col(group).cast("string"), F.lit(""))
    return ids.withColumn("block_digest", seeded_digest(seed, home)).orderBy("block_digest", group, id_col)

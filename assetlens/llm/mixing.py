"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  Token weights of the cells are raked, one
margin after the other, until every margin has its target shares; a cell's sampling rate is its
raked weight over its tokens, scaled so that the expected tokens of the sample are the budget, with
no probability above one.  A document is taken if the hash of its id and text, as a number from 0
to 1, is below its cell's probability, so a repeated run takes the same documents.

The cells are an aggregate: one row for each combination that occurs.  Up to ``DRIVER_CELLS`` of
them are raked in arrays and sent to the tasks; more are raked by Spark, margin by margin, by the
same rule: rounds go on until no factor differs from one by more than ``TOLERANCE``, or ``ROUNDS``
are over, when a warning tells the margin error that is left (targets may contradict each other).

Cases: a null source or language is the category ``unknown``; null or empty text is the topic
``empty`` with no tokens and probability one times the rate of its cell; categories without a
target keep their present share; targets without documents are left out and the others scaled up;
repeated rows with one id and text are taken or left together; an empty table gives no rows; other
columns are carried along, except those named like a result.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, only, stored

MARGINS = ("source", "lang", "topic")
DRIVER_CELLS = 100_000
ROUNDS, TOLERANCE = 200, 1e-9


def token_count(text: Column) -> Column:
    """Words between blanks: the size measure of the mix."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """Kind of content by its make-up: records, symbols, or prose by length."""
    size = F.length(text)
    digits, symbols = (F.regexp_count(text, F.lit(p)) for p in ("[0-9]", r"[%#$&*|<>{}\[\]=+~^]"))
    return (
        F.when(F.coalesce(tokens, F.lit(0)) == 0, "empty")
        .when(symbols > 0.05 * size, "symbols")
        .when(digits > 0.05 * size, "records")
        .when(tokens < 100, "note")
        .when(tokens < 1000, "article")
        .otherwise("chapter")
    )


def with_cells(docs: DataFrame) -> DataFrame:
    """Adds n_tokens and topic and fills null margins."""
    docs = only(docs, "n_tokens", "topic")
    out = docs.withColumn("n_tokens", token_count(F.col("text")))
    out = out.withColumn("topic", topic_of(F.col("text"), F.col("n_tokens")))
    return out.withColumns({f"_{m}": F.coalesce(F.col(m).cast("string"), F.lit("unknown")) for m in MARGINS})


def targets_for(present: dict[str, float], wanted: dict[str, float] | float) -> dict[str, float]:
    """Target shares over the categories ``present`` (token sums): a power of the present shares, or a table."""
    total = sum(present.values())
    if not total:
        return {k: 1 / len(present) for k in present}
    if not isinstance(wanted, dict):
        raw = {k: (v / total) ** wanted if v else 0.0 for k, v in present.items()}
    else:
        rest = max(0.0, 1 - sum(wanted.values()))
        other = sum(v for k, v in present.items() if k not in wanted)
        raw = {k: (wanted[k] if k in wanted else (rest or other / total) * v / other) if v else 0.0 for k, v in present.items()}
    scale = sum(raw.values())
    return {k: v / scale for k, v in raw.items()} if scale else {k: v / total for k, v in present.items()}


def rake(tokens: np.ndarray, codes: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the cells whose margins have the target shares of all tokens. codes: cell by margin."""
    weight, total = tokens.astype(float), float(tokens.sum())
    for _ in range(rounds):
        off = 0.0
        for m, target in enumerate(targets):
            now = np.bincount(codes[:, m], weight, len(target))
            factor = np.divide(target * total, now, out=np.ones(len(target)), where=now > 0)
            off = max(off, float(np.abs(factor - 1).max(initial=0)))
            weight = weight * factor[codes[:, m]]
        if off < TOLERANCE:
            return weight
    _left(off)
    return weight


def _left(off: float) -> None:
    warnings.warn(f"a margin is still off by a factor of {1 + off:.6g} after {ROUNDS} rounds", stacklevel=3)


def calibrated(sums: Callable[[float], tuple[float, float]], budget: float) -> float:
    """Factor f for which the sum of tokens * min(1, f * rate) is the budget (at most all tokens).

    ``sums(f)``: tokens of the cells with f * rate >= 1, and the sum of tokens * rate of the others.
    The cells taken whole only become more, so few rounds find them.
    """
    f = 0.0
    while True:
        whole, part = sums(f)
        new = (budget - whole) / part if part > 0 else f
        if new <= f * (1 + 1e-14):
            return f
        f = new


def _cells(docs: DataFrame) -> DataFrame:
    return docs.groupBy(*(f"_{m}" for m in MARGINS)).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))


def probabilities(docs: DataFrame, wanted: dict[str, dict[str, float] | float], budget_share: float) -> DataFrame:
    """(_source, _lang, _topic, weight, probability) of each cell of ``with_cells`` documents."""
    spark = docs.sparkSession
    cells = stored(_cells(docs), "cells")
    n = cells.count()
    if n > DRIVER_CELLS:
        return rake_by_spark(cells, wanted, budget_share)
    rows = cells.collect()
    schema = "_source string, _lang string, _topic string, weight double, probability double"
    if not n:
        return spark.createDataFrame([], schema)
    tokens = np.array([r["tokens"] for r in rows], float)
    codes, targets = np.zeros((n, len(MARGINS)), int), []
    for m, name in enumerate(MARGINS):
        values = [r[f"_{name}"] for r in rows]
        names = sorted(set(values))
        codes[:, m] = [names.index(v) for v in values]
        present = dict(zip(names, np.bincount(codes[:, m], tokens, len(names)).tolist()))
        shares = targets_for(present, wanted[name])
        targets.append(np.array([shares[k] for k in names]))
    rate = np.divide(rake(tokens, codes, targets), tokens, out=np.ones(n), where=tokens > 0)

    def sums(f: float) -> tuple[float, float]:
        whole = f * rate >= 1
        return float(tokens[whole].sum()), float((tokens * rate)[~whole].sum())

    chance = np.minimum(1, rate * calibrated(sums, budget_share * tokens.sum()))
    # At most DRIVER_CELLS rows: sent to the tasks, so that documents aren't shuffled.
    return F.broadcast(spark.createDataFrame([(*(r[f"_{m}"] for m in MARGINS), float(w), float(p)) for r, w, p in zip(rows, rate, chance)], schema))


def rake_by_spark(cells: DataFrame, wanted: dict[str, dict[str, float] | float], budget_share: float, rounds: int = ROUNDS) -> DataFrame:
    """The same for any number of cells: margins are grouped sums, targets are joined, nothing is collected but sums."""
    total = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    state = cells.withColumn("w", F.col("tokens").cast("double"))
    goals = {}
    for name in MARGINS:
        col = f"_{name}"
        present = cells.groupBy(col).agg(F.sum("tokens").cast("double").alias("now"))
        want = wanted[name]
        if isinstance(want, dict):
            table = F.create_map(*(F.lit(x) for k, v in want.items() for x in (k, float(v)))) if want else F.create_map().cast("map<string,double>")
            rest = max(0.0, 1 - sum(want.values()))
            other = present.filter(~F.col(col).isin(list(want))).agg(F.coalesce(F.sum("now"), F.lit(0.0))).first()[0]
            raw = F.when(F.col("now") > 0, F.coalesce(table[F.col(col)], F.lit((rest or other / total) / other if other else 0.0) * F.col("now"))).otherwise(0.0)
        else:
            raw = F.when(F.col("now") > 0, F.pow(F.col("now") / total, F.lit(float(want)))).otherwise(0.0)
        scaled = present.withColumn("raw", raw)
        scale = scaled.agg(F.sum("raw")).first()[0] or 1.0
        goals[col] = stored(scaled.select(col, (F.col("raw") / scale * total).alias("goal")), "goals")
    off = 0.0
    with Scratch() as kept:
        for _ in range(rounds):
            off = 0.0
            for col, goal in goals.items():
                factor = state.groupBy(col).agg(F.sum("w").alias("now")).join(goal, col).select(col, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(1.0).alias("f"))
                factor = kept.stored(factor, "factors")
                off = max(off, factor.agg(F.coalesce(F.max(F.abs(F.col("f") - 1)), F.lit(0.0))).first()[0])
                state = kept.stored(state.join(factor, col).withColumn("w", F.col("w") * F.col("f")).drop("f"), "raked")
            if off < TOLERANCE:
                break
        else:
            _left(off)
        rate = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0)
        state = stored(state.withColumn("weight", rate), "raked")

    def sums(f: float) -> tuple[float, float]:
        whole = F.col("weight") * f >= 1
        got = state.agg(F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("tokens") * F.col("weight")))).first()
        return float(got[0] or 0), float(got[1] or 0)

    chance = F.least(F.lit(1.0), F.col("weight") * calibrated(sums, budget_share * total))
    return state.select(*(f"_{m}" for m in MARGINS), "weight", chance.alias("probability"))


def mixed(docs: DataFrame, wanted: dict[str, dict[str, float] | float], budget_share: float) -> DataFrame:
    """``docs`` with n_tokens, topic, weight, probability and sampled."""
    docs = with_cells(only(docs, "weight", "probability", "sampled"))
    chance = probabilities(docs, wanted, budget_share)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 52)) / float(1 << 52)
    joined = docs.withColumn("_place", place).join(chance, [f"_{m}" for m in MARGINS], "left")
    return joined.withColumn("sampled", F.col("_place") < F.col("probability")).drop("_place", *(f"_{m}" for m in MARGINS))

"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are summed by cell (source, language, topic). The cells' weights are raked to one marginal after
the other until all fit, and documents are then drawn so often that every cell gets its weight of a token
budget; where that is more than a cell has, its documents are repeated. Only the raking residual, one
number, reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankflow.llm.common import Staged, packed_struct, stage, whole_text

MAX_BROADCAST_CELLS = 100_000


@dataclass(frozen=True)
class Mix:
    """Targets by dimension: value to share. Dimensions without targets get their token shares tempered.

    ``token_budget`` is the expected number of tokens drawn; without one, as many as the table has.
    """

    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    temperature: float = 0.9
    tolerance: float = 1e-6
    max_rounds: int = 50
    accept: float = 1e-3
    seed: int = 17
    token_budget: float | None = None


def topic_of(text: Column) -> Column:
    """A stand-in topic for tables without one: the form of the text."""
    body = whole_text(text)
    return (
        F.when(F.contains(body, F.lit(" | ")), "table")
        .when(F.contains(body, F.lit("\n")), "paragraphs")
        .otherwise("line")
    )


def with_targets(cells: DataFrame, dims: list[str], mix: Mix) -> DataFrame:
    """Cells with a target share by dimension, normalised over the values that occur."""
    for dim in dims:
        values = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("value_tokens"))
        given = mix.targets.get(dim)
        if given is None:
            share = F.pow("value_tokens", F.lit(mix.temperature))
        else:
            listed = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
            share = F.coalesce(F.try_element_at(listed, F.col(dim)), F.lit(0.0))
        values = values.select(F.col(dim).alias("value"), share.alias("raw"))
        total = values.select(F.sum("raw").alias("t")).scalar()
        values = values.select("value", (F.col("raw") / F.nullif(total, F.lit(0.0))).alias(f"target_{dim}"))
        cells = cells.join(values, F.col(dim).eqNullSafe(F.col("value")), "left").drop("value")
    return cells


def rake(cells: DataFrame, dims: list[str], mix: Mix = Mix()) -> DataFrame:
    """Cells with ``weight``, raked until the marginals fit to ``tolerance``.

    After ``max_rounds`` a residual (the largest difference of a share) up to ``accept`` is let pass; above it the
    targets contradict each other on the cells there are, and that is an error that names the residual.
    ``cells`` has the dimensions and ``tokens``. Weights sum to 1 over cells with tokens. Raking reads the
    cells only, which are as many as combinations occur; each round is written, so plans stay short.
    """
    names = [f"target_{d}" for d in dims]
    start = with_targets(cells, dims, mix).withColumn("weight", F.col("tokens").cast("double"))
    state = Staged(start.where(F.col("tokens") > 0).select(*dims, "tokens", *names, "weight"), "rake")
    worst = 0.0
    for _ in range(mix.max_rounds):
        df = state.df
        for dim, target in zip(dims, names):
            own = F.sum("weight").over(W.partitionBy(dim))
            df = df.withColumn("weight", F.when(own > 0, F.col("weight") * F.col(target) / own).otherwise(0.0))
        fitted = Staged(df, "rake")
        off = fitted.df.select(
            F.greatest(
                F.lit(0.0),
                *[F.abs(F.sum("weight").over(W.partitionBy(d)) - F.col(t)) for d, t in zip(dims, names)],
            ).alias("off")
        )
        worst = off.agg(F.max("off").alias("off")).first()["off"]
        state.drop()
        state = fitted
        if worst is None or worst <= mix.tolerance:
            break
    else:
        if worst > mix.accept:
            raise ValueError(f"no weights meet the targets: a share is off by {worst:.4f} after {mix.max_rounds} rounds")
    return state.df.select(*dims, "tokens", "weight")


def mixed(docs: DataFrame, dims: dict[str, Column], text: str = "text", mix: Mix = Mix()) -> DataFrame:
    """Struct ``doc`` with the input columns, ``n_tokens, weight, probability, copies, sampled`` and the dimensions.

    Tokens are runs of characters other than white space. ``weight`` is the raked share of the row's cell.
    ``probability`` is the expected number of copies: the cell's share of the token budget over its tokens,
    above 1 where a cell has fewer tokens than its share. ``copies`` is its whole part and, by a draw, one
    more for the fraction; ``sampled`` tells rows with a copy. So a rare cell is repeated and takes from the
    others only what its own weight is worth. A cell without tokens has weight 0 and is kept once, as it costs
    nothing. The draw hashes all input columns, so it does not depend on partitions and repeated rows share
    their fate. Null dimension values form cells of their own. An empty table gives an empty result.
    """
    names = list(dims)
    rows = docs.select(
        packed_struct(docs).alias("doc"),
        *[c.cast("string").alias(f"dim_{n}") for n, c in dims.items()],
    )
    tokens = F.regexp_count(whole_text(F.col(f"doc.`{text}`")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    cells = rows.select(*[f"dim_{n}" for n in names], tokens.alias("tokens"))
    cells = cells.groupBy(*[f"dim_{n}" for n in names]).agg(F.sum("tokens").alias("tokens"))
    keys = [f"dim_{n}" for n in names]
    keyed = replace(mix, targets={f"dim_{k}": v for k, v in mix.targets.items()})
    raked = rake(stage(cells, "cells"), keys, keyed)
    there = raked.select(F.sum("tokens").cast("double").alias("there")).scalar()
    budget = there if mix.token_budget is None else F.lit(float(mix.token_budget))
    fitted = raked.select(F.sum("weight").alias("fitted")).scalar()
    rate = F.col("weight") / F.nullif(fitted, F.lit(0.0)) * budget / F.col("tokens")
    rates = raked.select(
        *[F.col(k).alias(f"rate_{k}") for k in keys], "weight", F.coalesce(rate, F.lit(0.0)).alias("rate")
    )
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"rate_{k}"))
    small = raked.count() <= MAX_BROADCAST_CELLS
    joined = rows.join(F.broadcast(rates) if small else rates, match, "left")
    draw = F.pmod(F.xxhash64("doc", F.lit(mix.seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rate = F.coalesce("rate", F.lit(1.0))
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    return joined.select(
        "doc",
        *[F.col(f"dim_{n}").alias(n) for n in names],
        tokens.alias("n_tokens"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        rate.alias("probability"),
        copies.alias("copies"),
        (copies > 0).alias("sampled"),
    )

"""Arithmetic over parameter tables of a model with low-rank adapters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTENTION, MLP = ("q_proj", "v_proj"), ("up_proj", "gate_proj")


@dataclass(frozen=True)
class Adapter:
    """What an adapter library needs to know besides the names of :func:`target_names`."""

    rank: int = 32
    alpha: int = 64
    dropout: float = 0.05
    mlp_range: tuple[int, int] = (8, 24)

    def settings(self, spark: SparkSession, layers: int) -> dict:
        names = target_names(targets(spark, layers, self.mlp_range))
        return {"r": self.rank, "lora_alpha": self.alpha, "lora_dropout": self.dropout, "bias": "none", "target_modules": names}


def targets(spark: SparkSession, layers: int, mlp_range: tuple[int, int], attention: tuple[str, ...] = ATTENTION, mlp: tuple[str, ...] = MLP) -> DataFrame:
    """``layer, projection, module`` of all adapted projections: attention in all layers, MLP in a range of them."""
    first, last = mlp_range
    if first > last:
        raise ValueError(f"empty range of layers: {mlp_range}")
    grid = spark.range(layers).select(F.col("id").cast("int").alias("layer"))
    kinds = F.when(F.col("layer").between(first, last), F.array(*map(F.lit, attention + mlp))).otherwise(F.array(*map(F.lit, attention)))
    rows = grid.select("layer", F.explode(kinds).alias("projection"))
    block = F.when(F.col("projection").isin(*mlp), F.lit("mlp")).otherwise(F.lit("self_attn"))
    return rows.withColumn("module", F.format_string("model.layers.%d.%s.%s", "layer", block, "projection"))


def target_names(adapted: DataFrame, everywhere: Sequence[str] = ATTENTION) -> list[str]:
    """What an adapter library is told to match, of the rows of :func:`targets`: a projection that is adapted in all layers by its name, others by module."""
    named = adapted.select(F.when(F.col("projection").isin(*everywhere), F.col("projection")).otherwise(F.col("module")).alias("name"), "layer")
    return [r["name"] for r in named.groupBy("name").agg(F.min("layer").alias("layer")).orderBy("layer", "name").collect()]


def adapter_parameters(rows: DataFrame, hidden: int, heads: int, kv_heads: int, head_dim: int, intermediate: int, rank: int) -> DataFrame:
    """``projection, modules, parameters``: rank x (inputs + outputs) for each module."""
    widths = {"q_proj": (hidden, heads * head_dim), "k_proj": (hidden, kv_heads * head_dim), "v_proj": (hidden, kv_heads * head_dim), "o_proj": (heads * head_dim, hidden), "up_proj": (hidden, intermediate), "gate_proj": (hidden, intermediate), "down_proj": (intermediate, hidden)}
    size = F.element_at(F.create_map(*(F.lit(x) for n, (i, o) in widths.items() for x in (n, rank * (i + o)))), F.col("projection"))
    return rows.groupBy("projection").agg(F.count("*").alias("modules"), F.sum(size).alias("parameters"))


def freeze_report(parameters: DataFrame) -> DataFrame:
    """Of ``name, numel, requires_grad``: totals, the share, and how many break the rule that adapters alone are trained."""
    adapter = F.col("name").contains("lora_")
    trained = F.when(F.col("requires_grad"), F.col("numel")).otherwise(0)
    return parameters.agg(
        F.sum(trained).alias("trainable"), F.sum("numel").alias("total"), (100 * F.sum(trained) / F.sum("numel")).alias("percent"),
        F.count_if(adapter & ~F.col("requires_grad")).alias("frozen_adapters"), F.count_if(~adapter & F.col("requires_grad")).alias("trained_base"),
    ).withColumn("summary", F.format_string("trainable params: %,d || all params: %,d || trainable%%: %.4f", "trainable", "total", "percent"))


def frozen(parameters: DataFrame) -> DataFrame:
    return parameters.withColumn("requires_grad", F.col("name").contains("lora_"))

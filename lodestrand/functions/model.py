"""Closed forms about models: parameter totals, learning rates, perplexity."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def parameter_totals(vocab: Column, hidden: Column, layers: Column, heads: Column, kv_heads: Column, ffn: Column, tied: Column) -> dict[str, Column]:
    """Exact trainable parameters of a dense decoder with grouped attention and a gated feed-forward block."""
    v, h, n, f = (c.cast("bigint") for c in (vocab, hidden, layers, ffn))
    kv = kv_heads.cast("bigint") * F.floor(h / heads).cast("bigint")
    parts = {
        "token_embeddings": v * h, "attention_projections": n * (h * h * 2 + h * kv * 2), "feed_forward": n * h * f * 3,
        "normalization": n * h * 2 + h, "output_projection": F.when(tied, F.lit(0).cast("bigint")).otherwise(v * h),
    }
    total = F.lit(0).cast("bigint")
    for c in parts.values():
        total = total + c
    return parts | {"total": total}


def training_bytes(total: Column, context: Column, hidden: Column, layers: Column, parameter: int = 4, gradient: int = 4, optimizer: int = 8, activation: float = 4.0) -> dict[str, Column]:
    act = F.floor(F.floor(context.cast("double") * hidden * layers * activation) * parameter).cast("bigint")
    return {"weights": total * parameter, "gradients": total * gradient, "optimizer_states": total * optimizer, "activation_reserve": act, "total_estimate": total * (parameter + gradient + optimizer) + act}


def cosine_rate(step: Column, warmup: int, total: int, least: float = 0.1) -> Column:
    """The factor on the learning rate: a linear warm-up, then half a cosine down to `least`."""
    if not 0 <= warmup < total or not 0.0 <= least <= 1.0:
        raise ValueError("need 0 <= warmup < total and least in [0, 1]")
    progress = F.least((step - warmup) / float(max(1, total - warmup)), F.lit(1.0))
    return F.when(step < warmup, (step + 1) / float(max(1, warmup))).otherwise(F.lit(least) + (1.0 - least) * 0.5 * (F.lit(1.0) + F.cos(F.lit(math.pi) * progress)))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(80.0)))

"""Mixtures of sources at target shares: token counts, copies per source, and dependent rounding to whole copies.

A source whose target is 2.3 times its size gets two copies of every document and a third of 30 % of them. Which
documents those are is settled by pivotal rounding: two fractional documents are paired, and one takes mass from the
other until it is 0 or 1. Pairs are made inside each partition, between documents of near size, and the one document
per partition and source that stays fractional moves up a reduction tree. The random draws are hashes of document
ids, so a task that runs twice decides alike.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.session import small, stored

#: Fixed value: how the public byte-level tokenizers cut text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
_ENCODERS: dict = {}


def _encoder(key: str, shared):
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        _ENCODERS.clear()
        _ENCODERS[key] = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


_RUN = re.compile(r"\s{1000,}")


def _size(encoder, text: str) -> int:
    """Tokens of a text. Very long runs of blanks overflow the tokenizer's stack: those texts are cut around the runs, where it cuts them as well."""
    try:
        return len(encoder.encode_ordinary(text))
    except (KeyboardInterrupt, SystemExit):
        raise
    except BaseException:  # the panic of the native code is no Exception
        total, at = 0, 0
        for m in _RUN.finditer(text):
            last = m.end() == len(text)
            run = m[0] if last else m[0][:-1]  # the last blank goes with what follows
            total += len(encoder.encode_ordinary(text[at : m.start()])) + len(encoder._encode_single_piece(run))
            at = m.end() if last else m.end() - 1
        if not at:
            raise
        return total + len(encoder.encode_ordinary(text[at:]))


def count_tokens(documents: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """The `keep` columns and `tokens`, the size of each non-null text. The vocabulary file is read once, on the driver."""
    with open(tokenizer, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())  # a fixed file of under 2 MB
    df = documents.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, shared)
        for b in batches:
            n = pa.array([_size(encoder, t.as_py()) for t in b.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]) + ", tokens bigint"
    return df.mapInArrow(count, schema)


def plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its tokens, the target in tokens, copies per document (expected), and whether max_repeats lets it reach the target.

    `targets` has one row per source (source, target_share, max_repeats); of repeated rows one is used. A listed source without documents has
    0 tokens and can't reach a positive target. Sources that no target names take part in the total alone.
    """
    have = counts.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("documents"))
    total = have.agg(F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("all_tokens"))
    t = targets.where(F.col("source").isNotNull()).groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    most = F.col("max_repeats") * F.col("source_tokens")
    return (
        t.join(have, "source", "left").na.fill(0, ["source_tokens", "documents"]).join(F.broadcast(total))  # total is one row
        .withColumn("target_tokens", F.col("target_share") * F.col("all_tokens"))
        .withColumn("reachable", F.col("target_tokens") <= most)
        .withColumn("expected_copies", F.when(F.col("source_tokens") > 0, F.least(F.col("target_tokens") / F.col("source_tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)))
    )


def _draw(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers from two ids and a seed."""
    with np.errstate(over="ignore"):
        h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) + np.uint64(seed)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def pivot(p: np.ndarray, key: np.ndarray, seed: int) -> np.ndarray:
    """Rounds probabilities until at most one is fractional; sums are kept, each stays what it was in expectation.

    Neighbours are paired level by level, as in a tournament: half of the fractional ones are settled on each level.
    """
    p = p.astype(np.float64).copy()
    open_ = np.flatnonzero((p > 1e-12) & (p < 1 - 1e-12))
    level = 0
    while len(open_) > 1:
        even = len(open_) // 2 * 2
        a, b, odd = open_[:even:2], open_[1:even:2], open_[even:]
        u, s = _draw(key[a], key[b], seed + level), p[a] + p[b]
        low = s < 1
        first = np.where(low, u * s < p[a], u * (2 - s) < 1 - p[b])  # the one that ends with the larger part
        big, rest = np.minimum(s, 1.0), np.maximum(s - 1.0, 0.0)
        p[a], p[b] = np.where(first, big, rest), np.where(first, rest, big)
        left = np.where(low == first, a, b)
        open_ = np.sort(np.concatenate([left, odd]))
        open_ = open_[(p[open_] > 1e-12) & (p[open_] < 1 - 1e-12)]
        level += 1
    return p


_UNIT = "doc_id bigint, source string, tokens bigint, whole bigint, p double"


def _meeting(seed: int, last: bool):
    """Rounds the fractional documents that met in one node of the reduction tree; in the last, what stays fractional is drawn."""

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("doc_id")
        key = g["doc_id"].to_numpy()
        p = pivot(g["p"].to_numpy(), key, seed + 1000)
        if last:
            open_ = (p > 1e-12) & (p < 1 - 1e-12)
            p = np.where(open_, (_draw(key, key, seed + 2000) < p).astype(float), p)
        return g.assign(p=p)[["doc_id", "source", "tokens", "whole", "p"]]

    return meet


def mixture(counts: DataFrame, plans: DataFrame, *, seed: int = 17, fan_in: int = 512) -> DataFrame:
    """(doc_id, source, tokens, copies) of every counted document whose source has a target; copies may be 0.

    `counts` has (doc_id, source, tokens) with unique ids. Copies never exceed max_repeats.
    """
    names = {"expected_copies": "_e", "max_repeats": "_m"}
    units = counts.join(small(plans.select("source", *[F.col(a).alias(b) for a, b in names.items()])), "source").select(
        "doc_id", "source", "tokens", F.floor("_e").alias("whole"), (F.col("_e") - F.floor("_e")).alias("p")
    )

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, pd.DataFrame] = {}
        for b in batches:
            done = []
            for source, g in b.groupby("source", sort=True):
                g = g.sort_values(["tokens", "doc_id"])
                if source in held:
                    g = pd.concat([held.pop(source), g])
                g["p"] = pivot(g["p"].to_numpy(), g["doc_id"].to_numpy(), seed)
                open_ = (g["p"] > 1e-12) & (g["p"] < 1 - 1e-12)
                if open_.any():
                    held[source] = g[open_]
                done.append(g[~open_])
            if done:
                yield pd.concat(done)
        if held:
            yield pd.concat(held.values())

    state = stored(units.mapInPandas(within, _UNIT), "mixture")
    settled = (F.col("p") <= 1e-12) | (F.col("p") >= 1 - 1e-12)
    out, rest = state.where(settled), state.where(~settled)
    while True:
        most = rest.groupBy("source").count().agg(F.max("count")).first()[0] or 0  # one number
        last = most <= fan_in

        buckets = max(1, -(-most // fan_in))
        up = rest.withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).groupBy("source", "_b").applyInPandas(_meeting(seed, last), _UNIT)
        if last:
            out = out.unionByName(up)
            break
        up = stored(up, "mixture")
        out, rest = out.unionByName(up.where(settled)), up.where(~settled)
    return out.select("doc_id", "source", "tokens", (F.col("whole") + F.round("p")).cast("bigint").alias("copies"))


def report(mixed: DataFrame, plans: DataFrame) -> DataFrame:
    """Per source the target and the share reached, the copies made, and whether the mixture falls short of the target though each document of the source is used max_repeats times."""
    got = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"), F.sum("copies").alias("mixed_documents"), F.max("copies").alias("most_copies"), F.min("copies").alias("fewest_copies"))
    full = plans.join(got, "source", "left").withColumn("fewest_copies", F.coalesce("fewest_copies", "max_repeats")).na.fill(0, ["mixed_tokens", "mixed_documents", "most_copies"])
    total = got.agg(F.sum("mixed_tokens").alias("_all"))
    short = (F.col("fewest_copies") >= F.col("max_repeats")) & (F.col("mixed_tokens") < F.col("target_tokens"))
    return full.join(F.broadcast(total)).withColumns({"short": short, "actual_share": F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), F.col("_all")), F.lit(0.0))}).drop("_all")

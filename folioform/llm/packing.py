"""Filling fixed-capacity containers: mixture-controlled packing by deficit round-robin.

Every source is a queue in a fixed pseudo-random order. A round gives each queue its quantum of tokens; an item leaves in
the first round whose accumulated quanta cover it, so what a queue could not use is carried into the next round, across
windows and across partitions alike. With running token sums E that round is ceil(E / quantum), which is computed from
sums per (source, shard) and running sums within a shard: no queue is ever held by one task. The items of a round (a
window of CONTAINERS containers) are packed by best fit, longest first.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from folioform.session import materialize

CAPACITY = 2048
#: Containers a window holds; a window's tokens are packed in one task.
CONTAINERS = 256
#: Documents whose running sums one task makes.
SHARD_DOCS = 50_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern of the vocabulary file above (a fixed value of the public byte-level BPE).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PACKED = "doc_id bigint, part int, source string, container_id bigint, start_token int, n_tokens int"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text under the public tokenizer at ``path``; 0 for null and empty texts. Whole texts are encoded."""

    @pandas_udf(IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(path)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int32")

    return count(text)


def best_fit(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(container, offset) of every item: longest first, each into the fullest container that still takes it; ties by position."""
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    room: list[tuple[int, int]] = []  # (free, container), ascending
    made = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, c = room.pop(at)
        else:
            free, c = capacity, made
            made += 1
        out[i] = (c, capacity - free)
        insort(room, (free - sizes[i], c))
    return out


def sized_items(df: DataFrame, doc_id: str, text: str, source: str, path: str = TOKENIZER) -> DataFrame:
    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), token_count(F.col(text), path).alias("tokens"))


def rounds(items: DataFrame, capacity: int, containers: int, targets: dict[str, float] | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``items`` (doc_id, source, tokens) with the deficit round-robin round ``win`` each leaves in.

    Without ``targets`` every queue's share is its share of all tokens, and all queues end together. ``targets`` {source:
    weight} sets shares of the sources named (others share as they are); a queue that ends early leaves its share to the rest.
    """
    n = items.count()
    shards = max(1, -(-n // shard_docs))
    placed = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)))
    w = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("local_end", F.sum("tokens").over(w))
    sums = placed.groupBy("source", "shard").agg(F.sum("tokens").alias("t"))
    before = F.sum("t").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source", "shard", F.coalesce(before, F.lit(0)).alias("before"), F.sum("t").over(Window.partitionBy("source")).alias("queue"))
    total = items.agg(F.sum("tokens")).first()[0] or 0
    ended = local.join(sums, ["source", "shard"]).withColumn("end", F.col("before") + F.col("local_end"))
    size = capacity * containers
    last = max(1, -(-int(total) // size))

    def window(served: Column) -> Column:
        """Items of no tokens fit anywhere: they are spread over the windows, so that a queue of none but them is not one task's."""
        spread = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(max(last, -(-n // shard_docs))))
        return F.when(F.col("tokens") == 0, spread).otherwise(F.floor(F.greatest(served - 0.5, F.lit(0.0)) / size)).cast("bigint").alias("win")

    if not targets:
        return ended.select("doc_id", "source", "tokens", window(F.col("end") * F.lit(float(total)) / F.greatest(F.col("queue"), F.lit(1))))
    # weighted: virtual time of an item is end / weight; tokens served by then are summed over the named queues and the rest
    named = {r.source: float(r.t) for r in items.where(F.col("source").isin(list(targets))).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # at most len(targets) rows
    rest = total - sum(named.values())
    share = sum(targets[s] for s in named)
    queues = [(named[s], targets[s]) for s in named] + ([(rest, max(1e-9, 1 - share))] if rest else [])
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for s in named for x in (s, float(targets[s]))]), F.col("source")) if named else F.lit(None), F.lit(max(1e-9, 1 - share)) * F.col("queue") / F.lit(max(1.0, rest)))
    served = sum((F.least(F.lit(v) * F.col("virtual"), F.lit(t)) for t, v in queues), F.lit(0.0))
    return ended.withColumn("virtual", F.col("end") / weight).select("doc_id", "source", "tokens", window(served))


def pack(df: DataFrame, doc_id: str, text: str, source: str, capacity: int = CAPACITY, containers: int = CONTAINERS, targets: dict[str, float] | None = None, path: str = TOKENIZER) -> DataFrame:
    """One row per document (schema PACKED): its container and where it starts there.

    A document longer than ``capacity`` is cut into parts: full containers of its own, and a remainder packed like any
    item; every other document is one part. Null and empty texts are items of no tokens; a null source is the source ''.
    Repeated rows are packed as often as they occur. An empty table gives no containers.
    """
    items = materialize(sized_items(df, doc_id, text, source, path), "pack-sizes")
    windows = rounds(items, capacity, containers, targets)

    def fill(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        win = int(key[0])
        x = x.sort_values(["doc_id", "tokens"], kind="stable")
        rows, sizes, full = [], [], 0
        for d, s, t in zip(x.doc_id, x.source, x.tokens):
            whole, last = (0, t) if t <= capacity else divmod(t, capacity)
            for k in range(whole):
                rows.append((d, k, s, win * (1 << 20) + full, 0, capacity))
                full += 1
            if last or not whole:
                sizes.append((d, whole, s, last))
        for (d, k, s, t), (c, at) in zip(sizes, best_fit([r[3] for r in sizes], capacity)):
            rows.append((d, k, s, win * (1 << 20) + full + c, at, t))
        return pd.DataFrame(rows, columns=["doc_id", "part", "source", "container_id", "start_token", "n_tokens"])

    return windows.groupBy("win").applyInPandas(fill, PACKED)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, fill): how many containers there are and what share of them is used."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    return per.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.round(F.sum("t") / (F.count("*") * capacity), 4).alias("fill"))


def conservation(packed: DataFrame, items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, copies, whole, fits, tokens_kept) of every document packed: whether it came out as often as it went in, in one part
    unless it alone exceeds the capacity, in containers that hold no more than they can, and with all its tokens."""
    load = packed.groupBy("container_id").agg((F.sum("n_tokens") <= capacity).alias("ok"))
    per = packed.join(load, "container_id").groupBy("doc_id").agg(F.count(F.when(F.col("part") == 0, 1)).alias("copies"), F.count("*").alias("parts"), F.sum("n_tokens").alias("kept"), F.bool_and("ok").alias("fits"))
    sizes = items.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity))).alias("least"))
    return per.join(sizes, "doc_id", "full_outer").select("doc_id", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce(F.col("parts") == F.col("least"), F.lit(False)).alias("whole"), F.coalesce("fits", F.lit(False)).alias("fits"), F.coalesce(F.col("kept") == F.col("tokens"), F.lit(False)).alias("tokens_kept"))


def share_errors(packed: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(win, source, share, target, error): the share each source named has of each window, against its target, until the first
    named source ends: from then on its share goes to the others. The last window served is left out, for it may be cut short."""
    mixed = mixture_report(packed).where("tokens > 0")
    wins = mixed.groupBy("win").agg(F.sum("tokens").alias("all"))
    table = F.create_map(*[F.lit(x) for s, t in targets.items() for x in (s, float(t))])
    named = mixed.where(F.col("source").isin(list(targets)))
    ends = named.groupBy("source").agg(F.max("win").alias("end")).agg(F.min("end").alias("stop"))
    stop = ends.first()[0]
    grid = wins.where(F.col("win") < F.lit(-1 if stop is None else stop)).select("win", "all", F.explode(F.array(*map(F.lit, targets))).alias("source"))
    out = grid.join(named.select("win", "source", "tokens"), ["win", "source"], "left").withColumn("share", F.round(F.coalesce("tokens", F.lit(0)) / F.col("all"), 6))
    return out.select("win", "source", "share", table[F.col("source")].alias("target"), F.round(F.abs(F.col("share") - table[F.col("source")]), 6).alias("error"))


def mixture_report(packed: DataFrame) -> DataFrame:
    """(win, source, tokens, share): the mixture of every window."""
    per = packed.groupBy((F.shiftright("container_id", 20)).alias("win"), "source").agg(F.sum("n_tokens").alias("tokens"))
    return per.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy("win")), 6))



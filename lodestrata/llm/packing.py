"""Filling fixed-capacity containers with documents (problem 6).

Vector bin packing: an item has a size in tokens, in segments and in
loss-bearing tokens, and a container has a limit for each. A document above the
capacity is cut into full containers and a rest; all others stay whole. The
dot-product heuristic fills one container at a time: of the items that fit all
remaining limits it takes the one whose size vector has the largest dot product
with the vector of what is left, each dimension measured by its limit. The limit
on loss-bearing tokens keeps containers from filling up with answers alone: texts
with long prompts are spread over them.

Documents are dealt by hash into blocks of a bounded number of items, each
packed in one task; a block leaves at most its last containers part empty. Full
containers never take part in the shuffle. Items of equal size are
interchangeable, so a block keeps one stack per size, and a step costs one
numpy pass over the sizes that fit.

Defined results:

- null or empty text: an item of 0 tokens and one segment. null doc_id: kept as null.
- Repeated rows are items of their own. Repeated budget names: the largest capacity. Capacity null or below 1: no containers.
- A text is cut only where it exceeds the capacity in tokens. An item that alone bears more loss than a container may is a
  container's first item, and only items without loss join it.
- Container ids are unique within a budget and the same in every run over the same input files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, small
from lodestrata.llm.tokens import TOKENIZER, sizes

#: Items packed together in one task; a documented bound on what a task holds.
BLOCK_ITEMS = 20_000
#: Documents (or parts of one) a container holds at most.
MAX_SEGMENTS = 64
#: Of a container's tokens, the share that may bear loss when it holds several items.
LOSS_SHARE = 0.95

PACKED = "budget_name string, capacity_tokens int, container string, doc_id long, first_token long, n_tokens long, loss_tokens long, whole boolean"


def pack_block(tokens: np.ndarray, loss: np.ndarray, capacity: int, max_segments: int, max_loss: int) -> np.ndarray:
    """The container number of each item. No item may exceed the capacity; one above the loss limit begins a container."""
    order = np.lexsort((loss, tokens))
    t, b = tokens[order], loss[order]
    new = np.empty(len(t), bool)
    new[:1] = True
    new[1:] = (t[1:] != t[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    size_t, size_b = t[first].astype(np.int64), b[first].astype(np.int64)  # sizes, by tokens and then loss
    left = np.diff(np.append(first, len(t)))  # items left of each size
    taken = np.zeros(len(first), np.int64)
    bins = np.empty(len(t), np.int64)
    share_t, share_b, share_s = size_t / capacity, size_b / max(max_loss, 1), 1 / max_segments
    alive = np.arange(len(first))
    container, remaining = 0, len(t)
    while remaining:
        room_t, room_b, room_s = capacity, max_loss, max_segments
        while room_s and remaining:
            upto = np.searchsorted(size_t[alive], room_t, "right")  # sizes that fit in tokens
            if not upto:
                break
            some = alive[:upto]
            score = share_t[some] * (room_t / capacity) + share_b[some] * (room_b / max(max_loss, 1)) + share_s * (room_s / max_segments)
            score[(size_b[some] > room_b) & ((room_s < max_segments) | (size_b[some] <= max_loss))] = -1
            k = int(np.argmax(score))
            if score[k] < 0:
                break
            at = some[k]
            bins[first[at] + taken[at]] = container
            taken[at] += 1
            remaining -= 1
            room_t, room_b, room_s = room_t - size_t[at], max(room_b - size_b[at], 0), room_s - 1
            if taken[at] == left[at]:
                alive = np.delete(alive, k)
        container += 1
    out = np.empty(len(t), np.int64)
    out[order] = bins
    return out


def items(sized: DataFrame, budgets: DataFrame, loss_share: float = LOSS_SHARE) -> DataFrame:
    """Every document for every budget, cut where it exceeds the capacity: with first_token, n_tokens, loss_tokens, full and whole."""
    limits = budgets.where("capacity_tokens >= 1").groupBy("budget_name").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    limits = limits.withColumn("max_loss", F.greatest(F.floor(F.col("capacity_tokens") * loss_share), F.lit(1)))
    rows = sized.crossJoin(small(limits))  # each document is meant to meet each budget
    prompt = F.col("n_tokens") - F.col("loss_tokens")
    step = F.col("capacity_tokens")
    parts = F.greatest(F.ceil(F.col("n_tokens") / step), F.lit(1)).cast("int")
    rows = rows.withColumn("prompt", prompt).withColumn("step", step).withColumn("parts", parts)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    start = F.col("part").cast("long") * F.col("step")
    stop = F.least(start + F.col("step"), F.col("n_tokens"))
    asked = F.greatest(F.least(stop, F.col("prompt")) - F.least(start, F.col("prompt")), F.lit(0))
    return rows.select(
        "budget_name", "capacity_tokens", "max_loss", "doc_id", "row", "part", start.alias("first_token"),
        (stop - start).alias("n_tokens"), (stop - start - asked).alias("loss_tokens"), (F.col("parts") == 1).alias("whole"),
        (stop - start == F.col("capacity_tokens")).alias("full"),
    )


def pack(documents: DataFrame, budgets: DataFrame, tokenizer: str = TOKENIZER, max_segments: int = MAX_SEGMENTS, loss_share: float = LOSS_SHARE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Which container each document, or part of one, lies in for each budget; columns as in :data:`PACKED`."""
    sized = cut(sizes(documents, tokenizer).select("doc_id", "n_tokens", "loss_tokens", F.monotonically_increasing_id().alias("row")))
    every = items(sized, budgets, loss_share)
    # as many blocks as the budget with the most items to place needs; one number is read
    most = every.where("not full").groupBy("budget_name").count().agg(F.max("count")).first()[0] or 0
    n_blocks = max(1, -(-most // block_items))
    schema = [x.split()[0] for x in PACKED.split(", ")]

    def pack_rows(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "part"], ignore_index=True)
        capacity, most = int(rows.capacity_tokens.iloc[0]), int(rows.max_loss.iloc[0])
        bins = pack_block(rows.n_tokens.to_numpy(), rows.loss_tokens.to_numpy(), capacity, max_segments, most)
        block = rows.block.iloc[0]
        return rows.assign(container=[f"{block}-{k}" for k in bins])[schema]

    alone = every.where("full").withColumn("container", F.concat_ws("-", F.lit("d"), "row", "part")).select(*schema)
    block = F.pmod(F.xxhash64("row", "part"), F.lit(n_blocks)).cast("int")
    shared = every.where("not full").withColumn("block", block).groupBy("budget_name", "block").applyInPandas(pack_rows, PACKED)
    return alone.unionByName(shared)


def fill(packed: DataFrame, max_segments: int = MAX_SEGMENTS, loss_share: float = LOSS_SHARE) -> DataFrame:
    """(budget_name, capacity_tokens, containers, segments, tokens, fill, segment_fill, loss_fill, at_loss_limit).

    How full the containers of each budget are: in tokens, in segments and in loss-bearing tokens, and the share of
    containers that have used up at least 99 hundredths of what they may bear in loss.
    """
    by = packed.groupBy("budget_name", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss"))
    most = F.greatest(F.floor(F.col("capacity_tokens") * loss_share), F.lit(1))
    by = by.groupBy("budget_name", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("segments").alias("segments"), F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"), F.avg((F.col("loss") >= 0.99 * most).cast("int")).alias("at_loss_limit")
    )
    of = lambda used, limit: F.col(used) / (F.col("containers") * limit)
    return by.select(
        "budget_name", "capacity_tokens", "containers", "segments", "tokens", of("tokens", F.col("capacity_tokens")).alias("fill"),
        of("segments", F.lit(max_segments)).alias("segment_fill"), of("loss", most).alias("loss_fill"), "at_loss_limit",
    )

"""Items of varying length in containers of fixed capacity: best-two-fit.

A container is filled greedily with the largest items that fit; then its
smallest item is exchanged for two unpacked ones that fill the widened gap more
tightly, as long as that helps. Items are dealt at random into packing groups of
bounded size, each packed by one task, so the tasks neither grow nor get skewed
with the data; a group leaves at most its last containers part empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
GROUP_ITEMS = 20_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How the tokenizer's vocabulary wants text cut into words before merging; used where its package does not say. A fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_count(text: Column, vocabulary: str = TOKENIZER) -> Column:
    """Tokens of a text under a public tokenizer; vocabulary is a path that every executor can read. Null gives null, an empty text 0."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([None if t is None else len(coder.encode_ordinary(t)) for t in texts], index=texts.index, dtype="Int64")

    return count(text)


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place) of items with 1 <= size <= capacity. Works on counts per size, so time goes with bins x capacity."""
    n = len(sizes)
    order = np.argsort(sizes, kind="stable")
    first = np.searchsorted(sizes[order], np.arange(capacity + 2))
    left = np.diff(first)  # unpacked items of each size
    bins, places = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    packed, number = 0, 0
    span = np.arange(capacity + 1)

    def available(free: np.ndarray) -> np.ndarray:
        """For every size the largest size up to it that is unpacked, 0 if none."""
        return np.maximum.accumulate(np.where(free > 0, span, 0))

    while packed < n:
        down = available(left)
        content: list[int] = []
        gap = capacity
        while gap > 0 and (s := int(down[gap])) > 0:
            content.append(s)
            left[s] -= 1
            if not left[s]:
                down = available(left)
            gap -= s
        while gap > 0 and content:
            smallest = content[-1]  # filled from large to small, and kept sorted
            room = gap + smallest
            a = span[1 : room // 2 + 1]
            a = a[left[a] > 0]
            if not len(a):
                break
            b = down[room - a]
            fits = (b > a) | ((b == a) & (left[a] > 1))
            total = np.where(fits, a + b, 0)
            k = int(total.argmax()) if len(total) else 0
            if total[k] <= smallest:
                break
            x, y = int(a[k]), int(b[k])
            content[-1:] = [y, x]
            content.sort(reverse=True)
            left[smallest] += 1
            left[x] -= 1
            left[y] -= 1
            down = available(left)
            gap = capacity - sum(content)
        for place, s in enumerate(content):
            item = order[first[s]]  # items of one size are handed out in order
            first[s] += 1
            bins[item], places[item] = number, place
        packed += len(content)
        number += 1
    return bins, places


def pack_items(items: DataFrame, item_id: str, size: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(item, part, size, container, place, offset): container and place of every item.

    An item above the capacity is cut into full parts, which fill a container
    each, and a rest; part counts from 1. Items of size 0 or null take no room
    and come out without container. Containers are named group-number; place
    counts from 1 and offset is where the part begins in its container. Repeated
    rows are packed as often as they occur. An empty table gives no rows.
    """
    rows = items.select(F.col(f"`{item_id}`").alias("item"), F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)).alias("whole"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("whole") / capacity)).cast("int")
    cut = rows.select("item", "whole", F.explode(F.sequence(F.lit(1), parts)).alias("part"))
    cut = cut.withColumn("size", F.least(F.lit(capacity), F.col("whole") - (F.col("part") - 1) * capacity).cast("bigint")).drop("whole")
    full = cut.filter(F.col("size") == capacity).select(
        "item", "part", "size", F.concat(F.lit("full-"), F.col("item").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("container"), F.lit(1).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("offset")
    )
    none = cut.filter("size <= 0").select("item", "part", "size", F.lit(None).cast("string").alias("container"), F.lit(None).cast("bigint").alias("place"), F.lit(None).cast("bigint").alias("offset"))
    groups = max(1, -(-items.count() // group_items))
    loose = cut.filter((F.col("size") > 0) & (F.col("size") < capacity)).withColumn("group", F.pmod(F.xxhash64("item", F.lit(11)), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "part"], kind="stable").reset_index(drop=True)
        bins, places = pack(pdf["size"].to_numpy(), capacity)
        out = pdf[["item", "part", "size"]].copy()
        out["container"] = [f"{g}-{b}" for g, b in zip(pdf["group"], bins)]
        out["place"] = places + 1
        by = np.lexsort((places, bins))
        sizes = out["size"].to_numpy()[by]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        fresh = np.r_[True, np.diff(bins[by]) > 0] if len(by) else np.zeros(0, bool)
        offset = np.empty(len(by), np.int64)
        offset[by] = starts - np.maximum.accumulate(np.where(fresh, starts, 0))
        out["offset"] = offset
        return out

    kind = dict(cut.dtypes)["item"]
    fitted = loose.groupBy("group").applyInPandas(one, f"item {kind}, part int, size bigint, container string, place bigint, offset bigint")
    return full.unionByName(none).unionByName(fitted)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens and the share of room used."""
    per = packed.filter("container is not null").groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("items"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("items").alias("parts"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count("*") * capacity)).alias("share_used")
    )

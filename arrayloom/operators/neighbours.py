"""Nearest repeats by positional identity: a stated set of queries against all rows, in blocks.

Equal rows are compared once. A block of references and a block of queries are
one matrix product of one-hot coded bases; every pair of blocks keeps the best
and the votes of each query, and these are merged by aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.runtime import written

BLOCK = 40_000
CODES = "ACGTN"
AT_ONCE = 1 << 22  # so many pairs of texts are held at a time
MOST_TASKS = 1_000


def _chars(texts: pd.Series, width: int) -> np.ndarray:
    """The first letters of texts (rows x width), blanks behind shorter ones."""
    cut = texts.str.slice(0, width).str.pad(width, side="right", fillchar=" ").str.encode("ascii", "replace")
    return np.frombuffer(b"".join(cut.tolist()), np.uint8).reshape(len(texts), width)


def _coded(chars: np.ndarray, letters: list[int]) -> np.ndarray:
    """One-hot bases, place by place (rows x width * letters). Other letters are like nothing."""
    return (chars[:, :, None] == np.array(letters, np.uint8)).reshape(len(chars), -1).astype(np.float32)


def _blocked(rows: DataFrame, keys: list[str], block: int, name: str) -> tuple[DataFrame, int]:
    """rows with a block number, and how many blocks there are; equal keys, which are compared once, share a block."""
    blocks = max(1, -(-rows.count() // block))
    return rows.withColumn(name, F.pmod(F.xxhash64(*keys), F.lit(blocks))), blocks


def _compare(ref: pd.DataFrame, ask: pd.DataFrame, close: float) -> pd.DataFrame:
    """Best, second and votes of each query class of one block against the reference classes of another."""
    columns = ["q_text", "q_key", "ref_id", "label", "best", "second", "votes"]
    if not len(ref) or not len(ask):
        return pd.DataFrame(columns=columns)
    ref, ask = ref.sort_values("ref_id").reset_index(drop=True), ask.reset_index(drop=True)
    many, n, m = ref["n"].to_numpy(), ref["text"].str.len().to_numpy(), ask["q_text"].str.len().to_numpy()
    labels, no = np.unique(ref["label"].fillna("").to_numpy(str), return_inverse=True)
    # the few references that have the key of a query
    keyed = ref.index[ref["array_key"].isin(ask["q_key"])]
    own = pd.Series(keyed).groupby(ref["array_key"].to_numpy(object)[keyed]).apply(np.array).to_dict()
    width = int(min(n.max(), m.max()))
    chars = _chars(ref["text"], width)
    letters = [ord(c) for c in CODES if (chars == ord(c)).any()]
    x, few = _coded(chars, letters), max(16, AT_ONCE // len(ref))
    order, best, second, some = np.zeros(len(ask), np.int64), np.zeros(len(ask), np.float32), np.zeros(len(ask), np.float32), [{}] * len(ask)
    # queries of one length are compared in as many places as they have
    for size in np.unique(m):
        alike = np.flatnonzero(m == size)
        places = min(int(size), width)
        over, bases = np.maximum(size, n).astype(np.float32), x[:, : places * len(letters)].T
        for at in range(0, len(alike), few):
            mine = alike[at : at + few]
            row = np.arange(len(mine))
            like = _coded(_chars(ask["q_text"].iloc[mine], places), letters) @ bases
            like /= over
            for i, key in enumerate(ask["q_key"].iloc[mine]):
                if key in own:
                    like[i, own[key]] = -1.0
            top = np.argmax(like, axis=1)
            order[mine], best[mine] = top, like[row, top]
            near = np.flatnonzero(best[mine] >= close - 1e-7)
            if len(near):
                i, j = np.nonzero(like[near] >= close - 1e-7)
                votes = np.bincount(i * len(labels) + no[j], weights=many[j], minlength=len(near) * len(labels)).reshape(len(near), -1)
                for i, v in zip(mine[near], votes):
                    some[i] = {str(labels[j]): int(v[j]) for j in np.flatnonzero(v)}
            like[row, top] = -1.0
            # a class of several rows is its own second
            second[mine] = np.where(many[top] > 1, best[mine], like.max(axis=1))
    return pd.DataFrame({"q_text": ask["q_text"], "q_key": ask["q_key"], "ref_id": ref["ref_id"].to_numpy()[order], "label": ref["label"].to_numpy(object)[order], "best": best.astype(float), "second": second.astype(float), "votes": some})


def nearest_classes(asks: DataFrame, refs: DataFrame, close: float, block: int) -> DataFrame:
    """(q_text, q_key, ref_id, label, best, second, votes) per query class and reference block.

    Equal rows are one class each: queries by text and key, references by text,
    label and key with their number and least id. Both sides are cut into
    blocks of about so many classes, and every pair of blocks is one group, so
    that no task holds more than one block of either side. The result is
    written, as it is read for the nearest and for the votes.
    """
    questions = written(asks.select(F.col("text").alias("q_text"), F.coalesce("array_key", F.lit("")).alias("q_key")).distinct(), "questions")
    answers = written(refs.groupBy("text", "label", F.coalesce("array_key", F.lit("")).alias("array_key")).agg(F.count("*").alias("n"), F.min("ref_id").alias("ref_id")), "answers")
    left, q_blocks = _blocked(questions, ["q_text", "q_key"], block, "q_block")
    right, r_blocks = _blocked(answers, ["text", "label", "array_key"], block, "r_block")
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    copies = left.withColumn("r_block", number(r_blocks))
    parts = right.withColumn("q_block", number(q_blocks))
    # a pair of blocks is few bytes and much work: tasks are not put together by bytes
    tasks = min(MOST_TASKS, 4 * q_blocks * r_blocks)
    dealt = lambda df: df.repartition(tasks, "q_block", "r_block").groupBy("q_block", "r_block")
    pairs = dealt(parts).cogroup(dealt(copies))
    return written(pairs.applyInPandas(lambda r, q: _compare(r, q, close), "q_text string, q_key string, ref_id bigint, label string, best double, second double, votes map<string,bigint>"), "classes")


def predicted_subtypes(arrays: DataFrame, training: DataFrame, text: str = "repeat_consensus", block: int = BLOCK) -> DataFrame:
    """(array_id, cas_subtype, confidence): subtype of the nearest labelled repeat, its identity as confidence.

    training: ref_id, text, label. Of equally near repeats the one with the
    least ref_id decides. Repeats that training holds letter by letter need no
    comparison; only the others meet all references, each once however many
    arrays have it. Arrays without repeat come out with null.
    """
    known = training.filter("text <> '' and label <> ''").select("ref_id", F.upper("text").alias("text"), "label")
    asked = arrays.select("array_id", F.upper(F.col(f"`{text}`")).alias("text"))
    exact = known.groupBy("text").agg(F.min_by("label", "ref_id").alias("label"))
    repeats = asked.filter("text <> ''").select("text").distinct()
    other = repeats.join(exact, "text", "left_anti").withColumn("array_key", F.lit(""))
    found = nearest_classes(other, known.withColumn("array_key", F.lit("-")), 2.0, block)
    near = found.filter("best >= 0").groupBy(F.col("q_text").alias("text")).agg(F.min_by(F.struct("label", "best"), F.struct((-F.rint(F.col("best") * 1e6)).alias("minus"), "ref_id")).alias("x"))
    said = repeats.join(exact, "text").select("text", "label", F.lit(1.0).alias("best")).unionByName(near.select("text", "x.label", "x.best"))
    return asked.join(said, "text", "left").select("array_id", F.col("label").alias("cas_subtype"), (F.rint(F.col("best") * 1e6) / 1e6).alias("confidence"))


def neighbour_features(queries: DataFrame, references: DataFrame, close: float = 0.9, block: int = BLOCK) -> DataFrame:
    """Per query: nearest reference, two best identities, close ones, the share of their commonest label and the entropy of their labels.

    queries: row_id, text, array_key; references: ref_id, text, label, array_key.
    A reference with the query's key is the query itself and doesn't count. Of
    equally near references the one with the smallest ref_id is the nearest.
    Null and empty texts take no part.
    """
    refs = references.filter("text is not null and text <> ''").select("ref_id", "text", "label", "array_key")
    asks = queries.filter("text is not null and text <> ''").select("row_id", "text", F.coalesce("array_key", F.lit("")).alias("array_key"))
    classes = nearest_classes(asks, refs, close, block)
    merged = _merged(classes)
    rows = asks.join(merged, (F.col("text") == F.col("q_text")) & (F.col("array_key") == F.col("q_key")), "left")
    return rows.dropDuplicates(["row_id"]).select("row_id", *[c for c in merged.columns if c not in ("q_text", "q_key")]).fillna(0, ["neighbor_close_count_90"]).fillna(
        0.0, ["neighbor_best_identity", "neighbor_second_identity", "neighbor_top_vote_fraction_90", "neighbor_subtype_entropy_90"]
    )


def _merged(found: DataFrame) -> DataFrame:
    """One row per query class from those of its blocks."""
    key = ["q_text", "q_key"]
    two = F.slice(F.sort_array(F.flatten(F.collect_list(F.array("best", "second"))), asc=False), 1, 2)
    near = found.filter("best >= 0").groupBy(*key).agg(F.min_by(F.struct("ref_id", "label"), F.struct((-F.rint(F.col("best") * 1e6)).alias("minus"), "ref_id")).alias("nearest"), two.alias("two"))
    votes = found.select(*key, F.explode("votes").alias("label", "n")).groupBy(*key, "label").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*key))
    share = votes.withColumn("p", F.col("n") / total).groupBy(*key).agg(F.sum("n").alias("close"), F.max("p").alias("top"), F.sum(-F.col("p") * F.log2("p")).alias("entropy"))
    six = lambda c: F.rint(c * 1e6) / 1e6
    best, second = F.col("two")[0], F.greatest(F.coalesce(F.get("two", F.lit(1)), F.lit(0.0)), F.lit(0.0))
    return near.join(share, key, "left").select(
        *key,
        F.col("nearest.ref_id").alias("nearest_ref_id"),
        F.col("nearest.label").alias("nearest_label"),
        F.coalesce(six(best), F.lit(0.0)).alias("neighbor_best_identity"),
        F.coalesce(six(second), F.lit(0.0)).alias("neighbor_second_identity"),
        F.coalesce("close", F.lit(0)).alias("neighbor_close_count_90"),
        F.coalesce(six(F.col("top")), F.lit(0.0)).alias("neighbor_top_vote_fraction_90"),
        F.coalesce(six(F.col("entropy")) + 0.0, F.lit(0.0)).alias("neighbor_subtype_entropy_90"),
    )

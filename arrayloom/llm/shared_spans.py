"""Long spans that appear verbatim in more than one record, by automata of recurring phrases.

1. Every text is fingerprinted: of the hashes of its PHRASE-character windows
   the least one in each stretch of least + 1 - PHRASE neighbours is kept, so
   two texts that share a span of the least length keep a common window of it.
2. Windows kept in two or more documents are the recurring phrases.
3. The phrases are compiled into sharded Aho-Corasick automata, and the texts of
   all documents that kept one of a shard's phrases are streamed through it;
   every occurrence comes out with what stands left and right of it.
4. Two occurrences of a phrase belong to a long enough span if the phrase and
   what they share to its left and right add up to the least length.

Shards have a bounded number of phrases and are dealt with their documents in
parts of bounded size, so no phrase, however common, gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from arrayloom.runtime import written

LEAST = 300
PHRASE = 150
SHARD_PHRASES = 8_000
PART_CHARS = 16_000_000
# Up to so many rows of ids (16 MB) a side is broadcast, beyond it the join shuffles.
FEW_IDS = 1_000_000
# Phrases with more different surroundings than this are joined on their surroundings instead of pairwise.
HOT = 300
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse among 64-bit numbers


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every width neighbours."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def kept_windows(text: str, phrase: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the windows kept of a text; none of a text shorter than least."""
    if len(text) < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points)
    with np.errstate(over="ignore"):
        power, inverse = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((points + np.uint64(1)) * power, out=sums[1:])
        h = (sums[phrase:] - sums[:-phrase]) * inverse[: n - phrase + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    width = least - phrase + 1
    low = _sliding(h, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, width, np.maximum) == h)
    return h[at].view(np.int64), at


def fingerprints(documents: DataFrame, phrase: int, least: int) -> DataFrame:
    """(print, doc_id, at): the kept windows, one per document and hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            prints, owners, places, held = [], [], [], 0
            for doc, text in zip(ids, texts):
                h, at = kept_windows(text.as_py() or "", phrase, least)
                h, first = np.unique(h, return_index=True)
                prints.append(h)
                owners.append(np.full(len(h), doc, np.int64))
                places.append(at[first].astype(np.int32))
                held += len(h)
                if held > 200_000:
                    yield _batch(prints, owners, places)
                    prints, owners, places, held = [], [], [], 0
            if held:
                yield _batch(prints, owners, places)

    return documents.select("doc_id", "text").mapInArrow(each, "print bigint, doc_id bigint, at int")


def _batch(prints: list, owners: list, places: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (prints, owners, places)], names=["print", "doc_id", "at"])


def _sent(ids: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(ids) if rows <= FEW_IDS else ids


def occurrences(documents: DataFrame, phrase: int = PHRASE, least: int = LEAST) -> DataFrame:
    """(print, phrase, doc_id, at, before, after): every occurrence of the recurring phrases.

    before and after are up to least - phrase + 1 characters next to it.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.length("text") >= least)
    prints = written(fingerprints(docs, phrase, least), "prints")
    recurring = prints.groupBy("print").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("last")).filter("home <> last").drop("last")
    recurring = written(recurring, "recurring")
    phrases_found = recurring.count()
    shards = max(1, -(-phrases_found // SHARD_PHRASES))
    shard = F.pmod(F.xxhash64("home"), F.lit(shards)).cast("int")
    # phrases of one document stay together, so that its partners go through few shards
    kept = written(prints.join(_sent(recurring, phrases_found), "print").select("print", "doc_id", "at", "home", shard.alias("shard")), "kept")
    stops = written(kept.select("doc_id", "shard").distinct(), "stops")
    # texts travel once to every shard that may hold a phrase of theirs
    texts = written(docs.join(_sent(stops, stops.count()), "doc_id"), "texts")
    heads = kept.filter("doc_id = home")
    phrases = heads.join(texts, ["doc_id", "shard"]).select("shard", "print", F.col("text").substr(F.col("at") + 1, F.lit(phrase)).alias("phrase"))
    parts = texts.groupBy("shard").agg(F.ceil(F.sum(F.length("text")) / PART_CHARS).cast("int").alias("parts"))
    dealt = texts.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("parts")).cast("int"))
    copied = phrases.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    beside = least - phrase + 1

    def locate(known: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for mark, words in zip(known["print"], known["phrase"]):
            automaton.add_word(words, (int(mark), words))
        rows = []
        if len(automaton):
            automaton.make_automaton()
            for doc, text in zip(pages["doc_id"], pages["text"]):
                for end, (mark, words) in automaton.iter(text):
                    at = end + 1 - len(words)
                    rows.append((mark, words, doc, at, text[max(0, at - beside) : at], text[end + 1 : end + 1 + beside]))
        return pd.DataFrame(rows, columns=["print", "phrase", "doc_id", "at", "before", "after"])

    schema = "print bigint, phrase string, doc_id bigint, at int, before string, after string"
    return copied.groupBy("shard", "part").cogroup(dealt.select("shard", "part", "doc_id", "text").groupBy("shard", "part")).applyInPandas(locate, schema)


@F.pandas_udf(IntegerType())
def _shared_end(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many characters two texts share at their ends."""
    return pd.Series([_common(x[::-1], y[::-1]) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(IntegerType())
def _shared_start(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_common(x, y) for x, y in zip(a, b)], dtype="int32")


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _places(documents: DataFrame, phrase: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(members, links): occurrences by place class, and the classes whose members share a span of the least length.

    A place class is a phrase with its surroundings. links: (a, b, left, right)
    where left and right are what two classes share beside the phrase, capped at
    the surroundings' length; a = b for a class with several documents.
    """
    found = written(occurrences(documents, phrase, least), "occurrences")
    place = ["print", "phrase", "before", "after"]
    # one number per class, unique as a document has one phrase at a position
    classes = found.groupBy(*place).agg(F.min(F.struct("doc_id", "at", "print")).alias("c"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"))
    classes = written(classes, "places")
    members = found.join(classes.drop("d0", "d1"), place).select("c", "doc_id", "at")
    need = least - phrase
    own = classes.filter((F.col("d0") < F.col("d1")) & (F.length("before") + F.length("after") >= need)).select(
        F.col("c").alias("a"), F.col("c").alias("b"), F.length("before").alias("left"), F.length("after").alias("right")
    )
    crowd = classes.groupBy("print").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    # the only document of a class, null if there are several: a span that a document repeats is not shared by that
    several = classes.join(crowd, "print").withColumn("only", F.when(F.col("d0") == F.col("d1"), F.col("d0")))
    elsewhere = "a < b and (oa is null or ob is null or oa <> ob)"
    few = several.filter(F.col("crowd") <= HOT)
    pairs = few.select("print", "phrase", F.col("c").alias("a"), F.col("only").alias("oa"), F.col("before").alias("ba"), F.col("after").alias("aa")).join(
        few.select("print", "phrase", F.col("c").alias("b"), F.col("only").alias("ob"), F.col("before").alias("bb"), F.col("after").alias("ab")), ["print", "phrase"]
    ).filter(elsewhere)
    # Any split of the missing length between left and right: equal on both sides for one split means the span is shared.
    many = several.filter(F.col("crowd") > HOT)
    splits = many.select("print", "phrase", "c", "only", "before", "after", F.explode(F.sequence(F.lit(0), F.lit(need))).alias("t")).filter(
        (F.length("before") >= F.col("t")) & (F.length("after") >= need - F.col("t"))
    )
    keyed = splits.withColumn("l", F.sha2(F.expr("right(before, t)"), 256)).withColumn("r", F.sha2(F.expr(f"left(after, {need} - t)"), 256))
    keyed = keyed.select("print", "t", "l", "r", "c", "only", "before", "after")
    hot = keyed.select("print", "t", "l", "r", F.col("c").alias("a"), F.col("only").alias("oa"), F.col("before").alias("ba"), F.col("after").alias("aa")).join(
        keyed.select("print", "t", "l", "r", F.col("c").alias("b"), F.col("only").alias("ob"), F.col("before").alias("bb"), F.col("after").alias("ab")), ["print", "t", "l", "r"]
    ).filter(elsewhere).dropDuplicates(["a", "b"])
    both = pairs.select("a", "b", "ba", "bb", "aa", "ab").unionByName(hot.select("a", "b", "ba", "bb", "aa", "ab"))
    measured = both.select("a", "b", _shared_end("ba", "bb").alias("left"), _shared_start("aa", "ab").alias("right")).filter(F.col("left") + F.col("right") >= need)
    return members, own.unionByName(measured)


def sharing_pairs(documents: DataFrame, phrase: int = PHRASE, least: int = LEAST) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: documents whose texts share a span of least characters.

    Null texts and texts shorter than least share nothing; a span repeated
    within one document only doesn't count; line breaks are characters. Rows
    repeated with one doc_id are one document.
    """
    members, links = _places(documents, phrase, least)
    docs = members.select("c", "doc_id").distinct()
    pairs = links.select("a", "b").join(docs.select(F.col("c").alias("a"), F.col("doc_id").alias("x")), "a").join(docs.select(F.col("c").alias("b"), F.col("doc_id").alias("y")), "b")
    return pairs.filter("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def shared_stretches(documents: DataFrame, phrase: int = PHRASE, least: int = LEAST) -> DataFrame:
    """(doc_id, begin, end): the stretches of each document that stand in another one too, from 0, end excluded.

    Stretches that touch or overlap are one.
    """
    members, links = _places(documents, phrase, least)
    # of a class the farthest reach to either side with any partner; partners reach it in one piece, as they share the phrase
    sides = links.select(F.explode(F.array(F.col("a"), F.col("b"))).alias("c"), "left", "right").groupBy("c").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    spans = members.join(sides, "c").select("doc_id", (F.col("at") - F.col("left")).alias("begin"), (F.col("at") + phrase + F.col("right")).alias("end")).distinct()
    order = Window.partitionBy("doc_id").orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("new", F.when(reach.isNull() | (F.col("begin") > reach), 1).otherwise(0))
    numbered = opened.withColumn("no", F.sum("new").over(order))
    return numbered.groupBy("doc_id", "no").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).select("doc_id", "begin", "end")


def shared_part(documents: DataFrame, phrase: int = PHRASE, least: int = LEAST) -> DataFrame:
    """(doc_id, n_chars, stretches, shared_chars, shared): how much of each document stands elsewhere too; all documents come out."""
    sums = shared_stretches(documents, phrase, least).groupBy("doc_id").agg(F.count("*").alias("stretches"), F.sum(F.col("end") - F.col("begin")).alias("shared_chars"))
    sizes = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    joined = sizes.join(sums, "doc_id", "left").fillna(0, ["stretches", "shared_chars"])
    return joined.withColumn("shared", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))

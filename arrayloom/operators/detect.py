"""Repeat arrays in contigs: exact direct repeats, evenly spaced.

The repeats of an array stand close to one another, so a tile of the contig with
its margins shows which places begin with as many bases as stand again within
that reach, and how many bases agree; only these places leave the tile, with the
bases that follow them. Chains of repeats are islands between breaks in spacing,
and of overlapping arrays the better one stays.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.functions.dna import BASES

TILE = 8192


def _agreeing(part: np.ndarray, least: int, most: int, reach: int) -> np.ndarray:
    """How many bases from each place on stand again up to reach bases before or behind it, at most so many; 0 below least.

    One pass per distance: places where the sequence agrees with itself, moved
    by that distance, form runs, and only runs of the least length matter.
    """
    out = np.zeros(len(part), np.int32)
    plain = np.isin(part, np.frombuffer(b"ACGT", np.uint8))
    for d in range(1, min(reach, len(part) - least) + 1):
        breaks = np.flatnonzero((part[:-d] != part[d:]) | ~plain[:-d])
        edges = np.r_[-1, breaks, len(part) - d]
        for k in np.flatnonzero(np.diff(edges) > least):
            begin, end = edges[k] + 1, edges[k + 1]
            longest = np.minimum(end - np.arange(begin, end - least + 1), most)
            for at in (begin, begin + d):
                np.maximum(out[at : at + len(longest)], longest, out=out[at : at + len(longest)])
    return out


def _runs(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours that have no more than most letters together, one at least."""
    begin, size = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if lengths:
        yield begin, len(lengths)


def seeds(records: DataFrame, keys: list[str], least: int, most: int, reach: int, pieces: bool = False) -> DataFrame:
    """(keys, at, longest, context): places whose first least bases stand again within reach, how many agree, and the bases from there on, at most so many.

    Tiles are as long as their margins need, so a contig of any length is looked
    at in parts, and no sequence is shuffled. With pieces, the tiles themselves
    come out too, with longest -1; a record of one tile only if it has a place.
    """
    n = F.length("sequence")
    cut = records.filter(n >= least).select(*keys, "sequence", F.explode(F.sequence(F.lit(0), n - 1, F.lit(TILE))).alias("tile"))
    begin = F.greatest(F.col("tile") - reach, F.lit(0))
    parts = cut.select(*keys, (F.col("tile") - begin).alias("inner"), begin.alias("begin"), (n > TILE).alias("long"), F.col("sequence").substr(begin + 1, F.col("tile") - begin + TILE + reach + most).alias("part"))
    kinds = dict(records.dtypes)
    gap = b"\0" * reach  # between parts, so that none agrees with the next

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner, begin, texts, long = (batch.column(c).to_pylist() for c in ("inner", "begin", "part", "long"))
            for first, last in _runs([len(t) + reach for t in texts], 1 << 17):
                some = texts[first:last]
                found = _agreeing(np.frombuffer(gap.join(t.encode("ascii", "replace") for t in some), np.uint8), least, most, reach)
                rows, at, longest, context, offset = [], [], [], [], 0
                for i, text in enumerate(some, first):
                    mine = found[offset + inner[i] : offset + min(len(text), inner[i] + TILE)]
                    places = (np.flatnonzero(mine) + inner[i]).tolist()
                    if pieces and (places or long[i]):
                        rows.append(i)
                        at.append(begin[i] + inner[i])
                        longest.append(-1)
                        context.append(text[inner[i] : inner[i] + TILE])
                    for p in places:
                        rows.append(i)
                        at.append(begin[i] + p)
                        longest.append(int(found[offset + p]))
                        context.append(text[p : p + most])
                    offset += len(text) + reach
                own = batch.select(keys).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), pa.array(at, pa.int32()), pa.array(longest, pa.int32()), pa.array(context, pa.string())], names=[*keys, "at", "longest", "context"])

    return parts.mapInArrow(look, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", at int, longest int, context string")


def _plain_enough(repeat: str) -> bool:
    """Not of low complexity, as low_complexity has it; repeats hold A, C, G and T only."""
    n = len(repeat)
    a, c, g, t = (repeat.count(x) for x in BASES)
    return max(a, c, g, t) / n <= 0.8 and 0.2 <= (c + g) / n <= 0.8


def _chains(places: list[tuple[int, int, str]], min_repeat: int, min_spacer: int, max_spacer: int, min_repeats: int) -> list[tuple]:
    """(start, end, size, repeat, places) of evenly spaced repeats, start and end from 1, both included."""
    by_repeat = {}
    for at, longest, context in places:
        for size in range(min_repeat, longest + 1):
            by_repeat.setdefault(context[:size], []).append(at)
    out = []
    for repeat, at in by_repeat.items():
        size = len(repeat)
        if len(at) < min_repeats or not _plain_enough(repeat):
            continue
        begin = 0
        for i in range(1, len(at) + 1):
            if i == len(at) or not min_spacer <= at[i] - at[i - 1] - size <= max_spacer:
                if i - begin >= min_repeats:
                    out.append((at[begin] + 1, at[i - 1] + size, size, repeat, at[begin:i]))
                begin = i
    return out


def _better(chains: list[tuple], sequence: str) -> list[tuple]:
    """Of overlapping chains the better ones: each stays unless more than half of the shorter one lies in one that stayed.

    Only chains of one stretch can meet, so each stretch is dealt with alone. Of
    the chains that stayed none lies in another one, so they have one order by
    start and by end. Where the repeat occurs first in the record, within reach
    of others or not, is looked up for chains that are alike in all else.
    """
    chains.sort(key=lambda c: c[0])
    first_at, stayed, i = {}, [], 0
    while i < len(chains):
        j, last = i, chains[i][1]
        while j < len(chains) and chains[j][0] <= last:
            last = max(last, chains[j][1])
            j += 1
        rank = lambda c: (-len(c[4]), c[0] - c[1], -c[2])
        alike = Counter(map(rank, chains[i:j]))

        def order(c: tuple) -> tuple:
            if alike[rank(c)] > 1 and c[3] not in first_at:
                first_at[c[3]] = sequence.find(c[3])
            return *rank(c), first_at.get(c[3], 0), c[0], c[1], c[3], c[4]

        kept = []
        for c in sorted(chains[i:j], key=order):
            k = bisect_right(kept, c[1], key=lambda x: x[0])
            fits = True
            while fits and k and kept[k - 1][1] >= c[0]:
                k -= 1
                common = min(c[1], kept[k][1]) - max(c[0], kept[k][0]) + 1
                fits = common / min(c[1] - c[0] + 1, kept[k][1] - kept[k][0] + 1) <= 0.5
            if fits:
                insort(kept, c, key=lambda x: x[0])
        stayed += kept
        i = j
    return stayed


def detect_arrays(
    records: DataFrame,
    min_repeat: int = 23,
    max_repeat: int = 47,
    min_spacer: int = 20,
    max_spacer: int = 72,
    min_repeats: int = 3,
) -> DataFrame:
    """Arrays of records (genome_id, contig_id, record_no, sequence), numbered per record in order of place.

    Out come array_id, genome_id, contig_id, record_no, start and end (from 1,
    both included), repeat_consensus, repeat_length, repeat_count, spacers and
    mean_spacer_length. Repeats hold A, C, G and T only and are of some
    complexity; spacers may hold anything. Records without array and null
    sequences give no rows.
    """
    keys = ["genome_id", "contig_id", "record_no"]
    rec = records.select(*keys, F.upper(F.regexp_replace("sequence", r"\s", "")).alias("sequence"))
    found = seeds(rec, keys, min_repeat, max_repeat, max_repeat + max_spacer, pieces=True)
    kinds = dict(records.dtypes)
    # the rows of a record stand together, its sequence's pieces first
    together = found.repartition(*keys).sortWithinPartitions(*keys, F.col("longest") >= 0, "at")
    names = [*keys, "no", "start", "end", "repeat", "count", "spacers"]

    def arrays_of(key: tuple, sequence: list[str], places: list[tuple[int, int, str]]) -> Iterator[tuple]:
        chains = _chains(places, min_repeat, min_spacer, max_spacer, min_repeats)
        if chains:
            whole = "".join(sequence)
            for no, (start, end, size, repeat, at) in enumerate(_better(chains, whole), 1):
                yield *key, no, start, end, repeat, len(at), [whole[a + size : b] for a, b in zip(at, at[1:])]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        key, sequence, places, out = None, [], [], []
        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(k) for k in keys), ("no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("repeat", pa.string()), ("count", pa.int32()), ("spacers", pa.list_(pa.string()))])
            for own, at, longest, context in zip(zip(*(batch.column(k).to_pylist() for k in keys)), *(batch.column(c).to_pylist() for c in ("at", "longest", "context"))):
                if own != key:
                    out += arrays_of(key, sequence, places)
                    key, sequence, places = own, [], []
                if longest < 0:
                    sequence.append(context)
                else:
                    places.append((at, longest, context))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*out))], schema=schema)
                out = []
        out = list(arrays_of(key, sequence, places)) if schema else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*out))], schema=schema)

    placed = together.mapInArrow(assemble, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", no int, start int, `end` int, repeat string, count int, spacers array<string>")
    out = placed.select(
        F.concat_ws("|", "genome_id", "contig_id", F.concat(F.lit("array_"), F.col("no").cast("string"))).alias("array_id"),
        *keys,
        "start",
        "end",
        F.col("repeat").alias("repeat_consensus"),
        F.length("repeat").alias("repeat_length"),
        F.col("count").alias("repeat_count"),
        "spacers",
    )
    total = F.aggregate("spacers", F.lit(0), lambda acc, s: acc + F.length(s))
    return out.withColumn("mean_spacer_length", total / F.size("spacers"))


def spacer_table(arrays: DataFrame) -> DataFrame:
    """One row per spacer: spacer_index from 1 and spacer_id = array_id|spacer_index."""
    rows = arrays.select("array_id", "genome_id", "contig_id", F.posexplode("spacers").alias("i", "spacer"))
    index = F.col("i") + 1
    return rows.select(
        F.concat("array_id", F.lit("|spacer_"), index.cast("string")).alias("spacer_id"), "array_id", "genome_id", "contig_id", index.alias("spacer_index"), "spacer", F.length("spacer").alias("spacer_length")
    )

"""Spacers in phage sequences: exact occurrences, and those within a number of mismatches.

Neither compares all spacers with all places: seeds of the spacers are met with
equal windows of the phages, and only these places are verified. Equal spacers
are one query; few queries travel to the tiles, more are joined with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.functions.dna import positions_alike, reverse_complement
from arrayloom.operators.detect import TILE

FEW_QUERIES = 40_000  # so many different texts, strands apart, are sent to all tasks
SEED = 20  # exact search looks for the first bases of a spacer, or for all of a shorter one


def _strands(spacers: DataFrame) -> DataFrame:
    """(own, query, strand) of the different texts own; a query that is its own reverse complement only once."""
    both = F.array(F.struct(F.col("own").alias("query"), F.lit("+").alias("strand")), F.struct(reverse_complement(F.col("own")).alias("query"), F.lit("-").alias("strand")))
    rows = spacers.select("own").distinct().select("own", F.explode(both).alias("x")).select("own", "x.*")
    return rows.filter("strand = '+' or query <> own")


def _phage(records: DataFrame) -> DataFrame:
    return records.select("phage_id", "phage_contig", F.upper("sequence").alias("sequence"))


def _tiles(target: DataFrame, before: int, after: int) -> DataFrame:
    """(phage_id, phage_contig, tile, begin, part): tiles of TILE bases, each with so many bases before and after it; part counts from begin."""
    tiles = target.filter(F.length("sequence") > 0).select("phage_id", "phage_contig", "sequence", F.explode(F.sequence(F.lit(0), F.length("sequence") - 1, F.lit(TILE))).alias("tile"))
    begin = F.greatest(F.col("tile") - before, F.lit(0))
    return tiles.select("phage_id", "phage_contig", "tile", begin.alias("begin"), F.col("sequence").substr(begin + 1, F.col("tile") - begin + TILE + after).alias("part"))


def _at_places(tiles: DataFrame, keys_at, seeded: DataFrame) -> DataFrame:
    """Places i of the tiles' parts whose keys seeded (key, ...) has, each with its tile's part again.

    keys_at: place in the part -> array of keys. Only keys and places are
    shuffled for the join; the parts follow for those tiles that have a place.
    """
    own = F.col("tile") - F.col("begin")
    places = F.sequence(own, F.least(F.length("part"), own + TILE) - 1)
    keys = F.flatten(F.transform(places, lambda i: F.transform(F.array_compact(keys_at(i)), lambda k: F.struct(i.alias("i"), k.alias("key")))))
    each = tiles.select("phage_id", "phage_contig", "tile", F.explode(keys).alias("x"))
    near = each.select("phage_id", "phage_contig", "tile", "x.i", "x.key").join(seeded, "key").drop("key")
    return near.join(tiles, ["phage_id", "phage_contig", "tile"])


def _own(spacers: DataFrame) -> DataFrame:
    """(spacer_id, own): spacers with their text in upper case."""
    return spacers.select("spacer_id", F.upper("spacer").alias("own"))


def _few(queries: DataFrame, few: int) -> list | None:
    """The rows of queries if there are no more than few, of 64 letters or fewer that are longer, and all are ASCII."""
    rows = queries.limit(few + 1).collect()
    small = len(rows) <= few and len(rows) * max((len(r["query"]) for r in rows), default=0) <= 64 * few
    return rows if small and all(r["query"].isascii() and "\0" not in r["query"] for r in rows) else None


def _seed_codes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit number for each window of so many bytes, or for each column of so many rows; equal ones have equal numbers."""
    n = max(0, len(data) - width + 1)
    out = np.zeros(n if data.ndim == 1 else data.shape[1], np.uint64)
    for j in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += data[j : j + n] if data.ndim == 1 else data[j]
    return out


def _mixed(codes: np.ndarray) -> np.ndarray:
    return (codes ^ (codes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


def _pair_codes(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return _mixed(one) * np.uint64(0xC2B2AE3D27D4EB4F) + other


def _groups(tiles: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs of tiles that have no more than most letters together, one tile at least."""
    begin, size = 0, 0
    for i, text in enumerate(tiles):
        if i > begin and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if tiles:
        yield begin, len(tiles)


def _looked_up(target: DataFrame, rows: list, blocks: int, max_mismatches: int, edge: int) -> DataFrame:
    """(own, query, strand, phage_id, phage_contig, at, mismatches, edge_mismatches) of few queries: every task holds them all and no window is shuffled.

    blocks: 0 for seeds of the first SEED bases, else pairs of so many blocks as
    in fuzzy_hits. A hit belongs to the tile in which it begins.
    """
    texts = [r["query"].encode() for r in rows]
    size = np.array([len(t) for t in texts], np.int64)
    longest = int(size.max(initial=1))
    letters = np.zeros((len(texts), longest), np.uint8)
    for i, t in enumerate(texts):
        letters[i, : len(t)] = np.frombuffer(t, np.uint8)
    # per width and distance: numbers of seeds in order, with their queries and offsets
    seeds = []
    widths = size // blocks if blocks else np.minimum(size, SEED)
    for w in sorted(set(widths.tolist())):
        mine = np.flatnonzero(widths == w)
        for d in range(1, blocks) if blocks else (0,):
            codes, offsets = [], []
            for first in range(blocks - d) if blocks else (0,):
                one, other = (letters[mine, k * w : (k + 1) * w].T for k in (first, first + d))
                codes.append(_pair_codes(_seed_codes(one, w), _seed_codes(other, w)) if d else _mixed(_seed_codes(one, w)))
                offsets.append(np.full(len(mine), first * w, np.int64))
            codes, offsets, who = np.concatenate(codes), np.concatenate(offsets), np.tile(mine, len(codes))
            order = np.argsort(codes, kind="stable")
            seeds.append((w, d, codes[order], who[order], offsets[order]))
    names, out_rows = pa.array([r["own"] for r in rows], pa.string()), pa.array([r["query"] for r in rows], pa.string())
    strands = pa.array([r["strand"] for r in rows], pa.string())
    kinds = dict(target.dtypes)
    tiles = _tiles(target, 0, longest)

    def find(parts: list[str]) -> tuple[np.ndarray, ...]:
        """(tile, place, query, mismatches, edge mismatches)"""
        plain = [t if t.isascii() else "".join(c if c.isascii() else "\0" for c in t) for t in parts]
        lengths = np.array([len(t) for t in plain], np.int64)
        begins = np.cumsum(lengths) - lengths
        data = np.frombuffer("".join(plain).encode(), np.uint8)
        tile_of = np.repeat(np.arange(len(plain), dtype=np.int32), lengths)
        found = []
        codes_of = {}
        for w, d, codes, who, offsets in seeds:
            if w not in codes_of:
                codes_of = {w: _seed_codes(data, w)}
            there = codes_of[w]
            there = _pair_codes(there[: max(0, len(there) - d * w)], there[d * w :]) if d else _mixed(there)
            seen = np.zeros(1 << 20, bool)
            seen[codes >> np.uint64(44)] = True
            at = np.flatnonzero(seen[there >> np.uint64(44)])
            low = np.searchsorted(codes, there[at], "left")
            many = np.searchsorted(codes, there[at], "right") - low
            each = np.repeat(np.arange(len(at)), many)
            k = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
            found.append((at[each] - offsets[k], who[k]))
        start, q = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        if blocks and len(start):  # several seeds lead to the same place
            start, q = np.divmod(np.unique(start * len(texts) + q), len(texts))
        inside = (start >= 0) & (start + size[q] <= len(data))
        start, q = start[inside], q[inside]
        tile = tile_of[start] if len(start) else start
        place = start - begins[tile]
        inside = (place < TILE) & (place + size[q] <= lengths[tile])
        tile, place, start, q = tile[inside], place[inside], start[inside], q[inside]
        wrong, low, high = (np.zeros(len(q), np.int32) for _ in range(3))
        for j in range(longest):
            more = j < size[q]
            differs = more & (data[np.minimum(start + j, len(data) - 1)] != letters[q, j])
            wrong += differs
            if blocks:
                low += differs & (j < edge)
                high += differs & (j >= size[q] - edge)
        keep = wrong <= max_mismatches
        return tile[keep], place[keep], q[keep], wrong[keep], np.minimum(low, high)[keep]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").to_pylist()
            batch = batch.select(["phage_id", "phage_contig", "begin"])  # no copy of a tile per hit
            for first, last in _groups(parts, 1 << 20):
                tile, place, q, wrong, near = find(parts[first:last])
                for cut in range(0, len(q), 1 << 16):
                    t, p, k, m, e = (x[cut : cut + (1 << 16)] for x in (tile, place, q, wrong, near))
                    own = batch.take(pa.array(t.astype(np.int64) + first))
                    at = own.column("begin").to_numpy(zero_copy_only=False) + p
                    yield pa.RecordBatch.from_arrays(
                        [*(x.take(pa.array(k)) for x in (names, out_rows, strands)), own.column("phage_id"), own.column("phage_contig"), pa.array(at.astype(np.int32)), pa.array(m, pa.int32()), pa.array(e, pa.int32())],
                        names=["own", "query", "strand", "phage_id", "phage_contig", "at", "mismatches", "edge_mismatches"],
                    )

    return tiles.drop("tile").mapInArrow(look, f"own string, query string, strand string, phage_id {kinds['phage_id']}, phage_contig {kinds['phage_contig']}, at int, mismatches int, edge_mismatches int")


def exact_places(spacers: DataFrame, phages: DataFrame, few: int = FEW_QUERIES) -> DataFrame:
    """(own, phage_id, phage_contig, strand, start, end): every occurrence of the different texts own in phages.

    Up to so many queries go to all tasks; more are joined by seeds.
    """
    queries = _strands(spacers.filter(F.length("own") > 0))
    target = _phage(phages)
    rows = _few(queries, few)
    if rows is not None:
        hit = _looked_up(target, rows, 0, 0, 0)
        at = F.col("at")
    else:
        seeded = queries.withColumn("width", F.least(F.length("query"), F.lit(SEED)))
        # at most SEED different widths
        known = seeded.groupBy("width").agg(F.max(F.length("query")).alias("n")).collect()
        widths, longest = sorted(r["width"] for r in known), max(r["n"] for r in known)
        part = F.col("part")

        def keys_at(i: Column) -> Column:
            return F.array(*[F.when(i + w <= F.length(part), F.xxhash64(F.lit(w), part.substr(i + 1, F.lit(w)))) for w in widths])

        near = _at_places(_tiles(target, 0, longest), keys_at, seeded.withColumn("key", F.xxhash64("width", F.left("query", F.col("width")))).drop("width"))
        hit = near.filter(part.substr(F.col("i") + 1, F.length("query")) == F.col("query"))
        at = F.col("begin") + F.col("i")
    return hit.select("own", "phage_id", "phage_contig", "strand", (at + 1).alias("start"), (at + F.length("query")).alias("end"))


def exact_hits(spacers: DataFrame, phages: DataFrame, few: int = FEW_QUERIES) -> DataFrame:
    """Every occurrence of spacers (spacer_id, spacer) in phages (phage_id, phage_contig, sequence), overlapping ones too.

    Out come spacer_id, phage_id, phage_contig, strand, start and end (from 1,
    both included). Empty spacers match nothing. Equal spacers are looked for
    once, and their ids are put back last.
    """
    members = _own(spacers)
    return exact_places(members, phages, few).join(members, "own").select("spacer_id", "phage_id", "phage_contig", "strand", "start", "end")


def fuzzy_hits(spacers: DataFrame, phages: DataFrame, max_mismatches: int = 4, min_identity: float = 0.85, edge: int = 8, per_spacer: int = 5, few: int = FEW_QUERIES) -> DataFrame:
    """The best places of each spacer within max_mismatches exchanged bases, both strands.

    A spacer is cut into max_mismatches + 2 blocks, of which two must be intact;
    both, at their distance from each other, give the places that are verified.
    Out come mismatches, identity, those in the better of the two edges and the
    rest; of each spacer the per_spacer best by (mismatches, edge mismatches),
    ties in order of phage, contig, strand and place. Spacers shorter than edge
    or with letters other than A, C, G and T are left out. Phages are read once
    for all widths of blocks. Equal spacers have equal places: they are looked
    for and ranked once, and their ids, each of one spacer, are put back last.
    """
    if edge < max_mismatches + 2:
        raise ValueError("spacers must be long enough for max_mismatches + 2 blocks: edge is too small")
    members = _own(spacers).filter((F.length("own") >= edge) & F.col("own").rlike("^[ACGT]+$")).distinct()
    queries = _strands(members)
    target = _phage(phages)
    blocks = max_mismatches + 2
    n = F.length("query")
    rows = _few(queries, few)
    if rows is not None:
        measured = _looked_up(target, rows, blocks, max_mismatches, edge).distinct()
    else:
        measured = _joined(queries, target, blocks, edge)
    near = measured.withColumn("identity", 1 - F.col("mismatches") / n).filter((F.col("mismatches") <= max_mismatches) & (F.col("identity") >= min_identity))
    order = Window.partitionBy("own").orderBy("mismatches", "edge_mismatches", F.desc("identity"), "phage_id", "phage_contig", "strand", "at")
    best = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_spacer)
    return best.join(members, "own").select(
        "spacer_id", "phage_id", "phage_contig", "strand", (F.col("at") + 1).alias("start"), (F.col("at") + n).alias("end"),
        "identity", "mismatches", n.alias("spacer_length"), "edge_mismatches", (F.col("mismatches") - F.col("edge_mismatches")).alias("distal_mismatches"),
    )


def _joined(queries: DataFrame, target: DataFrame, blocks: int, edge: int) -> DataFrame:
    """What _looked_up gives, for any number of queries: seeds are joined with windows of the phages."""
    width = F.floor(F.length("query") / blocks).cast("int")
    combos = [F.struct(F.lit(i).alias("i"), F.lit(j - i).alias("d")) for i in range(blocks) for j in range(i + 1, blocks)]
    cut = queries.select("own", "query", "strand", width.alias("width"), F.explode(F.array(*combos)).alias("c"))
    q, w, offset = F.col("query"), F.col("width"), F.col("c.i") * F.col("width")
    key = F.xxhash64("width", "c.d", q.substr(offset + 1, w), q.substr(offset + F.col("c.d") * w + 1, w))
    seeded = cut.select("own", "query", "strand", offset.alias("offset"), key.alias("key"))
    # widths follow from the spacers' lengths, so they are few
    known = queries.groupBy(width.alias("width")).agg(F.max(F.length("query")).alias("n")).collect()
    widths, longest = sorted((r["width"] for r in known), reverse=True), max(r["n"] for r in known)
    part = F.col("part")

    def keys_at(i: Column) -> Column:
        there = lambda at, k: part.substr(at + 1, F.lit(k))
        return F.array(*[F.when(i + (d + 1) * k <= F.length(part), F.xxhash64(F.lit(k), F.lit(d), there(i, k), there(i + d * k, k))) for k in widths for d in range(1, blocks)])

    near = _at_places(_tiles(target, longest, longest), keys_at, seeded)
    first = F.col("i") - F.col("offset")
    placed = near.filter(first >= 0).select("own", "query", "strand", "phage_id", "phage_contig", (F.col("begin") + first).alias("at"), part.substr(first + 1, F.length("query")).alias("there"))
    on_phage = placed.filter(F.length("there") == F.length("query")).distinct()
    n = F.length("query")
    mm = n - positions_alike(F.col("query"), F.col("there"))
    low = F.lit(edge) - positions_alike(F.substring("query", 1, edge), F.col("there").substr(F.lit(1), F.lit(edge)))
    high = F.lit(edge) - positions_alike(F.col("query").substr(n - edge + 1, F.lit(edge)), F.col("there").substr(n - edge + 1, F.lit(edge)))
    return on_phage.withColumn("mismatches", mm).withColumn("edge_mismatches", F.least(low, high)).drop("there")


def with_flanks(hits: DataFrame, phages: DataFrame, flank: int = 10) -> DataFrame:
    """hits with the protospacer and its flanks: on the reference (upstream, downstream) and in the spacer's sense (5', 3')."""
    joined = hits.join(_phage(phages), ["phage_id", "phage_contig"])
    s, begin, end = F.col("sequence"), F.col("start"), F.col("end")
    left = F.greatest(begin - 1 - flank, F.lit(0))
    up = s.substr(left + 1, begin - 1 - left)
    down = s.substr(end + 1, F.lit(flank))
    found = s.substr(begin, end - begin + 1)
    minus = F.col("strand") == "-"
    return joined.withColumn("genomic_upstream", up).withColumn("genomic_downstream", down).withColumn(
        "protospacer", F.when(minus, reverse_complement(found)).otherwise(found)
    ).withColumn("flank_5p", F.when(minus, reverse_complement(down)).otherwise(up)).withColumn("flank_3p", F.when(minus, reverse_complement(up)).otherwise(down)).drop("sequence")


def seed_mismatches(spacer: Column, protospacer: Column, side: Column, seed: int = 8) -> Column:
    """struct(region, length, mismatches, positions) of the seed at the rule's side; null without a side or bases."""
    a, b = F.regexp_replace(F.upper(spacer), "-", ""), F.regexp_replace(F.upper(protospacer), "-", "")
    n = F.least(F.length(a), F.length(b))
    k = F.least(F.lit(seed), n)
    start = F.when(side == "5prime", 0).otherwise(n - k)
    x, y = a.substr(start + 1, k), b.substr(start + 1, k)
    wrong = F.filter(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: x.substr(i, F.lit(1)) != y.substr(i, F.lit(1)))
    region = F.concat(side, F.lit(":"), (start + 1).cast("string"), F.lit("-"), (start + k).cast("string"))
    return F.when(
        (side != "") & (n > 0),
        F.struct(region.alias("region"), k.alias("length"), F.size(wrong).alias("mismatches"), F.array_join(F.transform(wrong, lambda i: i.cast("string")), ",").alias("positions")),
    )

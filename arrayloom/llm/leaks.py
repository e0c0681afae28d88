"""Passages of evaluation material that corpus documents print, by latent semantic retrieval.

Passages become TF-IDF vectors over their words and adjacent word pairs, with
document frequencies counted over the whole corpus. A distributed randomised
SVD of these vectors gives a latent space of fewer dimensions than passages.
Every window of every document is projected into it and compared with all
passages; a document and passage with a window of high cosine are a candidate.
The longest common subsequence of their words drops chance candidates, the
longest run of consecutive words that the document prints decides whether the
passage is printed, and where it isn't, common subsequence and answer words say
whether it is told in other words.

Passages are taken in blocks of bounded size, each with its own dictionary and
latent space, so that what is collected and broadcast does not grow with their
number; documents are read into words once for all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm.printed import MIN_RUN, Passage, common_subsequence, longest_run, page_lines, words
from arrayloom.runtime import written

# Passages of a block, about: 512 of 40 words have some 25,000 features, whose latent vectors take 26 MB.
BLOCK = 512
DIMS = 256
STEP, STEPS = 10, 3  # windows of STEPS * STEP words begin every STEP words, so that each run of 20 words lies in one
COSINE = 0.25
LEAST_COMMON = 5  # words that a candidate's document and passage must have in common in one order
# A passage is told in other words where so much of it is a common subsequence and so many of its rarest words stand near by.
PARAPHRASE, ANSWER_WORDS, ANSWERED = 0.6, 3, 2
DOCUMENTS, CHUNK = 500, 20_000  # documents searched and words whose latent vectors are gathered at a time

TOKENS = "doc_id bigint, lines array<array<string>>"
FOUND = "doc_id bigint, passage_id bigint, words int, cosine double, common int, answers int"


def page_words(documents: DataFrame) -> DataFrame:
    """(doc_id, lines): the words of each document, column by column and line by line; null texts have none."""
    known = dict(documents.dtypes)
    starts = F.col("line_boxes.x0") if "line_boxes" in known and "x0:" in known["line_boxes"] else F.lit(None).cast("array<int>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.string()))
        for batch in batches:
            lines = [page_lines(text, x) if text else [] for text, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, kind)], names=["doc_id", "lines"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", starts.alias("starts")).mapInArrow(read, TOKENS)


def passage_words(passages: DataFrame, min_run: int) -> DataFrame:
    """(passage_id, words) of the passages with at least min_run words, repeated rows once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["passage_id", "words"])

    given = passages.filter("passage_text is not null").select(F.col("passage_id").cast("bigint").alias("passage_id"), "passage_text")
    return given.mapInArrow(read, "passage_id bigint, words array<string>").filter(F.size("words") >= min_run).distinct()


class Features:
    """Numbers of the words and word pairs that occur in passages: words first, then pairs."""

    def __init__(self, passages: list[list[str]]):
        known = sorted({w for p in passages for w in p})
        self.words = pa.array(known, pa.string())
        no = {w: i for i, w in enumerate(known)}
        self.pairs = np.array(sorted({no[a] * len(known) + no[b] for p in passages for a, b in zip(p, p[1:])}), np.int64)
        self.n = len(known) + len(self.pairs)

    def of(self, tokens: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, and of the pair that it begins within its text; -1 where unknown. ends: where texts end."""
        w = pc.fill_null(pc.index_in(tokens, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        pair = np.full(len(w), -1, np.int64)
        if len(w) > 1 and len(self.pairs):
            key = np.where((w[:-1] >= 0) & (w[1:] >= 0), w[:-1] * len(self.words) + w[1:], -1)
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            pair[:-1] = np.where(self.pairs[at] == key, at + len(self.words), -1)
            last = ends[(ends > 0) & (ends < len(w))] - 1
            pair[last] = -1
        return w, pair


def _flat(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of documents, and where each document ends among them."""
    per_line = lines.flatten()
    line_ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(per_line), 0).to_numpy(zero_copy_only=False))].astype(np.int64)
    per_doc = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False)
    return per_line.flatten(), line_ends[np.cumsum(per_doc)]


def document_frequencies(pages: DataFrame, features: Features) -> DataFrame:
    """(feature, docs): in how many documents each feature occurs, and the number of documents as feature -1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(features.n, np.int64), 0
        for batch in batches:
            tokens, ends = _flat(batch.column(0))
            w, pair = features.of(tokens, ends)
            owner = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
            both = np.concatenate([owner * features.n + w, owner * features.n + pair])[np.concatenate([w, pair]) >= 0]
            seen += np.bincount(np.unique(both) % features.n, minlength=features.n)
            docs += batch.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[docs, seen[at]])], names=["feature", "docs"])

    return pages.select("lines").mapInArrow(count, "feature bigint, docs bigint").groupBy("feature").agg(F.sum("docs").alias("docs"))


def passage_vectors(passages: DataFrame, features: Features, idf: np.ndarray) -> DataFrame:
    """(passage_id, words, ids, weights): TF-IDF vectors, built where the passages are."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, weights = [], []
            for p in batch.column(1):
                w, pair = features.of(p.values, np.array([len(p.values)]))
                i, times = np.unique(np.concatenate([w, pair[pair >= 0]]), return_counts=True)
                ids.append(i.astype(np.int32))
                weights.append(times * idf[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))], names=["passage_id", "words", "ids", "weights"])

    return passages.mapInArrow(weigh, "passage_id bigint, words array<string>, ids array<int>, weights array<double>")


def randomised_svd(rows: DataFrame, n_features: int, dims: int, oversample: int = 16, seed: int = 3) -> np.ndarray:
    """The right singular vectors (n_features x at most dims) of a sparse matrix with rows (ids, weights).

    Rows stay in their partitions. They are multiplied with a random matrix that
    every task makes for itself; the small Gram matrix of the products gives an
    orthonormal basis Q of the row space's image, and the blocks of A'Q, summed
    over the partitions by block, give the singular vectors.
    """
    width = dims + oversample

    def products(part: pd.DataFrame, omega: np.ndarray) -> np.ndarray:
        return np.stack([np.asarray(w) @ omega[np.asarray(i)] for i, w in zip(part["ids"], part["weights"])]) if len(part) else np.zeros((0, width))

    def random() -> np.ndarray:
        return np.random.default_rng(seed).standard_normal((n_features, width), np.float32)

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        omega, g = random(), np.zeros((width, width))
        for part in batches:
            y = products(part, omega)
            g += y.T @ y
        yield pd.DataFrame({"g": [g.tobytes()]})

    total = sum((np.frombuffer(r.g).reshape(width, width) for r in rows.mapInPandas(gram, "g binary").toLocalIterator()), np.zeros((width, width)))
    values, vectors = np.linalg.eigh(total)
    kept = values > values.max(initial=0) * 1e-10
    to_basis = vectors[:, kept] / np.sqrt(values[kept])
    rank, block = to_basis.shape[1], 1024

    def image(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        omega, b = random(), np.zeros((n_features, rank), np.float32)
        for part in batches:
            q = products(part, omega) @ to_basis
            for ids, weights, x in zip(part["ids"], part["weights"], q):
                b[np.asarray(ids)] += np.outer(weights, x)
        yield pd.DataFrame({"block": range(0, n_features, block), "b": [b[k : k + block].tobytes() for k in range(0, n_features, block)]})

    def added(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": part["block"][:1], "b": [np.sum([np.frombuffer(x, np.float32) for x in part["b"]], axis=0, dtype=np.float32).tobytes()]})

    summed = rows.mapInPandas(image, "block int, b binary").groupBy("block").applyInPandas(added, "block int, b binary")
    b = np.zeros((n_features, rank), np.float32)
    for r in summed.toLocalIterator():
        part = np.frombuffer(r.b, np.float32).reshape(-1, rank)
        b[r.block : r.block + len(part)] = part
    squares, turned = np.linalg.eigh((b.T @ b).astype(np.float64))
    best = np.argsort(squares)[::-1][:dims]
    best = best[squares[best] > squares.max(initial=0) * 1e-10]
    return b @ (turned[:, best] / np.sqrt(squares[best])).astype(np.float32)


class Space:
    """One block's passages in their latent space; tasks compare windows with it."""

    def __init__(self, idf: np.ndarray, seen: np.ndarray, latent: np.ndarray, ids: list[int], texts: list[list[str]], vectors: list[tuple[np.ndarray, np.ndarray]], cosine: float):
        self.features, self.cosine = Features(texts), cosine
        features = self.features
        self.passages = [(i, Passage(t)) for i, t in zip(ids, texts)]
        placed = np.stack([w @ latent[i] for i, w in vectors])
        kept = np.maximum((placed**2).sum(axis=1), 1e-9)
        whole = np.array([np.linalg.norm(w) for _, w in vectors])
        # Passages keep unequal parts of their norm in the latent space; a window's product with one is set against what is kept.
        self.placed = (placed * (whole / kept)[:, None]).astype(np.float32).T.copy()
        self.adds = (idf[:, None] * latent).astype(np.float32)  # what one occurrence of a feature adds to a window
        self.squares = idf**2
        # what each feature of a window adds to its cosine with a passage before all projection
        self.exact = [dict(zip(i.tolist(), (w * idf[i] / max(size, 1e-9)).tolist())) for (i, w), size in zip(vectors, whole)]
        most = np.zeros(features.n)
        for i, w in vectors:
            most[i] = np.maximum(most[i], w)
        # By Cauchy and Schwarz a window whose features weigh less in every passage than this share of the lightest passage has no cosine so high.
        self.reach = most**2
        self.least = (cosine * whole[whole > 0].min(initial=np.inf)) ** 2
        n = len(features.words)
        rare = [sorted({int(x) for x in i if x < n and seen[x]}, key=lambda x: -idf[x])[:ANSWER_WORDS] for i, _ in vectors]
        self.answers = [{features.words[x].as_py() for x in r} for r in rare]

    def candidates(self, tokens: pa.Array, ends: np.ndarray, min_run: int) -> dict[tuple[int, int], tuple[float, int]]:
        """(document, passage) -> (best cosine, where its window begins in the document) for all windows of the documents."""
        begins, sizes = np.r_[0, ends[:-1]], np.diff(np.r_[0, ends])
        w, pair = self.features.of(tokens, ends)
        upto = np.r_[0.0, np.cumsum(np.where(w >= 0, self.reach[w], 0.0) + np.where(pair >= 0, self.reach[pair], 0.0))]
        norm = np.r_[0.0, np.cumsum(np.where(w >= 0, self.squares[w], 0.0) + np.where(pair >= 0, self.squares[pair], 0.0))]
        many = np.where(sizes < min_run, 0, np.maximum(1, -(-(sizes - STEPS * STEP + STEP) // STEP)))
        doc = np.repeat(np.arange(len(sizes)), many)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        start = begins[doc] + first * STEP
        end = np.minimum(start + STEPS * STEP, ends[doc])
        chosen = np.flatnonzero(upto[end] - upto[start] >= self.least)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        at = 0
        while at < len(chosen):
            till = min(at + CHUNK // STEP, len(chosen))
            part = chosen[at:till]
            at = till
            # steps of STEP words are summed once and shared by the windows they lie in
            steps = np.unique(np.minimum(start[part][:, None] + np.arange(STEPS) * STEP, end[part][:, None] - 1) - (np.minimum(start[part][:, None] + np.arange(STEPS) * STEP, end[part][:, None] - 1) - begins[doc[part]][:, None]) % STEP)
            own = np.searchsorted(ends, steps, side="right")
            stops = np.minimum(steps + STEP, ends[own])
            where = np.repeat(np.arange(len(steps)), stops - steps)
            token = np.arange(len(where)) - np.repeat(np.cumsum(stops - steps) - (stops - steps), stops - steps) + np.repeat(steps, stops - steps)
            ids, of = np.concatenate([w[token], pair[token]]), np.concatenate([where, where])
            ids, of = ids[ids >= 0], of[ids >= 0]
            order = np.argsort(of, kind="stable")
            ids, of = ids[order], of[order]
            sums = np.zeros((len(steps) + 1, self.adds.shape[1]), np.float32)
            if len(ids):
                heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                sums[of[heads]] = np.add.reduceat(self.adds[ids], heads, axis=0)
            wanted = start[part][:, None] + np.arange(STEPS) * STEP
            place = np.searchsorted(steps, np.minimum(wanted, steps[-1]))
            place[(wanted >= end[part][:, None]) | (steps[np.minimum(place, len(steps) - 1)] != wanted)] = len(steps)
            latent = sums[place].sum(axis=1)
            norms = np.sqrt(np.maximum(norm[end[part]] - norm[start[part]], 1e-9)).astype(np.float32)
            last, own_ids = -1, []
            for i, p in zip(*np.nonzero((latent @ self.placed) / norms[:, None] >= self.cosine)):
                if i != last:
                    a, b = start[part[i]], end[part[i]]
                    last, own_ids = i, [*w[a:b].tolist(), *pair[a:b].tolist()]
                # the latent product is an estimate: what passes counts with the cosine itself
                weights = self.exact[p]
                value = sum(weights.get(x, 0.0) for x in own_ids) / float(norms[i])
                key = (int(doc[part[i]]), int(p))
                if value >= self.cosine and value > best.get(key, (0.0, 0))[0]:
                    best[key] = (value, int(first[part[i]] * STEP))
        return best


def _space(pages: DataFrame, passages: DataFrame, dims: int, cosine: float) -> tuple | None:
    """What makes the Space of a block of passages (passage_id, words); None without passages. The block is bounded, so it is collected."""
    given = passages.collect()
    if not given:
        return None
    features = Features([r["words"] for r in given])
    counted = {r["feature"]: r["docs"] for r in document_frequencies(pages, features).collect()}
    total = counted.pop(-1, 0)
    per = np.zeros(features.n)
    per[list(counted)] = list(counted.values())
    if not per.any():
        return None
    idf = np.log((total + 1) / (per + 1)) + 1e-3
    vectors = written(passage_vectors(passages, features, idf), "vectors")
    latent = randomised_svd(vectors.select("ids", "weights"), features.n, min(dims, -(-len(given) // 2)))
    rows = vectors.collect()
    return idf, per > 0, latent, [r["passage_id"] for r in rows], [r["words"] for r in rows], [(np.array(r["ids"]), np.array(r["weights"])) for r in rows], cosine


def _compared(pages: DataFrame, parts: tuple, min_run: int) -> DataFrame:
    model = pages.sparkSession.sparkContext.broadcast(parts)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(*model.value)
        for batch in batches:
            found = []
            for first in range(0, batch.num_rows, DOCUMENTS):
                ids, texts = (c.slice(first, DOCUMENTS) for c in batch.columns)
                tokens, ends = _flat(texts)
                lines: dict[int, list[list[str]]] = {}
                for (d, p), (like, at) in sorted(space.candidates(tokens, ends, min_run).items()):
                    if d not in lines:
                        lines = {d: texts[d].as_py()}
                    got = _judged(lines[d], space.passages[p][1], space.answers[p], at, min_run)
                    if got:
                        found.append((ids[d].as_py(), space.passages[p][0], got[0], like, *got[1:]))
            if found:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], names=["doc_id", "passage_id", "words", "cosine", "common", "answers"])

    return pages.mapInArrow(search, FOUND)


def _judged(lines: list[list[str]], passage: Passage, answers: set[str], at: int, min_run: int) -> tuple[int, int, int] | None:
    """(longest run, common subsequence near the window, answer words there), or None if the passage is neither printed nor told in other words."""
    page = [w for line in lines for w in line]
    if common_subsequence(passage, page) < LEAST_COMMON:
        return None
    # the rest of the passage may stand anywhere on the page, in other columns or beyond notices
    run = longest_run(passage, lines)
    m = len(passage.words)
    near = page[max(0, at - m) : at + STEPS * STEP + m]
    common, answered = common_subsequence(passage, near), len(answers.intersection(near))
    if run >= min_run or (common >= PARAPHRASE * m and answered >= min(ANSWERED, len(answers))):
        return run, common, answered
    return None


def passage_leaks(documents: DataFrame, passages: DataFrame, dims: int = DIMS, cosine: float = COSINE, min_run: int = MIN_RUN, block: int = BLOCK) -> DataFrame:
    """(doc_id, passage_id, words, cosine, common, answers, kind): documents that print a passage or tell it in other words.

    documents: doc_id, text and, if there is one, line_boxes; passages:
    passage_id, passage_text. Words agree if they differ in letter case,
    punctuation or scan damage only. words is the longest run of the passage's
    consecutive words that the document prints, cosine that of the best window,
    common the longest common subsequence of words around it, answers how many
    of the passage's rarest words stand there. kind is printed from min_run
    words on, else paraphrased. Null and empty texts print nothing, passages
    shorter than min_run words are never printed, repeated rows of one doc_id
    are one document. A block of passages has a latent space of dims dimensions
    or, where it has fewer passages than twice that, of half as many.
    """
    pages = written(page_words(documents), "pages")
    given = written(passage_words(passages, min_run), "passages")
    blocks = max(1, -(-given.count() // block))
    hits = None
    for no in range(blocks):
        space = _space(pages, given.filter(F.pmod(F.xxhash64("passage_id"), F.lit(blocks)) == no).orderBy("passage_id", "words"), dims, cosine)
        if space is not None:
            found = _compared(pages, space, min_run)
            hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = documents.sparkSession.createDataFrame([], FOUND)
    best = hits.groupBy("doc_id", "passage_id").agg(*[F.max(c).alias(c) for c in ("words", "cosine", "common", "answers")])
    return best.withColumn("kind", F.when(F.col("words") >= min_run, "printed").otherwise("paraphrased"))


def printed_passages(documents: DataFrame, passages: DataFrame, **options) -> DataFrame:
    """passage_leaks of kind printed."""
    return passage_leaks(documents, passages, **options).filter("kind = 'printed'").drop("kind")


def leak_report(leaks: DataFrame, passages: DataFrame) -> DataFrame:
    """Per task and split: passages, those printed somewhere, those only told in other words, documents that print them, and the longest run."""
    printed = F.col("kind") == "printed"
    leaked = leaks.groupBy("passage_id").agg(F.count_if(printed).alias("n"), F.max(F.when(printed, F.col("words"))).alias("most"))
    return passages.select("passage_id", "task", "eval_split").join(leaked, "passage_id", "left").groupBy("task", "eval_split").agg(
        F.count("*").alias("passages"), F.count_if(F.col("n") > 0).alias("leaked"), F.count_if(F.col("n") == 0).alias("paraphrased_only"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("prints"), F.max("most").alias("most_words"),
    )

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.llm import leaks, printed, shared_spans

rng = random.Random(2)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def text(n):
    return "".join(rng.choice(LETTERS + "   \n") for _ in range(n))


def shares(a, b, least):
    windows = {a[i : i + least] for i in range(len(a) - least + 1)}
    return any(b[i : i + least] in windows for i in range(len(b) - least + 1))


@pytest.mark.parametrize(("hot", "few"), [(300, 1_000_000), (1, 1_000_000), (300, 0)])
def test_shared_spans(spark, monkeypatch, hot, few):
    monkeypatch.setattr(shared_spans, "HOT", hot)
    monkeypatch.setattr(shared_spans, "FEW_IDS", few)
    common = [text(n) for n in (60, 79, 80, 81, 130, 200)]
    rows = [(1, None), (2, ""), (3, "." * 500), (4, "." * 90), (5, "." * 79)]
    for i in range(6, 60):
        rows.append((i, text(rng.randint(0, 150)) + rng.choice([*common, ""]) + text(rng.randint(0, 90)) + rng.choice([*common, ""])))
    rows.append((70, rows[20][1]))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string")
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and shares(x, y, 80)}
    got = [tuple(r) for r in shared_spans.sharing_pairs(df, phrase=40, least=80).collect()]
    assert set(got) == want and len(got) == len(want)
    part = {r.doc_id: r.shared_chars for r in shared_spans.shared_part(df, phrase=40, least=80).collect()}
    for doc, t in rows:
        covered = np.zeros(len(t or ""), bool)
        others = [y for b, y in rows if b != doc and y and len(y) >= 80]
        for i in range(len(t or "") - 79):
            if any(t[i : i + 80] in y for y in others):
                covered[i : i + 80] = True
        assert part[doc] == covered.sum(), doc


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert shared_spans.sharing_pairs(empty).count() == 0
    assert shared_spans.shared_part(empty).count() == 0


WORDS = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 9))) for _ in range(3000)]


def prose(n):
    return [rng.choice(WORDS) for _ in range(n)]


def damaged(words, rate):
    swaps = {"o": "0", "e": "c", "l": "1", "i": "j", "n": "u", "h": "b", "s": "5", "t": "f"}
    return ["".join(swaps.get(c, c) if rng.random() < rate else c for c in w) for w in words]


def lines(words, width=7):
    return [" ".join(words[i : i + width]) for i in range(0, len(words), width)]


def test_printed_passages(spark):
    passages = [(i, " ".join(prose(rng.randint(25, 40)))) for i in range(30)] + [(90, "too short to matter"), (91, None), (92, "")]
    rows, want = [(900, None, None), (901, "", None)], set()
    for doc in range(60):
        body = prose(80)
        if doc % 2 == 0:
            pid, p = passages[doc % 30]
            w = p.split()
            many = rng.choice([10, 12, 18, 24, len(w)])
            at = rng.randint(0, len(w) - many) if many < len(w) else 0
            body[40:40] = damaged(w[at : at + many], rng.choice([0, 0.2, 0.5]))
            if many >= 15:
                want.add((doc, pid))
        own = lines(body)
        if doc % 3 == 0:  # a second column between the lines
            other = lines(prose(100))
            mixed = [x for pair in zip(own, other) for x in pair] + own[len(other) :]
            boxes = [x for _ in range(min(len(own), len(other))) for x in (80, 900)] + [80] * max(0, len(own) - len(other))
        else:
            mixed, boxes = own, [80] * len(own)
        rows.append((doc, "\n".join(mixed), [(x, 0, 0, 0) for x in boxes]))
    rows.append((0, rows[2][1], rows[2][2]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, line_boxes array<struct<x0:int,y0:int,x1:int,y1:int>>")
    given = spark.createDataFrame(passages, "passage_id bigint, passage_text string")
    got = [(r.doc_id, r.passage_id) for r in leaks.printed_passages(docs, given).collect()]
    assert set(got) == want and len(got) == len(want)
    assert leaks.printed_passages(docs.limit(0), given).count() == 0
    assert leaks.printed_passages(docs, given.limit(0)).count() == 0
    assert {(r.doc_id, r.passage_id) for r in leaks.printed_passages(docs.drop("line_boxes"), given).collect()} <= want


def test_runs_go_on_beyond_notices():
    p = printed.Passage("the wheat over the kosthoal carried after noon this steesttion which the woled market that butter in that report")
    near = "the wheat over the kosthoal carried|a notice of some words|after noon this steesttion which the|woled market that butter in that report".split("|")
    assert printed.longest_run(p, [printed.words(x) for x in near]) == 19
    far = [near[0], *["a notice of some words"] * 20, *near[2:]]
    assert printed.longest_run(p, [printed.words(x) for x in far]) == 19
    assert printed.longest_run(p, [printed.words(x) for x in [near[0], *["a notice"] * 60, *near[2:]]]) == 19
    assert printed.longest_run(p, [printed.words(x) for x in (near[0], "and carried", near[3])]) < 15
    assert printed.longest_run(p, []) == 0


def test_runs_go_on_at_any_distance(spark):
    own = random.Random(7)
    p = own.sample(WORDS, 30)
    notices = [" ".join(own.sample(WORDS, 3)) for _ in range(90)]

    def page(*parts):  # a narrow column with a run of notices between parts
        out = []
        for part in parts:
            out += [*notices, *lines(part, 3)] if out else lines(part, 3)
        return out

    long = "extraordinarily"
    broken = [*p[:12], long, *p[13:24]]
    pages = {
        1: (p, page(p[:12], p[12:24])),
        2: (p, page([*p[:11], "xqzxq"], p[12:24])),  # a word misread beyond recognition at the seam
        3: (broken, page([*p[:12], "extraor-"], ["dinarily", *p[13:24]])),
        4: (p, page(p[:9], p[9:18], p[18:24])),
        5: (p, page(p[:13], p[20:])),
    }
    for k, (words, text_lines) in pages.items():
        run = printed.longest_run(printed.Passage(" ".join(words)), [printed.words(x) for x in text_lines])
        assert run == 24 if k < 5 else run < 15, k
    docs = spark.createDataFrame([(k, "\n".join(x)) for k, (_, x) in pages.items()] + [(k, " ".join(own.sample(WORDS, 40))) for k in range(6, 40)], "doc_id bigint, text string")
    given = spark.createDataFrame([(1, " ".join(p)), (2, " ".join(broken))], "passage_id bigint, passage_text string")
    assert {r.doc_id for r in leaks.printed_passages(docs, given).collect()} == {1, 2, 3, 4}


def test_svd_matches_numpy(spark):
    a = np.zeros((40, 90))
    rows = []
    for r in range(40):
        ids = sorted(rng.sample(range(90), 12))
        w = [rng.random() for _ in ids]
        a[r, ids] = w
        rows.append((ids, w))
    df = spark.createDataFrame(rows, "ids array<int>, weights array<double>").repartition(3)
    v = leaks.randomised_svd(df, 90, 40)
    assert np.allclose(a @ v @ v.T, a, atol=1e-4)


def test_words_and_columns():
    assert printed.words("Tbe  c|inh,er5 — 5ay: ") == printed.words("the cllnbcrs say")
    assert printed.page_lines("a\nb\nc\nd", [10, 900, 12, 905]) == [["a"], ["o"], ["n"], ["d"]]
    assert printed.page_lines("a | x\nd | y", [10, 10]) == [["a"], ["d"], ["x"], ["n"]]
    assert printed.page_lines("a\nd", None) == [["a"], ["d"]]
    assert printed.page_lines("", []) == [[]]


def test_blocks_of_passages_and_other_words(spark):
    own = random.Random(11)
    passages = [(i, " ".join(own.sample(WORDS, 30))) for i in range(40)]
    rows, want, told = [], set(), set()
    for doc in range(60):
        body = [w for _ in range(5) for w in own.sample(WORDS, 30)]
        pid, p = passages[doc % 40]
        w = p.split()
        if doc % 3 == 0:
            body[60:60] = w
            want.add((doc, pid))
        elif doc % 3 == 1:  # every fourth word is another one
            body[60:60] = [own.choice(WORDS) + "zz" if i % 4 == 3 else x for i, x in enumerate(w)]
            told.add((doc, pid))
        rows.append((doc, "\n".join(lines(body))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    given = spark.createDataFrame([*passages, passages[0]], "passage_id bigint, passage_text string")
    for block in (512, 15):
        got = leaks.passage_leaks(docs, given, block=block).collect()
        assert {(r.doc_id, r.passage_id) for r in got if r.kind == "printed"} == want
        other = {(r.doc_id, r.passage_id): r for r in got if r.kind == "paraphrased"}
        # the words that were replaced are rarer than those that stayed, so the answer check drops about half
        assert set(other) <= told and len(other) >= 0.4 * len(told)
        assert all(18 <= r.common <= 30 and r.words < 15 and r.answers >= 2 for r in other.values())
    report = leaks.leak_report(leaks.passage_leaks(docs, given), given.withColumn("task", F.lit("t")).withColumn("eval_split", F.lit("test")).distinct()).collect()
    assert [(r.passages, r.leaked, r.prints) for r in report] == [(40, len({p for _, p in want}), len(want))]


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    own = random.Random(3)
    for _ in range(200):
        a, b = (own.choices("abcdefg", k=own.randint(1, 12)) for _ in range(2))
        assert printed.common_subsequence(printed.Passage(a), b) == plain(a, b)


def test_wide_gaps_part_columns():
    assert printed.page_lines("a    x\nd  y", None) == [["a"], ["d"], ["x"], ["n"]]
    assert printed.page_lines("a  x\nd y", None) == [["a", "x"], ["d", "n"]]

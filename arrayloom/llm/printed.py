"""How words of scanned pages are compared, and whether a page prints a passage.

Pure helpers that tasks call for one page at a time.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

#: Letters that scanners mistake for one another are read as one. Fixed values.
LOOKALIKES = {"o": "oec0", "i": "iljtfr1|!", "n": "nuhbvyw6", "s": "s5", "g": "gq9"}

MIN_RUN = 15
# Boxes of one column begin within so many dots of each other.
COLUMN_GAP = 150


class _Letters(dict):
    """Character table for str.translate, filled as characters are met: lookalikes to one letter, other signs to nothing."""

    def __missing__(self, code: int):
        char = chr(code)
        base = unicodedata.normalize("NFKD", char)[0].lower() if not char.isspace() else char
        if char.isspace():
            value = char
        else:
            value = next((k for k, group in LOOKALIKES.items() if base in group), base if base.isalnum() else None)
        self[code] = value
        return value


_LETTERS = _Letters()


def skeleton(text: str) -> str:
    """The text with lookalike letters as one and without punctuation; white space stays."""
    return text.translate(_LETTERS)


def words(text: str) -> list[str]:
    return skeleton(text).split()


# Two blanks also occur within lines; they part columns only on pages that hold wider gaps too.
_BAR, _GAPS, _WIDE = re.compile(r" \| "), re.compile(r" \| | {2,}"), re.compile(r"\S {3,}\S")


def page_lines(text: str, starts=None) -> list[list[str]]:
    """The words of a page's lines, column by column.

    starts: where each line's box begins; lines whose boxes begin close to one
    another are a column, columns go from left to right, and lines keep their
    order within one. Where columns run together in one line with a bar or wide
    blanks between them, its parts are lines of columns side by side. Without starts, or with
    another number of them than lines, the scanner's order stays.
    """
    lines = text.split("\n")
    n = len(lines)
    beside = _GAPS if _WIDE.search(text) else _BAR
    column = np.zeros(n, np.int64)
    if starts is not None and len(starts) == n and n > 1:
        x = np.asarray([s if s is not None else 0 for s in starts])
        by = np.argsort(x, kind="stable")
        column[by] = np.cumsum(np.r_[0, np.diff(x[by]) > COLUMN_GAP])
    keyed = [(int(c), k, i, part) for i, (c, line) in enumerate(zip(column, lines)) for k, part in enumerate(beside.split(line))]
    keyed.sort(key=lambda x: x[:3])
    return [words(part) for *_, part in keyed]


def _edits_within(a: str, b: str, most: int) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def alike(a: str, b: str) -> bool:
    """Whether two words' skeletons differ by scan damage only: one edit from four letters on, two from eight."""
    n = max(len(a), len(b))
    return a == b or (n > 3 and _edits_within(a, b, 1 if n < 8 else 2))


class Passage:
    """A passage's words, and where each stands in it."""

    def __init__(self, text: str | list[str]):
        self.words = words(text) if isinstance(text, str) else text
        self.at: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            self.at.setdefault(w, []).append(i)
        self.masks = {w: sum(1 << i for i in at) for w, at in self.at.items()}


def common_subsequence(passage: Passage, page: list[str]) -> int:
    """The longest common subsequence of two lists of words, one bit per word of the passage."""
    masks = passage.masks
    open_ = all_ = (1 << len(passage.words)) - 1
    for w in page:
        mask = masks.get(w)
        if mask:
            hit = open_ & mask
            open_ = ((open_ + hit) | (open_ - hit)) & all_
    return len(passage.words) - open_.bit_count()


# Adverts and notices may stand between two lines of a passage, however many. Up to so many lines, whatever a line holds of
# the passage takes it up again. Beyond, chance agrees too: there a part of a chain must have some agreeing words or
# letters, over as many lines as it takes, and where neither of the two lines that meet has as many, the first part ends
# its line and the second begins its line, as whole lines stand between.
LINES_BETWEEN = 6
FAR_WORDS, FAR_LETTERS = 4, 16
# A stretch counts if its agreeing words have so many letters, or if they are all of a line of two words or more.
LEAST_LETTERS = 7


def fragments(passage: Passage, line: list[str]) -> list[tuple[int, int, int, bool, bool, bool]]:
    """(begin, end, words that agree, whether they can't be chance, whether it begins the line, whether it ends it) of the passage's stretches that a line prints, end excluded.

    One unreadable word before or behind a stretch counts as its own line's edge.

    Words that agree start a diagonal where they are two or one long word; it
    is stretched over damaged words, one unreadable word at a time.
    """
    p, m, n = passage.words, len(passage.words), len(line)
    diagonals: dict[int, list[int]] = {}
    for j, w in enumerate(line):
        for i in passage.at.get(w, ()):
            diagonals.setdefault(i - j, []).append(j)
    out = []
    for d, seeds in diagonals.items():
        if len(seeds) == 1 and len(line[seeds[0]]) < 5 and n > 2:
            continue
        low, high, good = max(0, -d), min(n, m - d), len(seeds)
        at = set(seeds)
        a, b = seeds[0], seeds[-1]
        inner = [j for j in range(a + 1, b) if j not in at]
        good += sum(alike(line[j], p[j + d]) for j in inner)
        if good * 3 < (b - a + 1) * 2:  # far apart by chance: keep the first stretch
            b = a
            while b + 1 < high and (b + 1 in at or alike(line[b + 1], p[b + 1 + d])):
                b += 1
            good = b - a + 1
        for step, edge in ((-1, a), (1, b)):
            j, reached = edge + step, edge
            while low <= j < high and abs(j - reached) <= 2:
                if alike(line[j], p[j + d]):
                    reached = j
                    good += 1
                j += step
            a, b = (reached, b) if step < 0 else (a, reached)
        letters = sum(len(line[j]) for j in range(a, b + 1) if j in at or alike(line[j], p[j + d]))
        if letters < LEAST_LETTERS and not 1 < n == good == b - a + 1:
            continue
        # the other half of a word that is broken at the line's end or beginning
        begin, end = a + d, b + d + 1
        if b == n - 2 and end < m and _begins(p[end], line[n - 1]):
            end += 1
        if a == 1 and begin > 0 and _ends(p[begin - 1], line[0]):
            begin -= 1
        out.append((begin, end, good, good >= FAR_WORDS or letters >= FAR_LETTERS, a <= 1, b >= n - 2))
    return out


def _begins(word: str, half: str) -> bool:
    return 0 < len(half) < len(word) and alike(word[: len(half)], half)


def _ends(word: str, half: str) -> bool:
    return 0 < len(half) < len(word) and alike(word[-len(half) :], half)


def longest_run(passage: Passage, lines: list[list[str]]) -> int:
    """How many consecutive words of the passage the lines print.

    The stretches that lines print are chained where one takes up where the
    other left off, at most one word lost between them; any number of lines may
    stand between. The result is the number of words from
    the beginning to the end of the longest chain in which four of five words
    agree.
    """
    best = 0
    # By the passage position where chains end, then by those where chain and last part begin: (words that agree in the
    # chain, in the part, line). Parts are what lines near one another print.
    near: dict[int, dict[tuple[int, int], tuple[int, int, int]]] = {}
    edge: dict[int, dict[tuple[int, int], tuple[int, int, int]]] = {}  # sound parts that end their line
    firm: dict[int, dict[tuple[int, int], tuple[int, int, int]]] = {}  # sound parts whose last line has FAR_WORDS

    def keep(ends, most, end, begins, chain):
        old = ends.setdefault(end, {}).get(begins)
        if not old or old[0] <= chain[0] or (most is not None and chain[2] - old[2] > most):
            ends[end][begins] = chain

    for no, line in enumerate(lines):
        new = []
        for begin, end, good, firmly, begins, ends in fragments(passage, line):
            befores = [(near, over, LINES_BETWEEN) for over in (0, 1, -1)]
            if begins:
                befores += [(edge, over, None) for over in (0, 1, -1)]
            if firmly:
                befores.append((firm, 0, None))
            chains = {(begin, begin): (good, good)}
            for table, over, most in befores:
                for (start, part), (agree, own, at) in table.get(begin - over, {}).items():
                    if start < begin and (most is None or no - at <= most):
                        key, own = ((start, part), own + good) if table is near else ((start, begin), good)
                        chains[key] = max(chains.get(key, (0, 0)), (agree + good, own))
            for (start, part), (agree, own) in chains.items():
                sound = (own >= FAR_WORDS or firmly) and own * 5 >= (end - part) * 4
                if (sound or part == start) and agree * 5 >= (end - start) * 4:
                    best = max(best, end - start)
                new.append((end, (start, part), firmly, ends, sound, (agree, own, no)))
        for end, key, firmly, ends, sound, chain in new:
            keep(near, LINES_BETWEEN, end, key, chain)
            if sound and ends:
                keep(edge, None, end, key, chain)
            if sound and firmly:
                keep(firm, None, end, key, chain)
    return best

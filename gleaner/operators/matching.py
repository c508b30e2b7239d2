"""Sequential algorithms over small groups: assignment, alignment, stitching, greedy ideals. For applyInPandas."""

from __future__ import annotations

import re
from fractions import Fraction
from html import unescape
from html.parser import HTMLParser

import numpy as np


def assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Row-column pairs of the largest total score, by the Hungarian algorithm with potentials; only positive scores."""
    n, m = score.shape
    if not n or not m:
        return []
    if n > m:
        return sorted((i, j) for j, i in assignment(score.T))
    cost = -np.maximum(score, 0)
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[at] = True
            row = match[at]
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[row - 1, free - 1] - u[row] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], at
            to = free[np.argmin(least[free])]
            delta = least[to]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            at = to
            if match[at] == 0:
                break
        while at:
            match[at] = match[way[at]]
            at = way[at]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j] and score[match[j] - 1, j - 1] > 0)


def earliest_matching(allowed: list[list[tuple[int, Fraction]]], columns: int) -> list[tuple[int, int]]:
    """Matching of most pairs and, of those, least total delay; ties by the smaller column for the smaller row.

    allowed[i]: (column, delay) of row i. Exact: costs are integers after scaling by a common denominator.
    """
    scale = 1
    for row in allowed:
        for _, d in row:
            scale = scale * d.denominator // np.gcd(scale, d.denominator)
    rows = len(allowed)
    top = 1 + sum(int(max((d for _, d in row), default=Fraction(0)) * scale) for row in allowed)
    tie = (columns + 1) ** rows
    cost = {(i, j): int(d * scale) * tie + j * (columns + 1) ** (rows - 1 - i) for i, row in enumerate(allowed) for j, d in row}
    bonus = top * tie * 4
    match: dict[int, int] = {}
    # Successive cheapest augmenting paths (Bellman-Ford): after each, the matching is cheapest for its size.
    while True:
        dist = {("r", i): 0 for i in range(rows) if i not in match.values()}
        before: dict = {}
        for _ in range(2 * (rows + columns)):
            changed = False
            for (i, j), c in cost.items():
                if ("r", i) in dist and match.get(j) != i and dist[("r", i)] + c < dist.get(("c", j), bonus * (rows + 2)):
                    dist[("c", j)], before[("c", j)], changed = dist[("r", i)] + c, i, True
            for j, i in match.items():
                if ("c", j) in dist and dist[("c", j)] - cost[i, j] < dist.get(("r", i), bonus * (rows + 2)):
                    dist[("r", i)], before[("r", i)], changed = dist[("c", j)] - cost[i, j], j, True
            if not changed:
                break
        free = [(dist[("c", j)], j) for j in range(columns) if j not in match and ("c", j) in dist]
        if not free:
            return sorted((i, j) for j, i in match.items())
        j = min(free)[1]
        while True:
            i = before[("c", j)]
            previous = before.get(("r", i))
            match[j] = i
            if previous is None:
                break
            j = previous


def token_f1(a: list[str], b: list[str]) -> float:
    if not a and not b:
        return 1.0
    counts: dict[str, int] = {}
    for t in a:
        counts[t] = counts.get(t, 0) + 1
    common = 0
    for t in b:
        if counts.get(t, 0) > 0:
            counts[t] -= 1
            common += 1
    return 2 * common / (len(a) + len(b))


def align_spans(reference: list[list[str]], predicted: list[list[str]], threshold: float) -> list[tuple[int, int, int]]:
    """(reference, first, last + 1 predicted) matches in order, one reference to a run of predictions, of the largest
    total F1, then of most matches, then the earliest. A match needs F1 >= threshold."""
    n, m = len(reference), len(predicted)
    best: list[list[tuple]] = [[(0.0, 0, ()) for _ in range(m + 1)] for _ in range(n + 1)]
    key = lambda x: (-round(x[0], 12), -x[1], x[2])
    for i in range(n - 1, -1, -1):
        for j in range(m, -1, -1):
            options = [best[i + 1][j]] + ([best[i][j + 1]] if j < m else [])
            words: list[str] = []
            for e in range(j + 1, m + 1):
                words = words + predicted[e - 1]
                total = len(reference[i]) + len(words)
                if total and 2 * min(len(reference[i]), len(words)) / total < threshold:
                    if len(words) > len(reference[i]):
                        break
                    continue
                f1 = token_f1(reference[i], words)
                if f1 >= threshold:
                    rest = best[i + 1][e]
                    options.append((rest[0] + f1, rest[1] + 1, ((i, j, e), *rest[2])))
            best[i][j] = min(options, key=key)
    return list(best[0][0][2])


def edit_operations(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of one shortest edit; of equals the one with most substitutions."""
    n, m = len(reference), len(hypothesis)
    d = np.zeros((n + 1, m + 1), int)
    codes: dict[str, int] = {}
    r, h = (np.array([codes.setdefault(t, len(codes)) for t in side], int) for side in (reference, hypothesis))
    place = np.arange(m + 1)
    d[:, 0], d[0, :] = np.arange(n + 1), place
    for i in range(1, n + 1):
        # A row at a time: insertions carry the least of what stands to the left, plus the distance.
        d[i, 1:] = np.minimum(d[i - 1, :-1] + (h != r[i - 1]), d[i - 1, 1:] + 1)
        d[i] = np.minimum.accumulate(d[i] - place) + place
    i, j, s, x, y = n, m, 0, 0, 0
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (reference[i - 1] != hypothesis[j - 1]):
            s += reference[i - 1] != hypothesis[j - 1]
            i, j = i - 1, j - 1
        elif i and d[i, j] == d[i - 1, j] + 1:
            x, i = x + 1, i - 1
        else:
            y, j = y + 1, j - 1
    return int(s), x, y


def greedy_ideal(units: list[frozenset], k: int, alpha: float = 0.5) -> float:
    """alpha-DCG of the greedy ideal ranking; of equal gains the smaller index goes first."""
    seen: dict = {}
    left, total = set(range(len(units))), 0.0
    for place in range(1, min(k, len(units)) + 1):
        gain, i = max(((sum((1 - alpha) ** seen.get(u, 0) for u in units[i]), -i) for i in left), default=(0.0, 0))
        left.discard(-i)
        for u in units[-i]:
            seen[u] = seen.get(u, 0) + 1
        total += gain / np.log2(place + 1)
    return float(total)


def stitch(left: list[str], right: list[str], most: int = 64) -> int:
    """Tokens of the longest suffix of left, at most `most`, that right begins with."""
    for n in range(min(most, len(left), len(right)), 0, -1):
        if left[-n:] == right[:n]:
            return n
    return 0


def representatives(items: list[list[str]], threshold: float = 0.95) -> list[int]:
    """For each item the first earlier representative that is at least `threshold` alike in F1, else itself."""
    chosen: list[int] = []
    out = []
    for i, tokens in enumerate(items):
        near = next((r for r in chosen if token_f1(items[r], tokens) >= threshold), None)
        if near is None:
            chosen.append(i)
        out.append(i if near is None else near)
    return out


def keyframes(times: list[float], changes: list[float], interval: float, threshold: float, policy: str) -> list[int]:
    """Frames that a policy picks: fixed (so long after the last pick), scene (a change beyond the threshold), hybrid."""
    out: list[int] = []
    for i, (t, c) in enumerate(zip(times, changes, strict=True)):
        due = not out or t - times[out[-1]] >= interval
        scene = not out or c >= threshold
        if due if policy == "fixed" else scene if policy == "scene" else due or scene:
            out.append(i)
    return out


_THINK, _THINK_END = re.compile(r"<(/?)think>", re.I), re.compile(r"<think>\s*\Z", re.I)


def visible_answer(text: str, prompt: str = "") -> tuple[str, str]:
    """What an answer shows and what it thinks: text outside and inside <think> sections, nested ones too, in any case.

    A section is open from the start if the prompt ends with its tag, or if the text only closes sections.
    """
    tags = [(m.start(), m.end(), 1 if m[1] == "" else -1) for m in _THINK.finditer(text)]
    opens = bool(_THINK_END.search(prompt)) or any(t < 0 for *_, t in tags) and not any(t > 0 for *_, t in tags)
    depth, at, parts = int(opens), 0, ([], [])
    for start, end, turn in [*tags, (len(text), len(text), 0)]:
        parts[depth > 0].append(text[at:start])
        depth, at = max(0, depth + turn), end
    return "".join(parts[0]).strip(), "".join(parts[1]).strip()


class TableParser(HTMLParser):
    """Cells of all tables of a page: (table, row, column, rowspan, colspan, header, text), slots taken by spans skipped."""

    MOST = 100_000

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple] = []
        self.table, self.row, self.column, self.open = -1, -1, 0, None
        self.taken: set[tuple[int, int]] = set()
        self.slots = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self._close()
            self.table, self.row, self.taken, self.slots = self.table + 1, -1, set(), 0
        elif tag == "tr" and self.table >= 0:
            self._close()
            self.row, self.column = self.row + 1, 0
        elif tag in ("td", "th") and self.row >= 0:
            self._close()
            rows = columns = 1
            if attrs:
                span = lambda name: max(1, min(1000, int(v))) if (v := dict(attrs).get(name) or "1").isdigit() else 1
                rows, columns = span("rowspan"), span("colspan")
            while (self.row, self.column) in self.taken:
                self.column += 1
            if self.slots + rows * columns > self.MOST:
                raise ValueError("a table has too many slots")
            if rows == 1 and not self.taken:
                self.slots += columns
            else:
                mine = {(self.row + i, self.column + j) for i in range(rows) for j in range(columns)} - self.taken
                self.slots += len(mine)
                self.taken |= mine if rows > 1 else set()  # only slots of rows to come can be met again
            self.open = [self.table, self.row, self.column, rows, columns, tag == "th", ""]
            self.column += columns

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[6] += data

    def _close(self) -> None:
        if self.open:
            self.cells.append((*self.open[:6], " ".join(self.open[6].split())))
            self.open = None


#: Text and the tag after it, of the plainest kind: simple attributes, nothing else within the tag.
_PLAIN_TAG = re.compile(r"""([^<]*)<(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \t\n\r\f]+[A-Za-z]+=(?:[A-Za-z0-9]+|"[A-Za-z0-9 ]*"))*)[ \t\n\r\f]*>""")
_PLAIN_ATTRIBUTE = re.compile(r"""([A-Za-z]+)=(?:([A-Za-z0-9]+)|"([A-Za-z0-9 ]*)")""")
#: Elements whose content is no markup, or that change how the rest is read.
_RAW_TAGS = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"))


def _plain_tags(html: str) -> list[tuple[str, str, str, str]] | None:
    """(text before, slash, name in lower case, attributes) of all tags, if every < of a page opens a plain tag; else None."""
    found = [(text, slash, name.lower(), attributes) for text, slash, name, attributes in _PLAIN_TAG.findall(html)]
    if len(found) != html.count("<") or any(name in _RAW_TAGS or slash and attributes for _, slash, name, attributes in found):
        return None
    return found


def html_cells(html: str) -> list[tuple]:
    """Cells of all tables of a page, see TableParser. Pages of plain tags are cut by one expression instead of tag by tag."""
    if "<table" not in html.lower():
        return []
    parser, tags = TableParser(), _plain_tags(html)
    if tags is None:
        parser.feed(html)
        parser.close()
    else:
        for text, slash, name, attributes in tags:
            if text and parser.open:
                parser.open[6] += unescape(text) if "&" in text else text
            if name in ("td", "th", "tr", "table"):
                if slash:
                    if parser.open:
                        parser._close()
                else:
                    parser.handle_starttag(name, [(k.lower(), v or w) for k, v, w in _PLAIN_ATTRIBUTE.findall(attributes)] if attributes else [])
        if parser.open:
            parser.handle_data(unescape(html[_PLAIN_TAG.match(html, html.rfind("<")).end() :]))
    parser._close()
    return parser.cells

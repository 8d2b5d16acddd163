"""Plain Python versions of what the document operators return."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SMALL = "/root/testdata/sf0.001"

BLANKS = "[^\x20\x09-\x0d]+"
ALNUM = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, width=5):
    words = re.findall(BLANKS, lower(text))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def linked(sets: dict, percent: int) -> Union:
    """Union of the keys whose sets are similar; all pairs that share an element are compared."""
    union, where = Union(), defaultdict(list)
    for key, found in sets.items():
        union.find(key)
        common = Counter(other for x in found for other in where[x])
        for other, n in common.items():
            if 100 * n >= percent * (len(found) + len(sets[other]) - n):
                union.join(key, other)
        for x in found:
            where[x].append(key)
    return union


def components(rows, percent=85):
    """{row number: (n_shingles, component_id)} for (doc_id, text) rows with ids."""
    sets = {k: shingles(text) for k, (_, text) in enumerate(rows)}
    union = linked({k: s for k, s in sets.items() if s and rows[k][0] is not None}, percent)
    smallest = {}
    for k, s in sets.items():
        if s and rows[k][0] is not None:
            root = union.find(k)
            smallest[root] = min(smallest.get(root, rows[k][0]), rows[k][0])
    return {k: (len(s), smallest[union.find(k)] if s and rows[k][0] is not None else rows[k][0]) for k, s in sets.items()}


def contamination(text, items, width=10):
    """n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = defaultdict(set)
    for item, passage in items:
        words = re.findall(ALNUM, lower(passage))
        if item is None or passage is None or not words:
            continue
        for i in range(max(len(words) - width, 0) + 1):
            windows[tuple(words[i : i + width])].add(str(item))
    words = re.findall(ALNUM, lower(text))
    hit, found = set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found |= windows[tuple(words[i : i + size])]
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def normal(line):
    return " ".join(w for w in re.split("[ \t-\r]+", lower(line)) if w)


def line_set(line, width=10):
    return frozenset(line[i : i + width] for i in range(max(len(line) - width, 0) + 1))


def deduplicated(rows, percent=80):
    """The texts left of (doc_id, text) rows with ids of their own."""
    places = defaultdict(list)
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n") if doc is not None else []):
            if normal(line):
                places[normal(line)].append((doc, i))
    union = linked({line: line_set(line) for line in places}, percent)
    first = {}
    for line, found in places.items():
        root = union.find(line)
        first[root] = min(first.get(root, min(found)), min(found))
    gone = {at for line, found in places.items() for at in found if at != first[union.find(line)]}
    return [
        text if text is None else "\n".join(line for i, line in enumerate(text.split("\n")) if (doc, i) not in gone)
        for doc, text in rows
    ]


def rule_counts(text):
    text = text or ""
    words = re.findall(BLANKS, text)
    lines = [line for line in text.split("\n") if re.search(BLANKS, line)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, dup, len(inside), failed


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def phrase_places(text):
    words = re.findall(ALNUM, lower(text))
    found = []
    for phrase, label in PHRASES.items():
        size = len(phrase.split())
        found += [(i, label) for i in range(len(words) - size + 1) if words[i : i + size] == phrase.split()]
    return len(words), found


def base_secrets(text):
    text = text or ""
    found = []
    assign = re.compile(
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
    )
    found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{('assign', 'access', 'hex')[kind]}:{a}:{b}" for a, kind, b in sorted(found)]


def prose(n, seed=0):
    """n words, few of them alike."""
    words, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        words.append("w" + str(x % 100_003))
    return " ".join(words)

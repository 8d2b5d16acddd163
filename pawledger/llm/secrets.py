"""Secrets in documents: fixed patterns, and a character convolution over everything else.

Candidates are the matches of the fixed patterns and all runs of secret-like characters that change
between lower case, upper case and digits, or are long and not a plain sequence. A small
convolutional network reads each candidate and the text around it, a long one in overlapping pieces
of which the largest score counts. It
is trained on labelled findings of a bounded sample: matches of the patterns and keys made up by
rule in well-known forms; words, harmless runs made up by rule and those runs of the sample that do
not look like keys are the negatives: a run that does is unlabelled, as it may be a secret that no
pattern knows. Its scores are calibrated on findings held out. The threshold is the largest, up to
one half, that keeps the recall asked for of each form, on keys made up afresh inside texts of the
sample; those that are no candidates count as lost.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .columns import hash_sample
from .store import Shipped
from .words import LOWER, UPPER, blocks, text_buffers, word_bounds

# The patterns and their least lengths.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

KINDS = ("assign", "access", "hex", "model")
HEX = np.isin(UPPER, list(b"0123456789abcdef"))
TOKEN = np.isin(UPPER, list((string.ascii_letters + string.digits + "+/_.=-").encode()))
#: 1, 2, 3 for lower case, upper case and digits, 0 for all else.
CLASS = sum(k * np.isin(UPPER, list(letters.encode())) for k, letters in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits), 1)).astype(np.int8)
#: A run is a candidate from so many characters and changes of class between neighbours on; or
#: from so many characters and changes of the step between neighbours on: a character over and
#: over, or a part of the alphabet, has one step.
RUN_LEAST, CHANGES_LEAST = 8, 2
PLAIN_LEAST, STEPS_LEAST = 16, 4

BEFORE, INSIDE, AFTER = 24, 40, 16
WIDTH = BEFORE + INSIDE + AFTER
EMBED, FILTERS, REACH = 8, 16, 5
#: Bounds of the training sample: documents, their length, findings of each label, findings made up.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, SAMPLE_FINDINGS, SAMPLE_MADE = 2000, 20_000, 600, 1600
RECALL = 0.95
#: Keys of each form that set the threshold.
CHECKED = 40
#: Letters and digits from so many on that change class in a quarter of the steps look like a key.
STRETCH = 12

BASE62 = string.ascii_letters + string.digits
LOWER36 = string.ascii_lowercase + string.digits
#: Heads, characters and lengths of keys made up.
FORMS = (
    ("ghp_", BASE62, 36), ("sk-", BASE62, 48), ("xoxb-", string.digits + "-", 24), ("eyJ", BASE62 + "_-", 60),
    ("", BASE62 + "+/", 40), ("AIza", BASE62 + "_-", 35), ("", BASE62, 16), ("", string.ascii_letters, 24), ("", BASE62, 10),
    ("sk_live_", BASE62, 24), ("glpat-", BASE62 + "_-", 20), ("npm_", BASE62, 36), ("SG.", BASE62 + "_-", 22),
    ("", LOWER36, 32), ("", BASE62, 32), ("pk_test_", LOWER36, 24),
)
HEADS = tuple(head.encode() for head, _, _ in FORMS if head)


def candidates(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) in bytes for each text, kinds as in KINDS; runs are of kind 3."""
    data, bounds = text_buffers(texts)
    found: list[list] = [[] for _ in range(len(texts))]
    raw, lower = data.tobytes(), LOWER[data].tobytes()
    for words, pattern, kind in ((KEYWORDS, ASSIGN, 0), ((b"AKIA",), ACCESS, 1)):
        rows = set()
        for word in words:
            hay, at = (lower if kind == 0 else raw), -1
            while (at := hay.find(word, at + 1)) >= 0:
                row = int(np.searchsorted(bounds, at, side="right")) - 1
                rows.add(row)
                at = int(bounds[row + 1]) - 1
        for row in rows:
            text = raw[bounds[row] : bounds[row + 1]]
            for match in pattern.finditer(text):
                size = len(match[2]) if kind == 0 else match.end() - match.start()
                if size >= (ASSIGN_LEAST if kind == 0 else ACCESS_LEAST):
                    found[row].append((kind, match.start(), match.end()))
    for table, least, kind in ((HEX, HEX_LEAST, 2), (TOKEN, RUN_LEAST, 3)):
        starts, ends, _ = word_bounds(data, bounds, table)
        long_runs = ends - starts >= least
        starts, ends = starts[long_runs], ends[long_runs]
        if kind == 3 and len(starts):
            odd = odd_runs(data, starts, ends)
            starts, ends = starts[odd], ends[odd]
        rows = np.searchsorted(bounds, starts, side="right") - 1
        base = [Inside(spans) for spans in found] if kind == 3 else []
        for row, start, end in zip(rows.tolist(), starts.tolist(), ends.tolist()):
            at = int(bounds[row])
            span = (kind, start - at, end - at)
            if kind < 3 or not base[row].holds(*span[1:]):
                found[row].append(span)
    return found


class Inside:
    """Tells whether a span lies inside one of some spans, by a binary search."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in ordered]
        self.ends = list(accumulate((b for _, b in ordered), max))

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return k > 0 and self.ends[k - 1] >= end


def odd_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which runs change class or step often enough to be candidates."""
    kind = CLASS[data]
    # changes[i]: of the class from character i - 1 to i; turns[i]: of the step at character i - 1.
    changes, turns = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    changes[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    step = np.diff(data.astype(np.int16))
    turns[2:] = step[1:] != step[:-1]
    changes, turns = np.cumsum(changes), np.cumsum(turns)
    mixed = changes[ends - 1] - changes[starts] >= CHANGES_LEAST
    return mixed | ((ends - starts >= PLAIN_LEAST) & (turns[ends - 1] - turns[starts + 1] >= STEPS_LEAST))


def pieces(spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """The spans cut into overlapping parts of up to INSIDE bytes, the last at the span's end, and
    the number of the span of each."""
    out, owner = [], []
    for k, (kind, start, end) in enumerate(spans):
        last = max(end - INSIDE, start)
        for at in (*range(start, last, INSIDE // 2), last):
            out.append((kind, at, min(at + INSIDE, end)))
            owner.append(k)
    return out, np.array(owner, np.int64)


def views(text: bytes, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Character numbers (0 beyond the text, 1-95 printable ASCII, 96 others) around each span, and
    128 more inside the span."""
    out = np.zeros((len(spans), WIDTH), np.uint8)
    for k, (_, start, end) in enumerate(spans):
        for place, piece, inside in (
            (max(BEFORE - start, 0), text[max(start - BEFORE, 0) : start], 0),
            (BEFORE, text[start : min(end, start + INSIDE)], 128),
            (BEFORE + INSIDE, text[end : end + AFTER], 0),
        ):
            letters = np.frombuffer(piece, np.uint8)
            letters = np.where((letters >= 32) & (letters < 127), letters - 31, 96)
            out[k, place : place + len(letters)] = letters + inside
    return out


@dataclass
class Model:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def forward(self, windows: np.ndarray) -> tuple:
        x = self.embed[windows & 127]
        x = np.concatenate((x, (windows >= 128)[..., None].astype(np.float32)), axis=2)
        view = np.lib.stride_tricks.sliding_window_view(x, REACH, axis=1)
        view = view.transpose(0, 1, 3, 2).reshape(len(x), WIDTH - REACH + 1, -1)
        hidden = np.maximum(view @ self.filters + self.bias, 0)
        best = hidden.argmax(axis=1)
        pooled = np.take_along_axis(hidden, best[:, None], axis=1)[:, 0]
        return view, best, pooled, pooled @ self.out + self.out_bias[0]

    def scores(self, windows: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        logit = self.logits(windows)
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -50, 50)))

    def logits(self, windows: np.ndarray) -> np.ndarray:
        found = [self.forward(windows[i : i + 512])[3] for i in range(0, len(windows), 512)]
        return np.concatenate(found) if found else np.zeros(0, np.float32)

    def best(self, text: bytes, spans: list[tuple[int, int, int]]) -> np.ndarray:
        """The largest score of the pieces of each span."""
        out = np.zeros(len(spans))
        cut, owner = pieces(spans)
        for i in range(0, len(cut), 4096):
            np.maximum.at(out, owner[i : i + 4096], self.scores(views(text, cut[i : i + 4096])))
        return out


def train(
    windows: np.ndarray, labels: np.ndarray, recall: float = RECALL, epochs: int = 12, seed: int = 5, owner: np.ndarray | None = None, missed: int = 0
) -> Model:
    """Fit by Adam on four fifths; calibrate and set the threshold on the rest.

    `owner` is the finding of each window: of several, the one of the largest score counts. `missed`
    secrets were never candidates; the threshold makes up for them as far as it can.
    """
    owner = np.arange(len(labels)) if owner is None else owner
    rng = np.random.default_rng(seed)
    channels = (EMBED + 1) * REACH
    model = Model(
        rng.normal(0, 0.3, (128, EMBED)).astype(np.float32),
        rng.normal(0, 0.15, (channels, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, FILTERS).astype(np.float32),
        np.zeros(1, np.float32),
    )
    if not len(labels) or labels.min() == labels.max():
        return model
    order = rng.permutation(len(labels))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    parts = ["embed", "filters", "bias", "out", "out_bias"]
    moments = {p: (np.zeros_like(getattr(model, p)), np.zeros_like(getattr(model, p))) for p in parts}
    step = 0

    def strongest() -> tuple[np.ndarray, np.ndarray]:
        """The window of the largest score of each finding, and its logit."""
        logit = model.logits(windows)
        order = np.lexsort((logit, owner))
        top = order[np.searchsorted(owner[order], np.arange(len(labels)), side="right") - 1]
        return top, logit[top]

    for _ in range(epochs):
        top, _ = strongest()
        for batch in np.array_split(rng.permutation(fit), max(len(fit) // 64, 1)):
            x, y = windows[top[batch]], labels[batch].astype(np.float32)
            view, best, pooled, logit = model.forward(x)
            error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y) / len(batch)
            d_pool = error[:, None] * model.out * (pooled > 0)
            chosen = np.take_along_axis(view, best[:, :, None], axis=1)
            grads = {"out": pooled.T @ error, "out_bias": np.array([error.sum()]), "bias": d_pool.sum(axis=0)}
            grads["filters"] = np.einsum("nf,nfc->cf", d_pool, chosen)
            d_view = (d_pool[:, :, None] * model.filters.T).reshape(len(batch), FILTERS, REACH, EMBED + 1)[..., :EMBED]
            places = best[:, :, None] + np.arange(REACH)
            letters = np.take_along_axis(x & 127, places.reshape(len(batch), -1), axis=1)
            grads["embed"] = np.zeros_like(model.embed)
            np.add.at(grads["embed"], letters.ravel(), d_view.reshape(-1, EMBED))
            step += 1
            for p in parts:
                one, two = moments[p]
                one += 0.1 * (grads[p] - one)
                two += 0.001 * (grads[p] ** 2 - two)
                value = getattr(model, p)
                value -= (0.01 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    logit, y = strongest()[1][held], labels[held]
    if len(held) and 0 < y.sum() < len(y):
        calibrate(model, logit, y)
        kept = np.sort(1 / (1 + np.exp(-np.clip(model.scale * logit + model.shift, -50, 50)))[y == 1])
        lost = missed * len(held) / len(labels)
        model.threshold = float(min(kept[max(int((1 - recall) * (len(kept) + lost) - lost), 0)], 0.5))
    return model


def calibrate(model: Model, logit: np.ndarray, y: np.ndarray, rounds: int = 200) -> None:
    """Platt scaling by gradient descent, with softened labels."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    spread = max(float(np.abs(logit).max()), 1.0)
    a, b = 1.0 * spread, 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(a * logit / spread + b, -50, 50))) - target
        a -= 2.0 * float((error * logit / spread).mean())
        b -= 2.0 * float(error.mean())
    model.scale, model.shift = a / spread, b


def made_up(rng: np.random.Generator, n: int) -> list[bytes]:
    """Random keys, of each of FORMS in turn."""
    keys = []
    for k in range(n):
        head, letters, size = FORMS[k % len(FORMS)]
        keys.append((head + "".join(rng.choice(list(letters), size))).encode())
    return keys


def looks_like_key(run: bytes) -> bool:
    """Whether a part of a run has a key's head, or its longest stretch of letters and digits changes
    between lower case, upper case and digits as often as random ones do."""
    if any(part.startswith(HEADS) for part in re.split(rb"[/=]+", run)):
        return True
    stretch = max(re.split(rb"[+/_.=-]+", run), key=len)
    kind = CLASS[np.frombuffer(stretch, np.uint8)]
    return len(stretch) >= STRETCH and 4 * np.count_nonzero(kind[1:] != kind[:-1]) >= len(stretch) - 1


def placed(rng: np.random.Generator, texts: list[str], runs: list[bytes], paths: bool = False, among: bool = False) -> list[tuple[bytes, tuple] | None]:
    """Each run put between two words of a text: the text around it and its span, or None if it is no
    candidate there. With `paths`, every fifth run is the end of a path; with `among`, every third one
    stands among harmless runs in place of the text."""
    out = []
    for k, run in enumerate(runs):
        raw = texts[k % len(texts)].encode()
        cut = raw.find(b" ", int(rng.integers(len(raw)))) + 1
        head = harmless(rng, 8)[7] + b"/key=" if paths and k % 5 == 4 else b""
        before, after = raw[max(cut - 200, 0) : cut], raw[cut : cut + 200]
        if among and k % 3 == 1:
            some = harmless(rng, 9) if k % 2 else [harmless(rng, 9)[8] for _ in range(9)]
            before, after = b" ".join(some[:5]) + b" ", b" ".join(some[5:])
        near = before + head
        text, end = near + run + b" " + after, len(near) + len(run)
        # Other bytes are no part of a run: one character each keeps the places.
        (spans,) = candidates(pa.array([re.sub(rb"[\x80-\xff]", b"?", text).decode()], pa.string()))
        whole = [s for s in spans if s[1] <= len(near) and end <= s[2]]
        out.append((text, max(whole)) if whole else None)
    return out


def threshold(model: Model, found: list[tuple[bytes, tuple] | None], recall: float) -> float:
    """The largest threshold, up to one half, at which that share of each of FORMS is found; the keys
    are of each form in turn."""
    scores = np.array([-1.0 if one is None else model.best(one[0], [one[1]])[0] for one in found])
    lowest = 0.5
    for form in range(len(FORMS)):
        own = scores[form :: len(FORMS)]
        seen = np.sort(own[own >= 0])
        lost, may_miss = len(own) - len(seen), int((1 - recall) * len(own))
        if lost > may_miss:
            # The recall cannot be had; it is kept among the candidates of this form.
            may_miss, lost = int((1 - recall) * len(seen)), 0
        if len(seen):
            lowest = min(lowest, float(seen[may_miss - lost]))
    return lowest


def harmless(rng: np.random.Generator, n: int) -> list[bytes]:
    """Random runs with digits that are no keys: times, hosts, paths, versions, names."""
    word = lambda: "".join(rng.choice(list(string.ascii_lowercase), int(rng.integers(3, 9))))
    number = lambda a, b: str(int(rng.integers(a, b)))
    forms = (
        lambda: f"20{number(10, 30)}-{number(10, 13)}-{number(10, 29)}T{number(10, 24)}",
        lambda: f"{word()}{number(1, 99)}.{word()}.{word()}.com",
        lambda: f"/{word()}/{word()}/{word()}-{number(100, 99999)}.html",
        lambda: f"{word()}-{word()}-v{number(1, 9)}.{number(10, 99)}.{number(0, 9)}.tar.gz",
        lambda: f"{word()}_{word()}_{word()}_{number(100, 999999)}",
        lambda: f"{word()}={number(1000, 99999)}.{number(10, 99)}",
        lambda: f"{word()}{word().title()}{word().title()}",
        lambda: f"{word()}/{word()}/{word()}_{word()}/{word()}-{word()}/{word()}/{word()}.{word()}",
        lambda: f"{word()[:int(rng.integers(1, 9))]}{number(10, 999999)}",
    )
    return [forms[k % len(forms)]().encode() for k in range(n)]


def fitted(documents: DataFrame, seed: int = 5) -> Model:
    """Train on the findings of a bounded sample: about SAMPLE_DOCUMENTS documents of up to
    SAMPLE_CHARS characters, those with the smallest hashes."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(f"length(text) between 1 and {SAMPLE_CHARS}")
    sample = hash_sample(rows, ["doc_id", "text"], SAMPLE_DOCUMENTS)
    texts = sorted(r.text for r in sample.select("text").collect())
    rng = np.random.default_rng(seed)
    good, bad, plain = [], [], []
    for text, spans in zip(texts, candidates(pa.array(texts, pa.string()))):
        raw = text.encode()
        base = [s for s in spans if s[0] < 3]
        if len(good) < SAMPLE_FINDINGS and base:
            good += [(raw, s) for s in base]
        if len(bad) < SAMPLE_FINDINGS and len(spans) > len(base):
            bad += [(raw, s) for s in spans if s[0] == 3 and not looks_like_key(raw[s[1] : s[2]])]
        if len(plain) < SAMPLE_FINDINGS:
            words = [m for m in re.finditer(rb"[A-Za-z0-9+/_.=-]{8,}", raw) if not any(a < m.end() and m.start() < b for _, a, b in spans)]
            if words:
                word = words[int(rng.integers(len(words)))]
                plain.append((raw, (3, word.start(), word.end())))
    made = SAMPLE_MADE if texts else 0
    good += [one for one in placed(rng, texts, made_up(rng, made), paths=True, among=True) if one]
    bad += [one for one in placed(rng, texts, harmless(rng, made), among=True) if one]
    found = good + bad + plain
    windows, owner = [np.zeros((0, WIDTH), np.uint8)], []
    for k, (raw, span) in enumerate(found):
        cut, _ = pieces([span])
        windows.append(views(raw, cut))
        owner += [k] * len(cut)
    labels = np.array([1] * len(good) + [0] * (len(found) - len(good)))
    model = train(np.concatenate(windows), labels, epochs=40, seed=seed, owner=np.array(owner, np.int64))
    if texts:
        model.threshold = threshold(model, placed(rng, texts, made_up(rng, CHECKED * len(FORMS)), paths=True), RECALL)
    return model


def secrets(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans, top_score for each row.

    Spans are kind:start:end in characters (end exclusive), by start, then kind, comma-joined;
    base_sha256 is the digest of those of the fixed patterns alone, which stay whatever the model
    says. Runs inside such a span are not reported again. Null and empty texts have no spans.
    Repeated rows and rows without an id are scanned each. Other columns are ignored; an empty
    table gives no rows.
    """
    shared = Shipped(documents.sparkSession, model or fitted(documents))

    def work(batches):
        model = shared.value
        for batch in blocks(batches):
            data, bounds = text_buffers(batch.column(1))
            found = candidates(batch.column(1))
            rows = [k for k, spans in enumerate(found) if spans]
            texts = {k: data[bounds[k] : bounds[k + 1]].tobytes() for k in rows}
            counts, top = np.zeros((batch.num_rows, 4), np.int64), np.zeros(batch.num_rows)
            spans, base = [""] * batch.num_rows, [""] * batch.num_rows
            for k in rows:
                own = model.best(texts[k], found[k])
                kept = sorted((a, kind, b) for (kind, a, b), score in zip(found[k], own) if kind < 3 or score >= model.threshold)
                before = np.concatenate(([0], np.cumsum((np.frombuffer(texts[k], np.uint8) & 0xC0) != 0x80)))
                names = [(kind, f"{KINDS[kind]}:{before[a]}:{before[b]}") for a, kind, b in kept]
                for kind, _ in names:
                    counts[k, kind] += 1
                spans[k] = ",".join(name for _, name in names)
                base[k] = ",".join(name for kind, name in names if kind < 3)
                top[k] = own.max()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(counts[:, kind]) for kind in range(4)],
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                    pa.array(spans, pa.string()),
                    pa.array(top),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans", "top_score"],
            )

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        work, "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string, top_score double"
    )

"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two units (a word, or letters spelled out) sums, over all
subsequences of three letters that both hold, a decay by the span each takes,
and is scaled so that a unit's kernel with itself is 1; so gaps and inserted
characters cost little. A sentence is as toxic as its worst unit; a text is
judged by its three worst sentences.

Training is multiple-instance, on the sentences of labelled texts: all of a
clean text's sentences are clean, a toxic text's worst ones are toxic, in
turns. How much the three worst sentences weigh is learned from texts that
the machine hasn't seen, by halves.

Since the kernel is an inner product over subsequences, the machine over the
landmarks folds into one table, so scoring is exact and costs a look-up per
subsequence.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import quoted

DECAY, SPAN, WIDTH = 0.6, 7, 24
#: Classes of letters: 0 is a unit's edge, 1 to 26 are a to z with or without accents, the others share the rest.
CLASSES = 64
LETTERS = "abcdefghijklmnopqrstuvwxyz"
WORST = 3
#: A unit seen in so many toxic texts is trusted fully, in fewer the less.
ENOUGH = 10
_SPELLED = re.compile(r"(?<!\S)(?:\S[ .*_-]){3,}\S(?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+(?:\s+|$)|\n")
_LOOKS = dict(zip(map(ord, "0134578@$"), "oieastbas", strict=True))


class _Letters(dict):
    """Characters to their class as code points from 1 on; marks vanish."""

    def __missing__(self, c: int):
        ch = _LOOKS.get(c) or unicodedata.normalize("NFD", chr(c))[0]
        got = ord(ch) - 96 if "a" <= ch <= "z" else 27 + ord(ch) * 2654435761 % 2**32 * (CLASSES - 27) // 2**32 if ch.isalpha() else None
        self[c] = got
        return got


_letters = _Letters()


def units(sentence: str) -> set[str]:
    """What a sentence is judged by: its words in lower case, and letters spelled out with marks or spaces between them."""
    sentence = sentence.lower()
    found = set(sentence.split())
    for m in _SPELLED.findall(sentence):
        found.add("".join(x for x in m if x not in " .*_-"))
    return found


def bag(text: str | None) -> list[set[str]]:
    """The sentences of a text, by their units. Letters spelled out across sentence ends make a sentence of their own."""
    text = (text or "").lower()
    found = [set(s.split()) for s in _SENTENCE.split(text) if s and not s.isspace()]
    found += [{"".join(x for x in m if x not in " .*_-")} for m in _SPELLED.findall(text)]
    return found


@lru_cache(maxsize=64)
def _places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all subsequences of three in n letters with a span of at most SPAN: the places and the decay."""
    at = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]
    i, j, k = np.array(at or [(0, 0, 0)]).T
    return i, j, k, DECAY ** (k - i + 1).astype(float) if at else np.zeros(1)


def _coded(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of units of one length: which unit, the code of each subsequence, and its decay over the unit's norm. Longer units are cut into overlapping windows."""
    by: dict[int, tuple[list[int], list[bytes]]] = {}
    for at, w in enumerate(words):
        s = w.translate(_letters).encode("latin-1")
        parts = [s] if len(s) <= WIDTH else [s[x : x + WIDTH] for x in range(0, len(s) - WIDTH // 2, WIDTH // 2)]
        for p in parts:
            ids, codes = by.setdefault(len(p), ([], []))
            ids.append(at)
            codes.append(b"\0" + p + b"\0")
    for n, (ids, codes) in by.items():
        i, j, k, decay = _places(n + 2)
        letters = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), n + 2).astype(np.int32)
        for x in range(0, len(ids), 4000):
            c = letters[x : x + 4000]
            code = (c[:, i] * CLASSES + c[:, j]) * CLASSES + c[:, k]
            yield np.array(ids[x : x + 4000]), code, decay / _norms(code, decay)[:, None]


def _norms(code: np.ndarray, decay: np.ndarray) -> np.ndarray:
    """Of each row the length of its feature vector, in which decays of equal codes add up."""
    order = np.argsort(code, axis=1, kind="stable")
    ordered, weight = np.take_along_axis(code, order, 1), decay[order]
    upto = np.cumsum(weight, axis=1)
    last = np.ones(code.shape, bool)
    last[:, :-1] = ordered[:, 1:] != ordered[:, :-1]
    # a run of equal codes sums to what is reached at its end less what was reached at the end of the run before
    ends = np.where(last, upto, 0.0)
    before = np.maximum.accumulate(ends, axis=1)
    before = np.concatenate([np.zeros((len(code), 1)), before[:, :-1]], axis=1)
    norm = np.sqrt((np.where(last, upto - before, 0.0) ** 2).sum(1))
    return np.where(norm > 0, norm, 1.0)


def _spread(words: list[str], column: np.ndarray, width: int) -> np.ndarray:
    """The units' feature vectors over the codes that have a column; for the few of training. Windows of a long unit add up."""
    out = np.zeros((len(words), width + 1), np.float32)
    for ids, code, decay in _coded(words):
        np.add.at(out, (np.repeat(ids, code.shape[1]), column[code].ravel()), decay.ravel())
    return out[:, :width]


@dataclass
class Model:
    """table: the machine's weight of each subsequence. A unit's value is its weighted sum plus bias, a text's score the logistic of its worst sentences' values by ``weigh``, plus ``cut``."""

    table: np.ndarray
    bias: float
    weigh: np.ndarray = field(default_factory=lambda: np.array([4.0] + [0.0] * (WORST - 1)))
    cut: float = 0.0

    def values(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), -np.inf)
        for ids, code, decay in _coded(words):
            np.maximum.at(out, ids, (self.table[code] * decay).sum(1))
        return np.where(np.isneginf(out), -1.0, out) + self.bias

    def score(self, worst: np.ndarray) -> np.ndarray:
        """Of rows of the values of the WORST worst sentences, worst first. A vector is taken for the worst alone."""
        if worst.ndim == 1:
            worst = np.stack([worst] + [np.full_like(worst, self.floor)] * (WORST - 1), axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(np.clip(worst, self.floor, 3.0) @ self.weigh + self.cut, -30, 30)))

    @property
    def floor(self) -> float:
        """The value of a sentence that isn't there."""
        return self.bias - 1.0


def worst_values(sentences: list[set[str]], value: dict[str, float], floor: float) -> list[float]:
    """The values of the WORST worst sentences, worst first; sentences with the same worst unit count once."""
    tops = {max(s, key=value.__getitem__) for s in sentences if s}
    found = sorted(map(value.__getitem__, tops), reverse=True)[:WORST]
    return found + [floor] * (WORST - len(found))


def _fit(words: list[str], y: np.ndarray, trust: np.ndarray, landmarks: list[str], epochs: int = 60, cost: float = 10.0) -> Model:
    """A linear machine on the Nyström features of the units, by dual coordinate descent."""
    there = np.unique(np.concatenate([code.ravel() for _, code, _ in _coded(landmarks)]))
    column = np.full(CLASSES**3, len(there), np.int32)
    column[there] = np.arange(len(there))
    marks = _spread(landmarks, column, len(there))
    values, vectors = np.linalg.eigh(marks @ marks.T + 1e-6 * np.eye(len(landmarks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    x = np.concatenate([_spread(words[a : a + 500], column, len(there)) @ marks.T for a in range(0, len(words), 500)]) @ root
    x = np.hstack([x, np.ones((len(x), 1))])
    limit = trust * np.where(y > 0, cost * max(1.0, (y < 0).sum() / max(1, (y > 0).sum())), cost)
    alpha, w, norm, order = np.zeros(len(y)), np.zeros(x.shape[1]), (x**2).sum(1), np.arange(len(y))
    random = np.random.default_rng(0)
    for _ in range(epochs):
        random.shuffle(order)
        moved = 0.0
        for i in order:
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / norm[i], 0.0), limit[i])
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if moved < 1e-3:
            break
    table = np.zeros(CLASSES**3, np.float32)
    table[there] = marks.T @ (root @ w[:-1])
    return Model(table, float(w[-1]))


def _learn(pos: list[list[set[str]]], neg: list[list[set[str]]], landmarks: int, rounds: int) -> Model:
    """The machine, from the sentences of toxic and of clean texts."""
    pos, neg = [sorted(set().union(*b)) for b in pos], [sorted(set().union(*b)) for b in neg]
    seen, clean = Counter(w for b in pos for w in b), Counter(w for b in neg for w in b)
    odds = {w: (n / len(pos)) / ((clean[w] + 0.5) / len(neg)) for w, n in seen.items()}
    # to begin with, each toxic text's unit of the best odds among those that are toxic again and again
    good = {max((w for w in b if not clean[w] or odds[w] > 20), key=lambda w: (seen[w], w), default=None) for b in pos} - {None}
    good = {w for w in good if seen[w] >= 2} or set(sorted(good)[:20])
    often = sorted((w for w, n in seen.items() if n >= 8 and not clean[w]), key=lambda w: (-seen[w], w))
    good |= set(often[:40])
    bad = {w for w, _ in clean.most_common(1500)} - good
    rest = sorted(set(clean) - bad - good)
    bad |= set(rest[:: max(1, len(rest) // 1500)])
    every = sorted(set(seen) | set(clean))
    model = None
    for turn in range(rounds):
        a, b = sorted(good, key=lambda w: (-seen[w], w)), sorted(bad)
        # the worst units again with a letter put in, so that such a letter isn't taken for another word
        firm = [w for w in a if seen[w] >= ENOUGH and 4 <= len(w) <= 14][:60]
        put = [w[:x] + LETTERS[(x * 7 + len(w) + turn * 11 + more * 5) % 26] + w[x:] for w in firm for x in range(1, len(w)) for more in range(2)]
        put = [w for w in dict.fromkeys(put) if w not in clean and w not in good]
        marks = list(dict.fromkeys([*a[: landmarks // 2], *b[:: max(1, len(b) // (landmarks // 2))][: landmarks // 2]]))
        words = [*a, *put, *b]
        y = np.array([1.0] * (len(a) + len(put)) + [-1.0] * len(b))
        trust = np.array([min(1.0, (seen[w] / ENOUGH) ** 2) for w in a] + [1.0] * (len(put) + len(b)))
        model = _fit(words, y, trust, marks)
        if turn == rounds - 1:
            break
        value = dict(zip(every, model.values(every), strict=True))
        for units_ in pos:  # the worst unit of a toxic text, unless clean texts have it
            top = max((w for w in units_ if not clean[w]), key=lambda w: (value[w], w), default=None)
            if top and (value[top] > -0.5 or not any(w in good for w in units_)):
                good.add(top)
        bad |= {w for w in clean if value[w] > -0.3 and w not in good}
        bad -= good
    return model


def _worst(model: Model, bags: list[list[set[str]]]) -> np.ndarray:
    every = sorted(set().union(*(s for b in bags for s in b)))
    value = dict(zip(every, model.values(every).tolist(), strict=True))
    return np.array([worst_values(b, value, model.floor) for b in bags]).reshape(-1, WORST)


def _weigh(worst: np.ndarray, y: np.ndarray, steps: int = 2000) -> tuple[np.ndarray, float]:
    """A logistic of the worst sentences' values, whose weights aren't negative; both labels weigh alike."""
    worst = np.clip(worst, -3.0, 3.0)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    w, cut = np.array([2.0] + [0.2] * (WORST - 1)), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(worst @ w + cut, -30, 30)))
        step = share * (p - y)
        w, cut = np.maximum(w - step @ worst, [0.5] + [0.0] * (WORST - 1)), cut - step.sum()
    return w, float(cut)


def train(texts: list[str | None], toxic: list[int], landmarks: int = 240, rounds: int = 3) -> Model:
    """A model of labelled texts, the same for the same texts in the same order. Without both labels all texts score low."""
    bags, y = [bag(t) for t in texts], np.array(toxic, float)
    if not (y > 0).any() or not (y == 0).any():
        return Model(np.zeros(CLASSES**3, np.float32), -1.0)
    learn = lambda at: _learn([bags[i] for i in at if y[i]], [bags[i] for i in at if not y[i]], landmarks, rounds)
    model = learn(range(len(bags)))
    halves = [[i for i in range(len(bags)) if i % 2 == h] for h in (0, 1)]
    if all(0 < y[h].sum() < len(h) for h in halves):
        # each half is judged by what the other has taught
        tops = [_worst(learn(halves[1 - h]), [bags[i] for i in halves[h]]) for h in (0, 1)]
        model.weigh, model.cut = _weigh(np.concatenate(tops), y[halves[0] + halves[1]])
    return model


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    most: int = 800,
    longest: int = 32_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fold: int = 5,
) -> list[tuple[int, str | None]]:
    """(label, text) of at most ``most`` toxic and twice as many clean documents, none held out, chosen by a hash of the id.

    Texts over ``longest`` bytes are left out and an id that repeats gives one
    text, so 3 * ``most`` * ``longest`` bytes bound what comes to the driver.
    Ids under both labels count as toxic; null ids and labels are left out.
    """
    id_ = F.col(quoted(id_col))
    ids = labels.where(id_.isNotNull() & F.col(quoted(label_col)).isin(0, 1)).where(F.crc32(id_.cast("string").cast("binary")) % fold != 0)
    ids = ids.groupBy(id_.alias("_id")).agg(F.max(quoted(label_col)).cast("int").alias("_y"))
    order = [F.xxhash64("_id"), F.col("_id")]
    ids = ids.where("_y = 1").orderBy(*order).limit(most).unionByName(ids.where("_y = 0").orderBy(*order).limit(2 * most))
    texts = docs.select(id_.alias("_doc"), F.col(quoted(text_col)).alias("_text"))
    texts = texts.where(F.octet_length(F.coalesce("_text", F.lit(""))) <= longest)
    rows = texts.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).groupBy("_id", "_y").agg(F.min("_text").alias("_text")).collect()
    return [(y, t) for _, y, t in sorted(rows, key=lambda r: r[0])]


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = 48_000_000) -> DataFrame:
    """A row for each row of docs: its id, score (0 to 1) and predicted (1 from 0.5 on).

    Null, empty and wordless texts score as a text without sentences; null ids
    stay null; repeated rows score alike; a very long text is scored whole; an
    empty table gives no rows; other columns are not carried. A worker keeps
    the values of units of about ``cache_bytes`` bytes.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        held = 0
        for b in batches:
            worst = []
            for at in range(0, b.num_rows, 500):
                bags = [bag(t) for t in b.column(1).slice(at, 500).to_pylist()]
                here = set().union(*(s for x in bags for s in x))
                new = list(here - known.keys())
                if new:
                    size = sum(map(len, new)) + 150 * len(new)
                    if held + size > cache_bytes:
                        known = {w: known[w] for w in here & known.keys()}
                        held = sum(map(len, known)) + 150 * len(known)
                    known.update(zip(new, model.values(new).tolist(), strict=True))
                    held += size
                worst += [worst_values(x, known, model.floor) for x in bags]
            score = model.score(np.array(worst, float).reshape(-1, WORST))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(run, f"{quoted(id_col)} {kind}, score double, predicted int")

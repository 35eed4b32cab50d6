"""Quality rules as a short-circuit cascade.

The rules' costs and rejection rates are estimated on a bounded sample of each
part of the table; then each document meets the rules in order of rejections
per cost and stops at the first that rejects it. The order changes the work,
never the verdict.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from pulseframe.llm.common import quoted

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SPACE = bytes(range(9, 14)) + b" "


class Text:
    """A text, with what rules share made once, when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def bytes(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.bytes.split()  # of bytes: at \\t \\n \\v \\f \\r and space alone

    @cached_property
    def ids(self) -> np.ndarray:
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, len(self.words))

    @cached_property
    def word_chars(self) -> int:
        """Code points in words."""
        return len(self.text) - (len(self.bytes) - len(self.bytes.translate(None, _SPACE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(_SYMBOLS.findall(self.text))

    @cached_property
    def n_dup_lines(self) -> int:
        """Lines with a word that equal an earlier line."""
        lines = [x for x in self.bytes.split(b"\n") if x.strip()]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.ids)


def repeat_words(ids: np.ndarray, width: int = 8) -> int:
    """Words in windows of ``width`` words that the text has twice or more, the first included."""
    if len(ids) <= width:
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, width)
    with np.errstate(over="ignore"):
        h = np.zeros(len(windows), np.uint64)
        for i in range(width):
            h = (h ^ windows[:, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    if not (windows[order[1:][same]] == windows[order[:-1][same]]).all():  # hashes that meet by chance
        _, of, count = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        twice = count[of.ravel()] > 1
    else:
        twice = np.zeros(len(windows), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def n_repeat_words(t: Text) -> int:
    return t.n_repeat_words


@dataclass(frozen=True)
class Rule:
    """``rejects`` says whether a text fails."""

    name: str
    rejects: Callable[[Text], bool] = field(repr=False)


#: The base rules, then those of the method's own verdict.
BASE = (
    Rule("few_words", lambda t: len(t.words) < 20),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 30 * len(t.words)),
)
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > len(t.words)),
    Rule("shouting", lambda t: 2 * len(_UPPER.findall(t.text)) > t.word_chars),
    Rule("exclamations", lambda t: 4 * t.bytes.count(b"!") > len(t.words)),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > 1 + t.bytes.count(b"\n")),
    Rule("word_length", lambda t: not 2 * len(t.words) <= t.word_chars <= 18 * len(t.words)),
)
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def order_rules(rules: tuple[Rule, ...], texts: list[str | None], known: Callable[[Text], object] | None = None) -> list[Rule]:
    """The rules by rejections per second on the sample, most first; rules that reject none there come last, cheapest first.

    Costs are taken with fresh texts, so a rule pays for what it derives, but
    for what ``known`` derives beforehand, which is there anyway. On an empty
    sample the order stays.
    """
    scored = []
    for at, rule in enumerate(rules):
        cost = rejected = 0
        for text in map(Text, texts):
            if known is not None:
                known(text)
            began = time.perf_counter()
            rejected += rule.rejects(text)
            cost += time.perf_counter() - began
        cost = cost / max(1, len(texts)) + 1e-9
        scored.append((-(rejected / max(1, len(texts))) / cost, cost if texts else at, at, rule))
    return [x[-1] for x in sorted(scored, key=lambda x: x[:3])]


def first_rejection(text: Text, cascade: list[Rule]) -> str | None:
    return next((r.name for r in cascade if r.rejects(text)), None)


def spread(column: pa.Array, most: int) -> list[str | None]:
    """At most ``most`` texts, evenly spaced over the column."""
    n = len(column)
    return [column[i * n // most].as_py() for i in range(most)] if n > most else column.to_pylist()


def filter_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE + RULES, sample_rows: int = 64) -> DataFrame:
    """docs without the documents that a rule rejects, all columns as they are, whatever their names.

    Each task orders the rules on ``sample_rows`` texts spread over the first
    batch that it reads, so all parts of the table are sampled and nothing is
    collected. A null text counts as an empty one, and so has too few words.
    Ties and repeated rows are judged alike; a very long text is judged whole;
    an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = None
        for b in batches:
            texts = b.column(at)
            if cascade is None and b.num_rows:
                cascade = order_rules(rules, spread(texts, sample_rows))
            yield b.filter(pa.array([first_rejection(Text(x.as_py()), cascade) is None for x in texts], pa.bool_()))

    at, names = docs.columns.index(text_col), [f"c{i}" for i in range(len(docs.columns))]
    schema = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema, strict=True)])
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)  # Arrow takes plain names alone


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 64) -> DataFrame:
    """A row for each row of docs: its id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    kept is false if the base fails (under 20 words, or over 30 % of the
    words in repeated windows of eight), else the cascade's verdict, which
    stops at the first rule that rejects. Rules take the counts of the row as
    they are, and pay for nothing twice; each task orders them as in
    ``filter_quality``. Null and empty texts have no words and fail the base;
    a null id stays null; repeated rows are judged alike; a very long text is
    judged whole; an empty table gives no rows; other columns are not carried.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    counted = lambda t: (len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = None
        for b in batches:
            if cascade is None and b.num_rows:
                cascade = order_rules(rules, spread(b.column(1), sample_rows), counted)
            counts, failed, kept = [], [], []
            for x in b.column(1):
                t = Text(x.as_py())
                counts.append(counted(t))
                failed.append(counts[-1][0] < 20 or 100 * counts[-1][-1] > 30 * counts[-1][0])
                kept.append(not failed[-1] and first_rejection(t, cascade) is None)
            columns = list(zip(*counts, strict=True)) or [()] * len(NAMES)
            columns = [*(pa.array(c, pa.int64()) for c in columns), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[id_col, *NAMES, "base_failed", "kept"])

    schema = f"{quoted(id_col)} {id_type}, " + ", ".join(f"{n} long" for n in NAMES) + ", base_failed boolean, kept boolean"
    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(run, schema)

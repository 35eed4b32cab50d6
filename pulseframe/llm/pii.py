"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field adds what they can't see, such as
addresses spelled with "at" and "dot", numbers without their plus sign or with
other separators: features of whole spans score candidate segments, and a
dynamic program over segments of bounded length chooses boundaries and kinds
together. Its weights are learned here, on sentences from a small grammar of
written-out and disguised entities and of look-alikes.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where no digit comes before, and takes its digits for good: both lose no leftmost match, and keep long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(x), 10)) for x in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(x for x in s if "0" <= x <= "9")


def _emails(text: str) -> Iterator[Span]:
    """From @ to @: a local part reaches back to the last match, the last @ or another character."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind, then start. Matches that fail their check are dropped. The time grows with the text's length, whatever is in it."""
    out: list[Span] = list(_emails(text))
    if _DIGIT.search(text):
        part = lambda p: len(p := p.lstrip("0")) <= 3 and int(p or 0) <= 255
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(part, m[0].split(".")))]
        for m in _CARD.finditer(text):  # 19 digits and what may lie between them
            if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
#: Where a segment could be that the patterns don't see: runs with seven digits, or words for the marks of an address.
_NUMBER = re.compile(r"\d(?:[ ()./_\[\]-]{0,3}+\d){6,}+")
_DOTTED = re.compile(r"\d{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot |\.) ?\d{1,3}){3}", re.I)
_MARK = re.compile(r"[(\[{] ?(?:at|@) ?[)\]}]|(?<=\s)(?:dot|punto|point|punkt)(?=\s)|(?<=\S)\s@\s", re.I)
_AT, _DOT = {"at", "@", "arroba"}, {"dot", ".", "punto", "point", "punkt"}
# Words before a span that say its kind, or that it is a number of something else.
_CUES = {
    "email": "email", "mail": "email", "e-mail": "email", "write": "email", "contact": "email",
    "ip": "ip", "host": "ip", "server": "ip", "address": "ip",
    "card": "card", "visa": "card", "credit": "card",
    "call": "phone", "phone": "phone", "tel": "phone", "fax": "phone", "mobile": "phone", "telefon": "phone",
    "order": "thing", "invoice": "thing", "id": "thing", "no": "thing", "ref": "thing", "part": "thing", "isbn": "thing",
    "version": "thing", "item": "thing", "number": "thing", "serial": "thing", "ticket": "thing",
}
#: The longest segment, in tokens and in characters; and how far a window reaches around what opens it.
MOST, MOST_CHARS, AROUND = 24, 160, 60


class _Taken:
    """Spans, for the question whether a stretch meets any."""

    def __init__(self, spans: list[Span]):
        self._starts, self._ends = [], []
        for s, e in sorted((s, e) for _, s, e in spans):
            if self._ends and s <= self._ends[-1]:
                self._ends[-1] = max(self._ends[-1], e)
            else:
                self._starts.append(s)
                self._ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_right(self._ends, start)  # the first that ends after the start
        return at < len(self._starts) and self._starts[at] < end


def windows(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Stretches of the text around what could be a segment outside the spans already taken."""
    low = text.lower() if len(text.lower()) == len(text) else text
    found = []
    if _DIGIT.search(text):
        found += [m.span() for m in _NUMBER.finditer(text)] + [m.span() for m in _DOTTED.finditer(text)]
    if "(" in text or "[" in text or "{" in text or " @ " in text or any(f" {w} " in low for w in ("dot", "punto", "point", "punkt")):
        found += [m.span() for m in _MARK.finditer(text)]
    shut = _Taken(taken)
    last: list[int] | None = None
    for s, e in sorted(f for f in found if not shut.meets(*f)):
        # wider by up to as much again, to where a word ends
        s, e = max(0, s - AROUND), min(len(text), e + AROUND)
        before, after = text[max(0, s - AROUND) : s], text[e : e + AROUND]
        s -= len(before) - max((before.rfind(x) for x in " \n\t"), default=-1) - 1
        e += min((x for x in map(after.find, " \n\t") if x >= 0), default=len(after))
        if last and s <= last[1]:
            last[1] = max(last[1], e)
        else:
            if last:
                yield tuple(last)
            last = [s, e]
    if last:
        yield tuple(last)


def candidates(text: str, start: int, end: int, taken: list[Span]) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, list[str]]]]:
    """The tokens of a window, and the segments (first token, last token + 1, kind, features) that may be an entity."""
    tokens, spans = [m.span() for m in _TOKEN.finditer(text, start, end)], _Taken(taken)
    shut = [spans.meets(a, b) for a, b in tokens]
    words = [text[a:b].lower() for a, b in tokens]
    kinds = ["d" if "0" <= w[0] <= "9" else "a" if w[0].isalpha() else "p" for w in words]
    out = []
    for i in range(len(tokens)):
        if shut[i] or kinds[i] == "p" and words[i] not in ("(", "+"):
            continue
        digits, groups, letters, at, dot, gaps, longest = 0, 0, 0, 0, 0, 0, 0
        for j in range(i, min(len(tokens), i + MOST)):
            w = words[j]
            if shut[j] or tokens[j][1] - tokens[i][0] > MOST_CHARS or "\n" in text[tokens[i][0] : tokens[j][0]]:
                break
            if kinds[j] == "d":
                digits, groups, longest = digits + len(w), groups + 1, max(longest, len(w))
            elif w in _AT:
                at += 1
            elif w in _DOT:
                dot += 1
            elif kinds[j] == "a":
                letters += 1
            gaps += j > i and tokens[j][0] > tokens[j - 1][1]
            if digits > 19 or groups > 7 or at > 1 or letters > 8 or not (at or letters < 4):
                break
            if kinds[j] == "p":
                continue
            s = text[tokens[i][0] : tokens[j][1]]
            may = []
            if at == 1 and dot and letters >= 2 and kinds[j] == "a":
                may.append("email")
            if not letters and not at and groups == 4 and longest <= 3 and dot >= 3:
                may.append("ip")
            if not letters and not at and not dot + s.count("/") > 3:
                may += ["card"] * (13 <= digits <= 19) + ["phone"] * (8 <= digits <= 15)
            for kind in may:
                out.append((i, j + 1, kind, _features(text, s, tokens[i][0], tokens[j][1], kind, words, i, j, digits, groups, letters, dot, gaps)))
    return tokens, out


def _features(text, s, a, b, kind, words, i, j, digits, groups, letters, dot, gaps) -> list[str]:
    """What the whole span shows, each with its kind."""
    d, f = _digits(s), ["bias", f"gaps{min(gaps, 6)}", f"dots{min(dot, 4)}"]
    if kind == "email":
        end = re.findall(r"\w+$", s)
        f += [f"letters{min(letters, 6)}", "tld" if end and 2 <= len(end[0]) <= 4 else "no-tld", "bracket" if re.search(r"[\[({]", s) else "plain", "odd" if set(s) - set("[](){}@._- ") and re.search(r"[,;:!?/]", s) else "even"]
        f += ["joined" if a == 0 or text[a - 1].isspace() else "inside", "mark-dot" if re.search(r"[\[({ ](?:dot|punto|point|punkt)[\])} ]", s, re.I) else "real-dot"]
    if kind == "ip":
        f += ["range" if all(int(x) <= 255 for x in re.findall(r"\d+", s)) else "out", "bracket" if "[" in s or "(" in s else "plain"]
    if kind == "card":
        f += ["luhn" if luhn(d) else "no-luhn", f"groups{min(groups, 6)}", f"first{d[0]}", "four" if all(len(x) == 4 for x in re.findall(r"\d+", s)) else "uneven"]
    if kind == "phone":
        f += [f"digits{digits}", f"groups{min(groups, 5)}", "area" if re.match(r"\+?\d{0,3} ?\(\d{2,4}\)", s) else "no-area", "tail4" if re.search(r"\d{3}[-. ]\d{4}$", s) else "no-tail4", "slash" if "/" in s else "no-slash", "luhn" if luhn(d) else "no-luhn"]
        f += ["date" if re.match(r"(?:19|20)\d\d\D?\d\d\D?\d\d", s) else "no-date"]
    f.append("cut" if (a and (text[a - 1].isalnum() or text[a - 1] in "+$€#=_")) or (b < len(text) and (text[b].isalnum() or text[b] in "%€=_")) else "free")
    beside = words[max(0, i - 1) : i] + words[j + 1 : j + 2]
    f.append("digits-beside" if any("0" <= w[0] <= "9" for w in beside) else "no-digits-beside")
    cue = next((_CUES[w] for w in reversed(words[max(0, i - 3) : i]) if w in _CUES), None)
    f.append("cue" if cue == kind else "thing-cue" if cue == "thing" else "other-cue" if cue else "no-cue")
    return [f"{kind}:{x}" for x in f]


def _chart(n: int, found, weight: dict[str, float]) -> tuple[list[float], list[list[tuple[int, float, int]]], list[float]]:
    """Scores of the segments, by where they end; log-sums of all ways to each token. A token outside scores 0."""
    scores = [sum(weight.get(x, 0.0) for x in f) for _, _, _, f in found]
    ends: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
    for k, (i, j, _, _) in enumerate(found):
        ends[j].append((i, scores[k], k))
    forward = [0.0] * (n + 1)
    for j in range(1, n + 1):
        ways = [forward[j - 1]] + [forward[i] + s for i, s, _ in ends[j]]
        top = max(ways)
        forward[j] = top + float(np.log(np.exp(np.array(ways) - top).sum())) if len(ways) > 1 else ways[0]
    return scores, ends, forward


def decode(n: int, found, weight: dict[str, float]) -> list[int]:
    """The best set of segments that don't overlap."""
    ends: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
    for k, (i, j, _, f) in enumerate(found):
        ends[j].append((i, sum(weight.get(x, 0.0) for x in f), k))
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, s, k in ends[j]:
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, k
    out, j = [], n
    while j:
        if back[j] < 0:
            j -= 1
        else:
            out.append(back[j])
            j = found[back[j]][0]
    return out[::-1]


def _entities(r: random.Random) -> dict[str, tuple[str | None, str]]:
    """One entity of each family of the grammar: its kind, or none for what only looks like one, and its text."""
    word = lambda: "".join(r.choice("aeiounrstldm") for _ in range(r.randint(2, 8)))
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name, host = f"{word()}{r.choice(['', '.' + word(), n(2)])}", word()
    tld = r.choice(["com", "org", "net", "de", "io", "fr", "es"])
    while not luhn(card := r.choice("3456") + n(15)):
        pass
    octets, fours = [str(r.randint(0, 255)) for _ in range(4)], [card[x : x + 4] for x in range(0, 16, 4)]
    spaced_at = r.choice(["at", "(at)", "[at]", "{at}", "@"])
    return {
        "email spaced": ("email", f"{name} {spaced_at} {host} {r.choice(['dot', '(dot)', '[dot]'])} {tld}"),
        "email joined": ("email", f"{name}{r.choice(['[at]', '(at)', ' @ ', ' [at] '])}{host}{r.choice(['.', '[dot]', '(dot)'])}{tld}"),
        "email words": ("email", f"{name} at {host} dot {tld}"),
        "ip": ("ip", r.choice(["[.]", " dot ", "[dot]", "(.)"]).join(octets)),
        "card": ("card", r.choice([".", "/", "_", "  "]).join(fours)),
        "phone area": ("phone", f"({n(3)}) {n(3)}-{n(4)}"),
        "phone dashes": ("phone", f"{r.choice('123456789')}{n(2)}-{n(3)}-{n(4)}"),
        "phone spaces": ("phone", f"0{n(3)} {n(3)} {n(4)}"),
        "phone dots": ("phone", f"{n(3)}.{n(3)}.{n(4)}"),
        "phone slash": ("phone", f"0{n(r.choice([2, 3, 4]))}/{n(r.choice([6, 7, 8]))}"),
        "phone abroad": ("phone", f"00{r.choice('123456789')}{n(1)} {n(r.choice([2, 3]))} {n(r.choice([6, 7]))}"),
        "run of digits": (None, n(r.choice([7, 9, 10, 12, 14, 16, 18]))),
        "date and time": (None, f"20{n(2)}-0{r.randint(1, 9)}-1{n(1)} 1{n(1)}:{n(2)}:{n(2)}"),
        "version": (None, f"{n(1)}.{n(1)}.{n(2)}"),
        "threes": (None, f"{n(3)} {n(3)} {n(3)}"),
        "fours": (None, " ".join(n(4) for _ in range(r.randint(2, 5)))),
        "order number": (None, f"{r.choice(['order', 'invoice', 'ref', 'ticket'])} {r.choice(['-', ' ']).join(n(r.choice([3, 4])) for _ in range(3))}"),
        "look at": (None, f"look at {word()} dot {word()}, {word()}"),
        "the dot": (None, f"the dot {word()}"),
        "thousands": (None, f"{n(1)},{n(3)},{n(3)},{n(3)}"),
        "lone mark": (None, f"(at) {word()}"),
        "prose": (None, f"{word()} at the {word()}. {word()}"),
        "fives": (None, f"{n(5)}-{n(5)}-{n(5)}"),
        "isbn": (None, f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}"),
        "eights": (None, f"{n(8)} {n(8)}"),
    }


def _grammar(r: random.Random, without: frozenset[str] = frozenset(), only: str | None = None) -> tuple[str, list[Span]]:
    """A sentence with an entity of one family, or with what only looks like one; ``without`` leaves families out."""
    word = lambda: "".join(r.choice("aeiounrstldm") for _ in range(r.randint(2, 8)))
    families = _entities(r)
    kind, entity = families[only or r.choice([f for f in families if f not in without])]
    lead = [" ", " ", " mail ", " call ", " card ", " host ", ", "] if kind else [" ", " ", " ", " call ", " no ", " id ", ", "]
    lead += [" tel: ", " phone "] if kind == "phone" else []
    before = " ".join(word() for _ in range(r.randint(0, 6))) + r.choice(lead)
    text = f"{before}{entity}{r.choice([' ', '. ', ', '])}{' '.join(word() for _ in range(r.randint(0, 6)))}"
    return text, [(kind, len(before), len(before) + len(entity))] if kind else []


@lru_cache(maxsize=32)
def train(sentences: int = 1000, epochs: int = 12, seed: int = 3, without: frozenset[str] = frozenset()) -> dict[str, float]:
    """The field's weights, by stochastic gradients of the log-likelihood of the grammar's sentences; always the same."""
    r = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, gold = _grammar(r, without)
        tokens, found = candidates(text, 0, len(text), base_spans(text))
        right = {k for k, (i, j, kind, _) in enumerate(found) if (kind, tokens[i][0], tokens[j - 1][1]) in gold}
        if found:
            data.append((len(tokens), found, right))
    weight: dict[str, float] = {}
    for epoch in range(epochs):
        rate = 0.3 / (1 + 0.3 * epoch)
        r.shuffle(data)
        for n, found, right in data:
            scores, ends, forward = _chart(n, found, weight)
            backward = [0.0] * (n + 1)
            starts: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
            for k, (i, j, _, _) in enumerate(found):
                starts[i].append((j, scores[k]))
            for i in range(n - 1, -1, -1):
                ways = np.array([backward[i + 1]] + [backward[j] + s for j, s in starts[i]])
                top = ways.max()
                backward[i] = float(top + np.log(np.exp(ways - top).sum()))
            for k, (i, j, _, features) in enumerate(found):
                step = (k in right) - float(np.exp(forward[i] + scores[k] + backward[j] - forward[n]))
                if abs(step) > 1e-3:
                    for x in features:
                        weight[x] = weight.get(x, 0.0) * (1 - 1e-4) + rate * step
    return weight


def measured(weight: dict[str, float], sentences: int = 400, seed: int = 77, only: str | None = None) -> tuple[int, int, int]:
    """(right, found, there): added spans on sentences of the grammar that training hasn't seen, all families or one."""
    r, right, made, there = random.Random(seed), 0, 0, 0
    for _ in range(sentences):
        text, gold = _grammar(r, only=only)
        base, added = find(text, weight)
        gold = [g for g in gold if g not in base]
        right, made, there = right + len(set(gold) & set(added)), made + len(added), there + len(gold)
    return right, made, there


def find(text: str | None, weight: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of a text. Added ones overlap no base span."""
    text = text or ""
    base = base_spans(text)
    added: list[Span] = []
    for s, e in windows(text, base):
        tokens, found = candidates(text, s, e, base)
        if found:
            added += [(found[k][2], tokens[found[k][0]][0], tokens[found[k][1] - 1][1]) for k in decode(len(tokens), found, weight)]
    return base, added


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: its id, base (array of kind, start, end by kind, then start) and added (likewise, what the field finds beyond).

    Offsets count code points, ends are exclusive. Null and empty texts have
    empty arrays; a null id stays null; equal rows give equal rows; other
    columns are not looked at. A very long text is read whole, in time that
    grows with its length; a segment of the field has at most MOST tokens and
    MOST_CHARS characters. An empty table gives no rows.
    """
    weight, kind = train(), docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [find(t.as_py(), weight) for t in b.column(1)]
            columns = [[[dict(zip(("kind", "start", "end"), s, strict=True)) for s in sorted(x[k], key=lambda s: (KINDS.index(s[0]), s[1]))] for x in both] for k in range(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.list_(span)) for c in columns)], names=[id_col, "base", "added"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, base {spans}, added {spans}")

"""Packing: documents into token sequences of several lengths, with next to no padding.

Hierarchical multi-length packing. A document is tokenised and cut into whole
windows of the largest tier; what is left is routed to the smallest tier that
holds it. Every tier is packed best fit decreasing, into windows of its own
length. What a longer window still lacks is filled from shorter tiers, the last
filler being cut to fit; sequences are then dealt into step groups of near
equal load and mix of tiers.
"""

from __future__ import annotations

import json
from bisect import bisect_right, insort
from collections.abc import Iterator
from operator import itemgetter
from string import punctuation
from struct import pack as to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

from pulseframe.llm.common import give_back

#: Window lengths, in tokens.
TIERS = (512, 1024, 2048, 4096)
LENGTH = itemgetter(2)
#: Of a document in part: which one, where the part begins, how long it is.
Piece = tuple[int, int, int]


# The normaliser and pre-tokenizer under which chunks between ASCII spaces are tokenised apart.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Tokens(dict):
    """Token ids of a text, as little-endian unsigned 32-bit bytes.

    Where the file's normaliser and pre-tokenizer are the known ones, no token
    joins across ASCII white space, so the ids of a text are those of its
    chunks between spaces. Those are the keys here, kept once seen: two
    generations of at most ``most_bytes`` bytes each, chunks over ``longest``
    characters not at all. Any other tokenizer encodes the whole text, plainly.
    """

    def __init__(self, path: str, most_bytes: int = 32_000_000, longest: int = 200):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        tokenizer = Tokenizer.from_file(path)
        part = lambda x: None if x is None else json.loads(x.__getstate__())
        # a special token is met by the plain encoding of its chunk, so it must lie in one and not be a word
        self._special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        self.chunked = (
            part(tokenizer.normalizer) == NORMALIZER
            and part(tokenizer.pre_tokenizer) == PRE_TOKENIZER
            and type(tokenizer.model).__name__ == "BPE"
            and not tokenizer.model.dropout
            and not any(c.isspace() for x in self._special for c in x)
            and not any(x.rstrip(punctuation).isalpha() or not x.rstrip(punctuation) for x in self._special)
        )
        self._encode, self._merge = tokenizer.encode, tokenizer.model.tokenize
        self._most, self._longest = most_bytes, longest
        self._before, self._held = {}, 0
        # how byte-level vocabularies write each byte: printable ones as themselves, the others from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = (b for b in range(256) if b not in shown)
        self._written = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}

    def _plain(self, text: str) -> bytes:
        ids = self._encode(text, add_special_tokens=False).ids
        return to_bytes(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Of letters in lower case, of ASCII or Latin-1."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self._written)
        ids = [t.id for t in self._merge(word)]
        return to_bytes(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        got = self._before.get(chunk)
        if got is None:
            if len(chunk) > self._longest:
                return self._plain(chunk)
            # letters and the marks after them are tokens apart; in Latin-1 case goes letter by letter and nothing composes
            word = chunk.rstrip(punctuation)
            if word.isalpha() and (chunk.isascii() or max(chunk) <= "\xff"):
                low, marks = word.lower(), chunk[len(word) :]
                got = self._word(low) if low == chunk else self[low]
                if marks:
                    got += self[marks]
            else:
                got = self._plain(chunk)
        self._held += 200 + len(chunk) + len(got)
        if self._held > self._most:  # two generations: what is in use moves on
            self._before, self._held = dict(self), 0
            self.clear()
            self[""] = b""
        self[chunk] = got
        return got

    def ids(self, text: str) -> bytes:
        if not self.chunked:
            return self._plain(text)
        if text.isascii():  # fewer chunks to know, if that makes no special token
            low = text.lower()
            text = text if any(x in low for x in self._special) else low
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, chunks))


def pack_pieces(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences, each exactly full at its tier, and the pieces left over, under one window of the largest tier."""
    window = tiers[-1]
    out: list[list[Piece]] = []
    shelves: dict[int, list[Piece]] = {t: [] for t in tiers}
    for d, start, n in pieces:
        whole = n // window * window
        out += [[(d, start + s, window)] for s in range(0, whole, window)]
        if n > whole:
            shelves[next(t for t in tiers if t >= n - whole)].append((d, start + whole, n - whole))
    for shelf in shelves.values():
        shelf.sort(key=lambda p: (p[2], -p[0]))  # taken from the end
    for t in reversed(tiers):
        # gaps are filled from the same tier, then from the shorter ones, each time with the largest that fits
        near = [shelves[x] for x in reversed(tiers) if x <= t]
        while shelves[t]:
            seq = [shelves[t].pop()]
            room = t - seq[0][2]
            for shelf in near:
                while shelf and room and (at := bisect_right(shelf, room, key=LENGTH)):
                    seq.append(shelf.pop(at - 1))
                    room -= seq[-1][2]
            # all that is left there is longer than the room: the shortest of the lowest shelf is cut
            shelf = next((x for x in reversed(near) if x), None)
            if room and shelf is None:
                return out, seq  # nothing is left on this shelf or below
            if room:
                d, s, n = shelf.pop(bisect_right(shelf, room, key=LENGTH))
                seq.append((d, s, room))
                insort(shelves[next(x for x in tiers if x >= n - room)], (d, s + room, n - room), key=LENGTH)
            out.append(seq)
    return out, []


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces that hold each token of each document once.

    All are exactly full at their tier, but for the rest at the end, under
    one window, which is cut at powers of two, so nothing is padded.
    """
    out, rest = pack_pieces([(d, 0, n) for d, n in enumerate(lengths)], tiers)
    return out + _cut_at_powers(rest)


def _cut_at_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces one after another, as sequences of falling powers of two."""
    out, rest, at, used = [], sum(p[2] for p in pieces), 0, 0
    while rest:
        room = 1 << (rest.bit_length() - 1)
        rest, seq = rest - room, []
        while room:
            d, s, n = pieces[at]
            take = min(room, n - used)
            seq.append((d, s + used, take))
            room, used = room - take, used + take
            if used == n:
                at, used = at + 1, 0
        out.append(seq)
    return out


def step_groups(loads: list[int], size: int, tiers: list[int] | None = None) -> list[int]:
    """The group of each sequence: groups of ``size`` sequences with near equal sums of load and, if ``tiers`` has each sequence's, as many of each tier but for two.

    In turns, largest first, each group takes one sequence: the larger the load, the less the group has.
    """
    groups = max(1, -(-len(loads) // size))
    out, sums = [0] * len(loads), [0] * groups
    tiers = tiers or [0] * len(loads)
    order = sorted(range(len(loads)), key=lambda k: (-tiers[k], -loads[k], k))
    for at in range(0, len(order), groups):
        turn = sorted(order[at : at + groups], key=lambda k: (-loads[k], k))
        for k, place in zip(turn, sorted(range(groups), key=sums.__getitem__), strict=False):
            out[k] = place
            sums[place] += loads[k]
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    end_id: int = 2,
    block_tokens: int = 1_000_000,
    group_size: int = 64,
) -> DataFrame:
    """The pieces of all documents: their ids, place in the document, place in a sequence.

    Columns: ``id_col``, start, length, ids (binary, little-endian unsigned 32
    bits), doc_tokens (with the end id), sequence_id, offset, tier (the window
    that holds the sequence), step_group. Documents are packed in blocks of
    about ``block_tokens`` tokens as the partitions bring them, so nothing is
    shuffled and a task holds one block and the document that ends it. Each
    block leaves under one window to the next; only what a task's last block
    leaves is cut at powers of two. sequence_id carries the partition in its
    upper bits, so ids are unique without counting across tasks.

    Null texts are empty: their document is the end id alone. Equal rows are
    packed each for itself, null ids stay null, an empty table gives no rows;
    other columns are not carried. A very long text is tokenised whole by its
    task, with or without spaces.
    """
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
    end = to_bytes("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()
        tokens = Tokens(tokenizer)
        first = group = TaskContext.get().partitionId() << 36
        # of each document in part: id, ids from where it begins, that place, all its tokens
        held: list[tuple[pa.Scalar, bytes, int, int]] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal first, group, held, size
            sequences, rest = pack_pieces([(d, 0, len(x[1]) // 4) for d, x in enumerate(held)], tiers)
            if last:
                sequences, rest = sequences + _cut_at_powers(rest), []
            lengths = [sum(p[2] for p in seq) for seq in sequences]
            groups = step_groups([sum(p[2] ** 2 for p in seq) for seq in sequences], group_size, lengths)
            of, rows = [], []
            for k, seq in enumerate(sequences):
                offset = 0
                for d, s, n in seq:
                    _, ids, begin, total = held[d]
                    of.append(d)
                    rows.append((begin + s, n, ids[4 * s : 4 * (s + n)], total, first + k, offset, lengths[k], group + groups[k]))
                    offset += n
            keys = pa.array([x[0].as_py() for x in held], kind)
            first, group = first + len(sequences), group + max(groups, default=-1) + 1
            held = [(held[d][0], held[d][1][4 * s : 4 * (s + n)], held[d][2] + s, held[d][3]) for d, s, n in rest]
            size = sum(n for _, _, n in rest)
            for at in range(0, len(rows), 2000):
                columns = zip(*rows[at : at + 2000], strict=True)
                columns = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(of[at : at + 2000], pa.int64())), *columns], names=names)

        kind = None
        for b in batches:
            kind = b.column(0).type
            for i, x in zip(b.column(0), b.column(1), strict=True):
                ids = tokens.ids(x.as_py() or "") + end
                held.append((i, ids, 0, len(ids) // 4))
                size += len(ids) // 4
                if size >= block_tokens:
                    yield from flush(last=False)
        if held:
            yield from flush(last=True)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long, tier long, step_group long"
    )
    return docs.select(id_col, text_col).mapInArrow(run, schema)

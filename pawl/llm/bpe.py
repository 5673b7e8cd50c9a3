"""Byte-level BPE: exact token counts at every prefix, and a lazily determinised transducer.

Both rest on one fact about BPE merges: the last token of a prefix's encoding is the only token
that ends there and is compatible with the last token of the prefix before it, and the encoding of
a prefix that ends at a token's start is a prefix of the whole encoding.
"""

from __future__ import annotations

import base64
import codecs
import json
import re
from bisect import insort
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import regex

#: Entries of each cache of a worker (of pieces, in each of its two halves); a full cache is emptied,
#: which costs time, never results. Full, they take about 130 MB (pieces), 25 MB (pairs of tokens) and
#: 120 MB (transitions and their states).
CACHE_ENTRIES = 300_000
PAIRS = 200_000
TRANSITIONS = 320_000
NO_TOKEN = -1
BYTES = [bytes([b]) for b in range(256)]


def printable_bytes() -> dict[str, int]:
    """The byte that each printable stand-in character of a JSON vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    spare = [b for b in range(256) if b not in set(plain)]
    return table | {chr(256 + i): b for i, b in enumerate(spare)}


class Vocabulary:
    """Tokens, their ids, and which two tokens may stand side by side in an encoding."""

    def __init__(self, ids: dict[bytes, int], order: dict[bytes, int] | None = None):
        """ids: token to id. order: token to the turn of the merge that makes it; its id if left out."""
        self.ids = ids
        self.order = ids if order is None else order
        self.tokens = {i: t for t, i in ids.items()}
        self.longest = max(map(len, ids))
        #: 1 for a token, 2 for a beginning of a longer one, 3 for both
        self.kinds = dict.fromkeys((t[:n] for t in ids for n in range(1, len(t))), 2)
        self.kinds.update((t, self.kinds.get(t, 0) | 1) for t in ids)
        if any(bytes([b]) not in ids for b in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        self.cuts: dict[bytes, tuple[bytes, bytes]] = {}
        self.pairs: dict[int, bool] = {}

    @classmethod
    def from_tiktoken(cls, path: str) -> Vocabulary:
        """Ranks: base64 of a token and its id on each line."""
        with open(path, "rb") as f:
            return cls.from_ranks(f.read())

    @classmethod
    def from_ranks(cls, content: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, content.split(b"\n"))))})

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        """A byte-level BPE model in the JSON of the tokenizers library."""
        with open(path, "rb") as f:
            return cls.from_json_text(f.read())

    @classmethod
    def from_json_text(cls, content: bytes) -> Vocabulary:
        model = json.loads(content)["model"]
        means = printable_bytes()
        turn = lambda s: bytes(means[c] for c in s)
        ids = {turn(t): i for t, i in model["vocab"].items() if all(c in means for c in t)}
        order = {bytes([b]): b - 256 for b in range(256)}
        for i, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            order.setdefault(turn(left) + turn(right), i)
        ids = {t: i for t, i in ids.items() if t in order}
        return cls(ids, order)

    def merged(self, data: bytes, below: int | None = None) -> list[bytes]:
        """The plain merge loop, with merges of an order less than `below` only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.order.get
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def cut(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens whose merge makes this one."""
        found = self.cuts.get(token)
        if found is None:
            left, right = self.merged(token, self.order[token])
            found = self.cuts[token] = (left, right)
        return found

    def adjacent(self, left: bytes, right: bytes) -> bool:
        """True if an encoding may hold left and then right.

        Walks back through the merges that made both: at no moment may the two tokens that touch
        at the border have had a merge that comes before the one that was done instead.
        """
        key = self.ids[left] << 32 | self.ids[right]
        known = self.pairs.get(key)
        if known is not None:
            return known
        order, a, b, limit, known = self.order, left, right, None, True
        while True:
            rank = order.get(a + b)
            if rank is not None and (limit is None or rank < limit):
                known = False
                break
            if len(a) == 1 and len(b) == 1:
                break
            # undo whichever of the two merges was done last; of equal ones the left came first
            if len(b) == 1 or (len(a) > 1 and order[a] > order[b]):
                limit = order[a]
                a = self.cut(a)[1]
            else:
                limit = order[b] + 1
                b = self.cut(b)[0]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = known
        return known


class PrefixCounter:
    """Token counts of every prefix of a piece by dynamic programming, and answers from them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def table(self, piece: bytes) -> tuple[list[int], list[bytes]]:
        """For each i up to the piece's length: tokens of piece[:i], and its last token."""
        kind_of, adjacent = self.vocabulary.kinds.get, self.vocabulary.adjacent
        counts, last = [0], [b""]
        #: starts of tokens that may still reach beyond the current end
        live: list[int] = []
        for end in range(1, len(piece) + 1):
            live.append(end - 1)
            fits, still = [], []
            for start in live:
                part = piece[start:end]
                kind = kind_of(part)
                if kind is not None:
                    if kind & 1:
                        fits.append((start, part))
                    if kind & 2:
                        still.append(start)
            # exactly one fits what comes before it, so the last is right if no other is
            for start, part in fits[:-1]:
                if not start or adjacent(last[start], part):
                    break
            else:
                start, part = fits[-1]
            counts.append(counts[start] + 1)
            last.append(part)
            live = still
        return counts, last

    def count(self, piece: bytes) -> int:
        return 1 if piece in self.vocabulary.ids and len(piece) == 1 else self.table(piece)[0][-1]

    def ids(self, piece: bytes) -> list[int]:
        """The encoding, read from the table's end."""
        _, last = self.table(piece)
        out, end = [], len(piece)
        while end:
            out.append(self.vocabulary.ids[last[end]])
            end -= len(last[end])
        return out[::-1]


class TextCounts:
    """Exact counts at every prefix of one text: whole pieces, then the table of a piece."""

    def __init__(self, text: str, pattern: str, counter: PrefixCounter, special: str | None = None):
        self.text, self.counter = text, counter
        self.pattern, self.special = regex.compile(pattern), special
        self.pieces: list[tuple[int, int, bool]] = []
        at = 0
        for k, run in enumerate(text.split(special) if special else [text]):
            if k:
                self.pieces.append((at, at + len(special), True))
                at += len(special)
            self.pieces += [(at + m.start(), at + m.end(), False) for m in self.pattern.finditer(run)]
            at += len(run)
        self.totals = [0]
        for start, end, whole in self.pieces:
            self.totals.append(self.totals[-1] + (1 if whole else counter.count(text[start:end].encode())))

    def total(self) -> int:
        return self.totals[-1]

    def cut_to(self, budget: int) -> int:
        """Characters of the longest run of whole pieces, and of whole characters of the next
        piece, whose tokens number at most budget. Prefixes inside a piece are counted as that
        piece's own prefixes, which is what a reader who cuts the token list gets."""
        lo, hi = 0, len(self.pieces)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.totals[mid] <= budget else (lo, mid - 1)
        if lo == len(self.pieces):
            return len(self.text)
        start, end, whole = self.pieces[lo]
        left, best = budget - self.totals[lo], start
        if whole or left <= 0:
            return best
        counts, _ = self.counter.table(self.text[start:end].encode())
        size = 0
        for i in range(start, end):
            size += len(self.text[i].encode())
            if counts[size] <= left:
                best = i + 1
        return best


class Transducer:
    """Bytes in, token ids out: a finite-state transducer whose states are made when first met.

    A state is the last token given out and the bytes read since. Reading a byte settles the last
    token of the new prefix; the ways back from all starts of tokens that could still be growing
    are followed, and what they share is given out. So a token is given out once no later byte can
    change it, after the vocabulary's longest token at the latest.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        #: lengths and places within the bytes held, which are never more than the longest token
        self.packed = bytes if vocabulary.longest < 256 else tuple
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple[bytes, bytes], int] = {}
        self.content: list[tuple[bytes, bytes]] = []
        #: of each state: the length of the last token at each place, and the starts that may go on
        self.last: list[Sequence[int]] = []
        self.live: list[Sequence[int]] = []
        #: state and byte to the next state; to its complement if ids are given out, which `gives` has
        self.moves: dict[int, int] = {}
        self.gives: dict[int, tuple[int, ...]] = {}
        self.runs: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self.state(b"", b"", [0], [0])

    def state(self, context: bytes, held: bytes, last: list[int], live: list[int]) -> int:
        key = (context, held)
        known = self.states.get(key)
        if known is None:
            known = self.states[key] = len(self.content)
            self.content.append(key)
            self.last.append(self.packed(last))
            self.live.append(self.packed(live))
        return known

    def move(self, state: int, byte: int) -> int:
        """The next state, or its complement if ids are given out; made once, then found in the table."""
        v = self.vocabulary
        context, held = self.content[state]
        held += BYTES[byte]
        end, last = len(held), [*self.last[state]]
        kind_of, fits, still = v.kinds.get, [], []
        for start in self.live[state]:
            part = held[start:]
            kind = kind_of(part)
            if kind is not None:
                if kind & 1:
                    fits.append((start, part))
                if kind & 2:
                    still.append(start)
        # exactly one fits what comes before it, so the last is right if no other is
        for start, part in fits[:-1]:
            before = held[start - last[start] : start] if start else context
            if not before or v.adjacent(before, part):
                break
        else:
            part = fits[-1][1]
        last.append(len(part))
        # the ways back from all positions from which a token may go on, until they have met
        still.append(end)
        ways = still.copy()
        while len(ways) > 1:
            at = ways.pop()
            at -= last[at]
            if at > ways[-1]:
                ways.append(at)
            elif at not in ways:
                insort(ways, at)
        settled = ways[0]
        key = state << 8 | byte
        if not settled:
            self.moves[key] = made = self.state(context, held, last, still)
            return made
        out, at = [], settled
        while at:
            out.append(v.ids[held[at - last[at] : at]])
            at -= last[at]
        given = tuple(out[::-1])
        self.gives[key] = self.runs.setdefault(given, given)
        context = v.tokens[out[0]]
        made = ~self.state(context, held[settled:], [0, *last[settled + 1 :]], [s - settled for s in still])
        self.moves[key] = made
        return made

    def end(self, state: int) -> tuple[int, ...]:
        """The ids of the bytes still held."""
        _, held = self.content[state]
        last, at, out = self.last[state], len(held), []
        while at:
            out.append(self.vocabulary.ids[held[at - last[at] : at]])
            at -= last[at]
        found = tuple(out[::-1])
        self.ends[state] = found = self.runs.setdefault(found, found)
        return found

    def encode(self, piece: bytes) -> list[int]:
        if len(self.moves) >= TRANSITIONS:
            self.reset()
        get, state, out = self.moves.get, 0, []
        for byte in piece:
            step = get(state << 8 | byte)
            if step is None:
                step = self.move(state, byte)
            if step < 0:
                out += self.gives[state << 8 | byte]
                step = ~step
            state = step
        out += self.ends.get(state) or self.end(state)
        return out


class Utf8Stream:
    """An incremental UTF-8 state machine: bytes in pieces of any size, text out.

    Between pieces it holds the bytes of a character that has begun (three at most); bytes that
    cannot be UTF-8 become the replacement character.
    """

    def __init__(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self.machine.decode(data)

    def close(self) -> str:
        return self.machine.decode(b"", True)


def ranges(name: str) -> str:
    """The characters up to U+FFFF of a class of the regex library, as the inside of brackets of re."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    code = lambda c: f"\\u{ord(c):04x}"
    # a run of neighbours in `every` that crosses the gap of the surrogates takes them in, but no text has any
    return "".join(code(run[0]) + "-" + code(run[-1]) for run in regex.findall(name + "+", every))


def splitter(pattern: str):
    """findall of the pattern; texts up to U+FFFF go by the faster library with the same classes spelled out."""
    slow = regex.compile(pattern).findall
    out, inside, rest = [], False, pattern
    while rest:
        token = regex.match(r"\\[pP]\{\w+\}|\\.|.", rest, regex.DOTALL)[0]
        rest = rest[len(token) :]
        if token in ("[", "]"):
            inside = token == "["
        elif token in (r"\s", r"\p{L}", r"\p{N}"):
            token = ranges(token) if inside else f"[{ranges(token)}]"
        elif token == r"\S" and not inside:
            token = f"[^{ranges(chr(92) + 's')}]"
        elif token[0] == "\\":
            return slow
        out.append(token)
    fast = re.compile("".join(out)).findall
    return lambda text: fast(text) if len(text.encode("utf-16-le")) == 2 * len(text) else slow(text)


class Remembered(dict):
    """A dict that computes what it lacks and forgets what was not asked for lately.

    When it is full its entries become the older half, in place of those before; an older entry that
    is asked for again is taken back. So frequent keys outlive any number of rare ones.
    """

    def __init__(self, compute, most: int = CACHE_ENTRIES, longest: int = 48):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older.clear()
                self.older.update(self)
                self.clear()
            self[key] = value
        return value


def vocabulary_file(path: str) -> tuple[bytes, bool]:
    """The file's bytes, read on the driver and sent to tasks, and whether it is JSON."""
    with open(path, "rb") as f:
        return f.read(), path.endswith(".json")


def loaded(content: bytes, is_json: bool) -> Vocabulary:
    """The vocabulary of a file's content."""
    return Vocabulary.from_json_text(content) if is_json else Vocabulary.from_ranks(content)


def decode(ids: Iterable[int], vocabulary: Vocabulary, chunk: int = 4096) -> Iterator[bytes]:
    """The bytes of ids, in runs of `chunk` tokens."""
    get, ids = vocabulary.tokens.__getitem__, iter(ids)
    while run := list(islice(ids, chunk)):
        yield b"".join(map(get, run))

"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a model and composed with each input: the normaliser (rules of the model's
character map and the treatment of spaces), the pieces with their weights, and the byte fallback, whose arcs lead a
character without a piece of its own through its bytes. The tropical shortest path through the composition is the
encoding. For a unigram model the arcs weigh minus the log-probability. A BPE model orders merges instead of weighing
pieces; a path is its encoding if and only if each two neighbouring pieces are what the merges make of the two joined.
So its automaton remembers the last piece, an arc between neighbours that do not hold together weighs infinity, any
other nothing, and exactly one path stays finite: for each prefix there is one live last piece.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesselon.llm.shared import KEPT

MARK = "▁"
KNOWN_WORDS, KNOWN_PARTS, KNOWN_PAIRS, KNOWN_LENGTH, RUN = 400_000, 200_000, 500_000, 64, 256
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
START, WORD, GAP = 0, 1, 2
UNKNOWN_PENALTY = 10.0

def _fields(raw: bytes):
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


def map_rules(blob: bytes) -> Iterator[tuple[str, str]]:
    """Sources and targets of a character map: a double array over UTF-8 bytes, then the targets, each ended by a zero byte."""
    size = struct.unpack_from("<I", blob)[0]
    units, targets = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]

    def children(at: int) -> int:
        unit = int(units[at])
        return at ^ ((unit >> 10) << ((unit & 512) >> 6))

    labels, ahead = np.arange(1, 256), [(children(0), b"")]
    while ahead:
        base, source = ahead.pop()
        places = base ^ labels
        places, bytes_ = places[places < len(units)], labels[places < len(units)]
        there = (units[places] & 0x800000FF) == bytes_
        for place, byte in zip(places[there].tolist(), bytes_[there].tolist()):
            below, longer = children(place), source + bytes([byte])
            if units[place] >> 8 & 1:
                at = int(units[below]) & 0x7FFFFFFF
                yield longer.decode(), targets[at : targets.index(0, at)].decode()
            ahead.append((below, longer))


class Normaliser:
    """A transducer from characters to normalised ones.

    The longest rule that fits is taken, other characters stay. Behind the rules stand three states: nothing written
    yet, inside a word, and (where spaces are squeezed) behind a space that is written only if something follows.
    """

    def __init__(self, rules: dict[str, str], whole: list[str], prefix: bool, squeeze: bool):
        self.rules, self.whole = self.trie(rules), self.trie({w: w for w in whole})
        #: Characters that leave nothing at the end of a text, where spaces are squeezed.
        self.tail = "".join({" ", MARK}.union(s for s, t in rules.items() if len(s) == 1 and not t.strip(" " + MARK))) if squeeze else ""
        first = MARK if prefix else ""
        self.other = {START: (WORD, first), WORD: (WORD, ""), GAP: (WORD, MARK)}
        if squeeze:
            self.space = {START: (START, ""), WORD: (GAP, ""), GAP: (GAP, "")}
        else:
            self.space = {START: (WORD, first + MARK), WORD: (WORD, MARK)}

    @staticmethod
    def trie(rules: dict[str, str]) -> dict:
        root: dict = {}
        for source, target in rules.items():
            node = root
            for c in source:
                node = node.setdefault(c, {})
            node[""] = target
        return root

    @staticmethod
    def longest(root: dict, text: str, s: int) -> tuple[int, str] | None:
        node, found = root, None
        for e in range(s, len(text)):
            node = node.get(text[e])
            if node is None:
                break
            if "" in node:
                found = e + 1, node[""]
        return found

    def mapped(self, text: str) -> str:
        """``text`` behind the rules; pieces that users define stand whole and untouched."""
        if not self.rules and not self.whole:
            return text
        out, s = [], 0
        while s < len(text):
            s, target = self.longest(self.whole, text, s) or self.longest(self.rules, text, s) or (s + 1, text[s])
            out.append(target)
        return "".join(out)

    def run(self, text: str, state: int = START) -> tuple[str, int]:
        """What is written for ``text`` from ``state`` on, and the state then."""
        out = []
        for c in self.mapped(text):
            if c == " ":
                state, put = self.space[state]
                out.append(put)
            else:
                state, put = self.other[state]
                out.append(put + c)
        return "".join(out), state


class Arc(NamedTuple):
    """An arc of the composition with an input: the characters it reads, its weight, the ids it writes."""

    piece: str
    weight: float
    ids: tuple[int, ...]


class Known(dict):
    """What was worked out, in two generations of at most ``most``: the older goes when the newer is full."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value


def packed(ids) -> bytes:
    """Ids as 32-bit integers: far smaller than a tuple."""
    return array("i", ids).tobytes()


class PieceTransducer:
    """A compiled model. ``encode`` and ``decode`` take and give whole texts; memory for known words is bounded."""

    def __init__(self, model: bytes):
        self.texts, self.ids, self.rank, self.bytes = [], {}, {}, {}
        self.kind, self.prefix, squeeze, self.unknown, blob, user = UNIGRAM, True, True, 0, b"", []
        for number, value in _fields(model):
            if number == 1:
                self.add(value, user)
            elif number == 2:
                spec = dict(_fields(value))
                self.kind = spec.get(3, UNIGRAM)
                if self.kind not in (UNIGRAM, BPE) or spec.get(24):
                    raise ValueError("only unigram and BPE models with space marks in front are supported")
            elif number == 3:
                spec = dict(_fields(value))
                self.prefix, squeeze, blob = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
                if not spec.get(5, 1):
                    raise ValueError("models without space marks are not supported")
        self.by_byte = [self.bytes.get(b, self.unknown) for b in range(256)]
        self.value_of = {i: b for b, i in self.bytes.items()}
        rules = dict(map_rules(blob)) if blob else {}
        self.normaliser = Normaliser(rules, user, self.prefix, squeeze)
        self.pieces = self.compiled(user)
        self.frozen = re.compile("|".join(map(re.escape, sorted(user, key=len, reverse=True)))) if user and self.kind == BPE else None
        self.joints = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.cut = self.cuts(rules, user)
        self.words, self.parts, self.pairs = [Known(KNOWN_WORDS) for _ in (START, WORD, GAP)], Known(KNOWN_PARTS), Known(KNOWN_PAIRS)

    def add(self, raw: bytes, user: list[str]) -> None:
        piece, score, kind = "", 0.0, NORMAL
        for number, value in _fields(raw):
            if number == 1:
                piece = value.decode()
            elif number == 2:
                score = struct.unpack("<f", value)[0]
            elif number == 3:
                kind = value
        i = len(self.texts)
        self.texts.append({CONTROL: "", UNKNOWN: " ⁇ "}.get(kind, piece))
        if kind in (NORMAL, USER):
            self.ids[piece], self.rank[piece] = i, -score
        if kind == USER:
            user.append(piece)
        elif kind == BYTE:
            self.bytes[int(piece[1:-1], 16)] = i
        elif kind == UNKNOWN:
            self.unknown = i

    def compiled(self, user: list[str]) -> dict:
        """The transducer of the pieces: a trie whose nodes hold their arc back to the root under the empty string."""
        chosen = set(user)
        costs = [w for p, w in self.rank.items() if p not in chosen]
        best, self.unknown_cost = min(costs, default=0.0), max(costs, default=0.0) + UNKNOWN_PENALTY
        root: dict = {}
        for piece, i in self.ids.items():
            node = root
            for c in piece:
                node = node.setdefault(c, {})
            weight = len(piece.encode()) * best + 0.1 if piece in chosen else self.rank[piece]
            node[""] = Arc(piece, weight, (i,))
        return root

    def fallback(self, character: str) -> Arc:
        """The way of a character without a piece through its bytes, as one arc: the first byte carries the weight."""
        return Arc(character, self.unknown_cost, tuple(self.by_byte[b] for b in character.encode("utf-8", "surrogatepass")))

    def cuts(self, rules: dict[str, str], user: list[str]) -> re.Pattern | None:
        """Stretches between places where the composition is in a single state: before spaces, around line breaks.

        No piece may hold a space mark behind another character or, for line breaks, one of those, and no rule may
        reach over such a place; else texts stay whole.
        """
        blank = {" ", MARK}.union(*(set(s) for s, t in rules.items() if " " in t or MARK in t))
        line = "" if "\n" in blank or any("\n" in s for s in [*rules, *self.ids]) else "\n"
        sources = [*rules, *user]
        across = any(b in blank and a not in blank for s in sources for a, b in zip(s, s[1:]))
        if across or any(MARK in p.lstrip(MARK) for p in self.ids) or any(" " in p for p in user):
            return None
        inside = "".join(map(re.escape, sorted(blank)))
        ends = inside + (re.escape(line) if line else "")
        return re.compile((f"{re.escape(line)}|" if line else "") + f"[{inside}]+[^{ends}]*|[^{ends}]+")

    def hold_together(self, a: str, b: str) -> bool:
        """Whether the merges leave ``a`` and ``b`` as two pieces when the two stand side by side (``a`` empty: ``b`` as one)."""
        key = (a, b)
        known = self.pairs.older.get(key)
        if known is not None:
            self.pairs.keep(key, known)
        else:
            parts, rank = [*a, *b], self.rank
            while len(parts) > 1:
                low, at = math.inf, -1
                for i in range(len(parts) - 1):
                    r = rank.get(parts[i] + parts[i + 1], math.inf)
                    if r < low:
                        low, at = r, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = parts == ([a, b] if a else [b])
            self.pairs.keep(key, known)
        return known

    def arcs(self, chunk: str, s: int) -> list[Arc]:
        """The arcs that read ``chunk`` from ``s`` on, shortest first; a character that is no piece goes through its bytes."""
        node, found = self.pieces, []
        for e in range(s, len(chunk)):
            node = node.get(chunk[e])
            if node is None:
                break
            arc = node.get("")
            if arc is not None:
                found.append(arc)
        if not found or len(found[0].piece) > 1:
            found.insert(0, self.fallback(chunk[s]))
        return found

    def path(self, chunk: str) -> tuple[int, ...]:
        """Ids written on the shortest path through the composition with ``chunk``, an already normalised stretch."""
        steps = self.bpe_path(chunk) if self.kind == BPE else self.unigram_path(chunk)
        return tuple(i for arc in steps for i in arc.ids)

    def unigram_path(self, chunk: str) -> list[Arc]:
        n = len(chunk)
        cost, last = [0.0] + [math.inf] * n, [None] * (n + 1)
        for s in range(n):
            for arc in self.arcs(chunk, s):
                e = s + len(arc.piece)
                if cost[s] + arc.weight < cost[e]:
                    cost[e], last[e] = cost[s] + arc.weight, arc
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n].piece)
        return out[::-1]

    def bpe_path(self, chunk: str) -> list[Arc]:
        """Depth first from the longest arc: all finite arcs weigh nothing, so the first path through is the shortest."""
        n, pairs, holds = len(chunk), self.pairs, self.hold_together
        path, ahead, at, dead, before = [], [self.arcs(chunk, 0)] if chunk else [], 0, set(), ""
        while at < n:
            arcs = ahead[-1]
            if not arcs:
                ahead.pop()
                piece = path.pop().piece
                dead.add((at, piece))
                at -= len(piece)
                before = path[-1].piece if path else ""
                continue
            arc = arcs.pop()
            piece = arc.piece
            fits = pairs.get((before, piece))
            if fits is None:
                fits = holds(before, piece)
            if fits and (at + len(piece), piece) not in dead:
                path.append(arc)
                before = piece
                at += len(piece)
                if at < n:
                    ahead.append(self.arcs(chunk, at))
        return path

    def part(self, chunk: str) -> bytes:
        found = self.parts.get(chunk)
        if found is None:
            found = self.parts.older.get(chunk)
            if found is None:
                found = packed(self.path(chunk))
            if len(chunk) <= KNOWN_LENGTH:
                self.parts.keep(chunk, found)
        return found

    def shortest(self, chunk: str) -> bytes:
        """Packed ``path`` of a normalised stretch, cut where no piece holds both neighbours: the composition is in a single state there."""
        if self.frozen is not None:
            found, at = [], 0
            for m in self.frozen.finditer(chunk):
                found += self.path(chunk[at : m.start()])
                found.append(self.ids[m.group()])
                at = m.end()
            return packed(tuple(found) + self.path(chunk[at:]))
        joints = self.joints
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in joints]
        if not cuts:
            return packed(self.path(chunk))
        return b"".join(self.part(chunk[s:e]) for s, e in zip([0, *cuts], [*cuts, len(chunk)]))

    def solved(self, stretch: str, state: int) -> tuple[bytes, int]:
        """Ids of a stretch not at hand and the normaliser's state behind it. Those that end inside a word, nearly all, are kept."""
        known = self.words[state]
        found, then = known.older.get(stretch), WORD
        if found is None:
            written, then = self.normaliser.run(stretch, state)
            found = self.shortest(written)
        if then == WORD and len(stretch) <= KNOWN_LENGTH:
            known.keep(stretch, found)
        return found, then

    def encode(self, text: str | None) -> list[int]:
        """Piece ids of a whole text. Stretches between places where the composition is in a single state are solved
        once and kept while they fit. Without byte fallback a run of unknown characters is written once."""
        if text and self.normaliser.tail:
            text = text.rstrip(self.normaliser.tail)
        if not text:
            return []
        raw, words, state = bytearray(), self.words, START
        for stretch in self.cut.findall(text) if self.cut else [text]:
            found = words[state].get(stretch)
            if found is None:
                found, state = self.solved(stretch, state)
            else:
                state = WORD
            raw += found
        out = array("i", bytes(raw)).tolist()
        if not self.bytes:
            out = [i for k, i in enumerate(out) if i != self.unknown or not k or out[k - 1] != i]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids: byte pieces joined as UTF-8, space marks as spaces, without the one put in front."""
        texts, value_of = self.texts, self.value_of
        out, run = [], bytearray()
        for i in ids:
            b = value_of.get(i)
            if b is None:
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(texts[i])
            else:
                run.append(b)
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_compiled: dict[bytes, PieceTransducer] = {}
KEPT.append(_compiled)


def transducer(model: bytes) -> PieceTransducer:
    """The compiled model, once per worker process."""
    key = hashlib.sha256(model).digest()
    if key not in _compiled:
        _compiled[key] = PieceTransducer(model)
    return _compiled[key]


def with_pieces(docs: DataFrame, model_file: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (``doc_id``) of ``docs(text, ...)`` with ``token_ids``, ``n_tokens``, ``decoded_sha256`` and ``round_trip``.

    ``round_trip`` tells whether decoding gives the text back (a space mark in the text comes back as a space; models
    that squeeze spaces or map characters give back the normalised text). Null and empty texts have no pieces. Repeated rows get equal
    results, extra columns are ignored, an empty table gives an empty result. ``model_file`` is read on the driver;
    its bytes, a fixed size, are broadcast.
    """
    with open(model_file, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    keep = keep or ["doc_id"]
    added = ["token_ids", "n_tokens", "decoded_sha256", "round_trip"]
    kept = [c for c in keep if c not in added]

    def run(batches):
        coder = transducer(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                texts = part.column(part.num_columns - 1).to_pylist()
                ids = [coder.encode(t) for t in texts]
                back = [coder.decode(i) for i in ids]
                digest = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]
                same = [b == (t or "").replace(MARK, " ") for b, t in zip(back, texts)]
                columns = [pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int32()), pa.array(digest), pa.array(same)]
                yield pa.record_batch([*part.columns[:-1], *columns], names=[*kept, *added])

    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    chosen = docs.select(*kept, docs["text"].alias("_text"))
    return chosen.mapInArrow(run, f"{shape}, token_ids array<int>, n_tokens int, decoded_sha256 string, round_trip boolean")

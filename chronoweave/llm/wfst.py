"""SentencePiece encoding as a weighted finite-state transducer, and decoding.

Three machines over the tropical semiring (weights add along a path, the least total wins):

* the normaliser: a trie of the model's rewriting rules, of which the longest that fits is taken (any
  other character is itself), the space's sign for each space and one in front of the text;
* the pieces: a trie from each state back to a state for the piece read. In a unigram model an arc
  weighs minus the piece's score. In a merge (BPE) model the arc of piece b after piece a weighs 0 if
  the merges leave a, b of their letters as they are, and is missing (infinite) if one of them would
  cross the border. Merges that leave every neighbouring pair as it is leave the whole as it is, so
  one path of finite weight leads to each place: the merges' own result;
* byte fallback: a character that is no piece to its bytes.

They are compiled once for a model; the arcs between pairs of pieces, which are too many to write
out, are worked out when first met. An input is composed with the normaliser, the result with the
other two, place by place, and the shortest path through the composition is the encoding.

If no piece holds the space's sign after another character, every path passes through a place before
each run of signs: the shortest path of a text is those of its words one after another, and a word
met before needn't be composed again. compile_model looks whether that is so.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_made

SPACE, CACHE, PAIRS, UNKNOWN_MARGIN = "▁", 500_000, 1_000_000, 10.0
_PARTS = re.compile("▁+[^▁]*|[^▁]+")
END = ""  # the key of a trie's node for what ends there
UNIGRAM, MERGES = 1, 2  # the models' own numbers of their kinds


class Rewrites:
    """The normaliser: rules (text to text) as a trie, and what happens to spaces."""

    def __init__(self, rules: dict[str, str], prefix: bool = True, squeeze: bool = False):
        self.rules, self.prefix, self.squeeze = rules, prefix, squeeze
        self.trie: dict = {}
        for source, target in rules.items():
            node = self.trie
            for c in source:
                node = node.setdefault(c, {})
            node[END] = target

    @property
    def plain(self) -> bool:
        """Whether only spaces change, one by one."""
        return self.prefix and not self.rules and not self.squeeze

    def outputs(self, text: str):
        """What the longest rule at each place gives, place after place."""
        at = 0
        while at < len(text):
            node, out, to = self.trie.get(text[at]), text[at], at + 1
            e = at + 1
            while node is not None:
                if END in node:
                    out, to = node[END], e
                node = node.get(text[e]) if e < len(text) else None
                e += 1
            yield out
            at = to

    def __call__(self, text: str) -> str:
        if self.rules:
            text = "".join(self.outputs(text))
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (SPACE + text if self.prefix and text else text).replace(" ", SPACE)


def read_charsmap(blob: bytes) -> dict[str, str]:
    """The rules of a model file's precompiled character map: a double-array trie (units of 32 bits) and the targets it points to."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
    targets = blob[4 + size :]
    rules: dict[str, str] = {}
    offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
    stack = [(offset(units[0]), b"")]
    while stack:
        base, path = stack.pop()
        for c in range(1, 256):
            k = base ^ c
            if k >= len(units) or (units[k] & 0x800000FF) != c:
                continue
            below = k ^ offset(units[k])
            if units[k] >> 8 & 1:
                at = units[below] & 0x7FFFFFFF
                rules[(path + bytes([c])).decode()] = targets[at : targets.index(0, at)].decode()
            stack.append((below, path + bytes([c])))
    return rules


class _Pairs(dict):
    """Whether the merges leave a pair of pieces as it is: the finite arcs of a merge model, worked out when first met."""

    def __init__(self, machine: Machine):
        self.machine = machine

    def __missing__(self, key: tuple[int, int]) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        self[key] = found = self.machine.apart(*key)
        return found


class _Words(dict):
    """Ids, as bytes, of words with the space's sign in front."""

    def __init__(self, machine: Machine):
        self.machine = machine

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.machine.shortest_path(SPACE + word)[0]).tobytes()
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids


def merged(text: str, rank: dict[str, float]) -> tuple[list[str], list[tuple[float, str, str]]]:
    """What merging gives (of all neighbours whose union is a piece the best-ranked, the leftmost of equals, again
    and again), and of each merge its rank and the first and last part after it."""
    parts, steps = list(text), []
    while len(parts) > 1:
        best, at = min((rank.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == float("inf"):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        steps.append((best, parts[0], parts[-1]))
    return parts, steps


class Machine:
    """The compiled transducer. `pieces` are (piece, weight) by id, None for ids that no text reaches."""

    def __init__(self, pieces: list[tuple[str, float] | None], byte_ids: list[int], rewrites: Rewrites, kind: int = UNIGRAM):
        self.made_of = (pieces, byte_ids, rewrites, kind)
        self.pieces, self.byte_ids, self.rewrites, self.kind = pieces, byte_ids, rewrites, kind
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.texts = [bytes([self.byte_of[i]]) if i in self.byte_of else p[0].replace(SPACE, " ").encode() if p else b"" for i, p in enumerate(pieces)]
        self.weight = [p[1] if p else 0.0 for p in pieces]
        self.byte_cost = UNKNOWN_MARGIN + max((p[1] for p in pieces if p), default=0.0) if kind == UNIGRAM else 0.0
        self.rank = {p[0]: p[1] for p in pieces if p}
        self.steps: list = [None] * len(pieces)
        self.trie: dict = {}
        for i, p in enumerate(pieces):
            if p is None:
                continue
            if kind == MERGES:
                whole, steps = merged(p[0], self.rank)
                if len(whole) > 1:
                    continue  # merging never gives this piece
                self.steps[i] = steps
            node = self.trie
            for c in p[0]:
                node = node.setdefault(c, {})
            node[END] = i
        self.by_words = all(SPACE not in p[0].lstrip(SPACE) for p in pieces if p)
        self.words, self.pairs = _Words(self), _Pairs(self)

    def __getstate__(self):
        return self.made_of

    def __setstate__(self, state):
        self.__init__(*state)

    def apart(self, a: int, b: int) -> bool:
        """Whether the letters of pieces a and b merge to a and b again: both sides' merges in the order of all, none of them over the border."""
        left, right, rank = self.steps[a], self.steps[b], self.rank.get
        x, y, i, j, end = self.pieces[a][0], self.pieces[b][0], 0, 0, float("inf")
        last, first = x[-1], y[0]
        while True:
            r = left[i][0] if i < len(left) else end
            s = right[j][0] if j < len(right) else end
            over = rank(last + first, end)
            # of equal ranks the leftmost goes first: the left side's, the one over the border, the right side's
            if over < r and over <= s:
                return over == end
            if r == s == end:
                return True
            if r <= s:
                last = left[i][2]
                i += 1
            else:
                first = right[j][1]
                j += 1

    def shortest_path(self, part: str) -> tuple[list[int], float]:
        """Ids and weight of the least path over one part of a normalised text; of equal ones that whose last pieces are longer."""
        n, trie = len(part), self.trie
        back: list = [(0, -1)] + [None] * n  # the place before and the piece; -1 for bytes
        if self.kind == MERGES:
            cost, pairs = [0.0], self.pairs
            for b in range(n):
                before = back[b][1]
                node = trie.get(part[b])
                e = b + 1
                if node is None or END not in node:
                    back[e] = (b, -1)
                while node is not None:
                    piece = node.get(END)
                    # one path leads to each place, so a place that is reached needs no other
                    if piece is not None and back[e] is None and (before < 0 or pairs[before, piece]):
                        back[e] = (b, piece)
                    if e >= n:
                        break
                    node = node.get(part[e])
                    e += 1
        else:
            cost, weight, fallback = [0.0] + [float("inf")] * n, self.weight, self.byte_cost
            for b in range(n):
                base, node, e = cost[b], trie.get(part[b]), b + 1
                if (node is None or END not in node) and base + fallback < cost[e]:
                    cost[e], back[e] = base + fallback, (b, -1)
                while node is not None:
                    piece = node.get(END)
                    if piece is not None and base + weight[piece] < cost[e]:
                        cost[e], back[e] = base + weight[piece], (b, piece)
                    if e >= n:
                        break
                    node = node.get(part[e])
                    e += 1
        ids, at = [], n
        while at > 0:
            b, piece = back[at]
            ids += [piece] if piece >= 0 else [self.byte_ids[x] for x in reversed(part[b:at].encode("utf-8", "replace"))]
            at = b
        return ids[::-1], cost[-1]

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        text = text or ""
        if self.by_words and text and self.rewrites.plain and "  " not in text and SPACE not in text and text[-1] != " " and text[0] != " ":
            return b"".join(map(self.words.__getitem__, text.split(" ")))  # each word has one sign in front
        text = self.rewrites(text)
        parts = _PARTS.findall(text) if self.by_words else [text]
        return b"".join([self.words[p[1:]] if p[0] == SPACE and p[1:2] != SPACE and len(p) > 1 and self.by_words else array("I", self.shortest_path(p)[0]).tobytes() for p in parts if p])

    def decode(self, ids: bytes) -> str:
        """The text of ids: the pieces' letters one after another, the sign in front of the text taken off."""
        raw = b"".join(map(self.texts.__getitem__, array("I", ids)))
        return (raw[1:] if self.rewrites.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def compile_model(model_file: str) -> Machine:
    """The machine of a public model file: unigram or merges, with byte fallback."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(model_file, "rb") as f:
        m.ParseFromString(f.read())
    kinds, norm, kind = proto.ModelProto.SentencePiece, m.normalizer_spec, m.trainer_spec.model_type
    if kind not in (UNIGRAM, MERGES) or not m.trainer_spec.byte_fallback or not norm.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("this compiles unigram and merge models with byte fallback and the space's sign in front of words")
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in m.pieces):
        raise ValueError("pieces that users define, or that aren't used, have rules of their own")
    byte_ids = [0] * 256
    pieces: list = [None] * len(m.pieces)
    for i, p in enumerate(m.pieces):
        if p.type == kinds.BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
        elif p.type == kinds.NORMAL:
            pieces[i] = (p.piece, -p.score)
    return Machine(pieces, byte_ids, Rewrites(read_charsmap(norm.precompiled_charsmap), norm.add_dummy_prefix, norm.remove_extra_whitespaces), kind)


ENCODED = "n_tokens long, ids_crc32 long, n_bytes_ids long, decoded_equal boolean"


def encode_documents(docs: DataFrame, model_file: str, text: str = "text", ids: bool = True) -> DataFrame:
    """`docs` with `ids` (little-endian unsigned 32-bit), `n_tokens`, `ids_crc32`, `n_bytes_ids` (ids of byte
    fallback) and `decoded_equal` (whether decoding gives the text back) for each whole text.

    Null and empty texts have no ids. Existing columns of these names are replaced. A text that holds
    the space's sign itself decodes with a space in its place, and isn't equal then; nor is one that the
    model's normaliser changes. Rows stand alone; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compile_model(model_file))

    def make(texts: list[str | None]) -> list[pa.Array]:
        m = shared.value
        is_byte = np.zeros(len(m.texts), bool)
        is_byte[m.byte_ids] = True
        got = [m.encode(t) for t in texts]
        return ([pa.array(got, pa.binary())] if ids else []) + [
            pa.array([len(g) // 4 for g in got], pa.int64()),
            pa.array([zlib.crc32(g) for g in got], pa.int64()),
            pa.array([int(is_byte[np.frombuffer(g, "<u4")].sum()) for g in got], pa.int64()),
            pa.array([m.decode(g) == (t or "") for g, t in zip(got, texts, strict=True)], pa.bool_()),
        ]

    return with_made(docs, text, make, ("ids binary, " if ids else "") + ENCODED)


def decode_documents(docs: DataFrame, model_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`docs` with the text of each row's ids; null ids give null."""
    shared = docs.sparkSession.sparkContext.broadcast(compile_model(model_file))
    return with_made(docs, ids, lambda found: [pa.array([None if x is None else shared.value.decode(x) for x in found], pa.string())], f"{text} string")

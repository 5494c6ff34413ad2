"""Language ID by unigrams summed over all segmentations.

For each language there is a probability for each piece of a fixed public vocabulary. The
probability of a word is the sum, over all ways to cut it into pieces, of the product of their
probabilities; a forward pass over the word's characters gives it, rescaled on the way, so that a
word may have any length. A text's score under a language is the product over its words. Piece
probabilities come from expected counts over all segmentations (the forward-backward form of EM) of
words counted over labelled documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, with_made

#: Bound of the fit: the languages with most labelled documents, of each at most so many documents, those of least hash, and so many words.
FIT_LANGUAGES, FIT_DOCUMENTS, FIT_WORDS, ROUNDS = 500, 2000, 20_000, 3
#: No letter's probability is under FLOOR. CELLS bounds the numbers held for known words and for a group of words; words over LONG letters go one by one.
FLOOR, CELLS, LONG = 1e-9, 1_600_000, 60
SIGN, END = "▁", ""
_WORDS = re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[str]:
    """Words of a text in lower case; none if it has no letter (signs such as ² count as word signs, but aren't letters)."""
    found = _WORDS.findall(text)
    return found if found and (found[0].isalpha() or any(c.isalpha() for w in found for c in w)) else []


def vocabulary(model_file: str) -> dict[str, int]:
    """Pieces of letters only, with a space's sign in front or not, from a public model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = (m.id_to_piece(i) for i in range(m.get_piece_size()))
    keep = {p.lower() for p in pieces if re.fullmatch(r"▁?[^\W\d_]+|▁", p)}
    return {p: i for i, p in enumerate(sorted(keep))}


@dataclass
class Model:
    languages: list[str]
    pieces: dict[str, int]
    weights: np.ndarray  # pieces x languages
    unknown: np.ndarray  # of a letter that is no piece, by language

    def __post_init__(self):
        self.trie: dict = {}
        for p, i in self.pieces.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[END] = i
        self.longest = max(map(len, self.pieces), default=1)
        self.known: dict[str, int] = {}  # rows of `logs`, of words met so far
        self.logs = np.zeros((0, len(self.languages)))

    def __getstate__(self):
        return self.languages, self.pieces, self.weights, self.unknown

    def __setstate__(self, state):
        self.__init__(*state)

    def _rows(self, words: list[list[str]]) -> np.ndarray:
        """Rows of `logs` of all the words, one text after another."""
        known = self.known
        new = [w for w in set().union(*words) if w not in known]
        if known and (len(known) + len(new)) * len(self.languages) > CELLS:
            known.clear()
            new = list(set().union(*words))
        if new:
            n = len(known) + len(new)
            if n > len(self.logs):
                self.logs = np.concatenate([self.logs[: len(known)], np.zeros((max(n, 2 * len(known)) - len(known), len(self.languages)))])
            self.logs[len(known) : n] = forward(self, new)
            known.update(zip(new, range(len(known), n), strict=True))
        return np.fromiter((known[w] for t in words for w in t), np.int64)

    def scores(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Of each text the language and its posterior, with a flat prior and the mean over words in place of the sum, so long texts don't all give 1."""
        words = [_words((t or "").lower()) for t in texts]
        some = [k for k, w in enumerate(words) if w]
        out = [("und", 0.0)] * len(texts)
        if some and self.languages:
            n = np.array([len(words[k]) for k in some])
            rows = self._rows(words)
            total = np.add.reduceat(self.logs[rows], np.cumsum(n) - n, axis=0) / n[:, None]
            best = total.argmax(axis=1)
            p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for k, i, x in zip(some, best.tolist(), p.tolist(), strict=True):
                out[k] = (self.languages[i], round(x, 9))
        return out

    def found(self, word: str) -> list[tuple[int, int, int]]:
        """(end, length, piece) of every piece at every place of a word with the space's sign in front."""
        s, out = SIGN + word, []
        n = len(s)
        for b in range(n):
            node, e = self.trie.get(s[b]), b + 1
            while node is not None:
                if END in node:
                    out.append((e, e - b, node[END]))
                if e == n:
                    break
                node = node.get(s[e])
                e += 1
        return out


def _one(model: Model, word: str) -> np.ndarray:
    """Logarithms of one long word's probabilities: a sum for each place, over the last places only, each scaled by its greatest."""
    keep = model.longest + 1
    arcs: dict[int, list[tuple[int, int]]] = {}
    for e, m, i in model.found(word):
        arcs.setdefault(e, []).append((m, i))
    alpha, scale = np.zeros((keep, len(model.languages))), np.zeros(len(model.languages))
    alpha[0] = 1
    for e in range(1, len(word) + 2):
        new = alpha[(e - 1) % keep] * model.unknown
        for m, i in arcs.get(e, ()):
            new += alpha[(e - m) % keep] * model.weights[i]
        alpha[e % keep] = new
        if e % 8 == 0:
            top = alpha.max(axis=0)
            alpha /= top
            scale += np.log(top)
    return np.log(alpha[(len(word) + 1) % keep]) + scale


def _groups(model: Model, words: list[str]):
    """Places of words of like length, few enough that their tables stay small."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    a = 0
    while a < len(order):
        z = a + 1
        while z < len(order) and z - a < 4096 and (z + 1 - a) * (len(words[order[z]]) + 2) * len(model.languages) <= CELLS:
            z += 1
        yield order[a:z]
        a = z


def _arcs(model: Model, words: list[str]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Of words side by side: for each end and length, the words with such a piece and the pieces."""
    rows = [(e, m, k, i) for k, w in enumerate(words) for e, m, i in model.found(w)]
    if not rows:
        return {}
    e, m, k, i = np.array(rows).T
    order = np.lexsort((m, e))
    e, m, k, i = e[order], m[order], k[order], i[order]
    at = np.flatnonzero(np.append(True, (e[1:] != e[:-1]) | (m[1:] != m[:-1])))
    return {(int(e[s]), int(m[s])): (k[s:t], i[s:t]) for s, t in zip(at, np.append(at[1:], len(e)), strict=True)}


def forward(model: Model, words: list[str], counts: np.ndarray | None = None) -> np.ndarray:
    """Logarithms of the words' probabilities (words x languages), many words at a time.

    With counts (words x languages), the expected number of uses of each piece is added to
    model.expected, and of letters that are no piece to model.expected_unknown.
    """
    out = np.zeros((len(words), len(model.languages)))
    if counts is None:
        long = [k for k, w in enumerate(words) if len(w) > LONG]
        for k in long:
            out[k] = _one(model, words[k])
        if long:
            rest = [k for k, w in enumerate(words) if len(w) <= LONG]
            if rest:
                out[rest] = forward(model, [words[k] for k in rest])
            return out
    for own in _groups(model, words):
        part = [words[k] for k in own]
        arcs, n = _arcs(model, part), np.array([len(w) + 1 for w in part])
        width, size = int(n.max()), (len(part), len(model.languages))
        of: dict[int, list] = {}
        for (e, m), x in arcs.items():
            of.setdefault(e, []).append((m, *x))
        alpha, scale = np.zeros((width + 1, *size)), np.zeros((width + 1, *size))  # alpha[e] is in units of exp(scale[e])
        alpha[0] = 1
        for e in range(1, width + 1):
            alpha[e] = alpha[e - 1] * model.unknown
            scale[e] = scale[e - 1]
            for m, k, i in of.get(e, ()):
                past = alpha[e - m][k] if m <= e % 8 or e < 8 else alpha[e - m][k] * np.exp(scale[e - m][k] - scale[e][k])
                alpha[e][k] += past * model.weights[i]
            if e % 8 == 0:
                scale[e] += np.log(alpha[e])
                alpha[e] = 1
        at = np.arange(len(part))
        out[own] = np.log(alpha[n, at]) + scale[n, at]
        if counts is not None:
            # beta[e] is in units of exp(-scale[e]), so that alpha and beta of one place multiply to shares of the count
            beta = np.zeros_like(alpha)
            beta[n, at] = counts[own] / alpha[n, at]
            for e in range(width, 0, -1):
                step = beta[e] * np.exp(scale[e - 1] - scale[e]) * model.unknown
                model.expected_unknown += (alpha[e - 1] * step).sum(axis=0)
                beta[e - 1] += step
                for m, k, i in of.get(e, ()):
                    step = beta[e][k] * np.exp(scale[e - m][k] - scale[e][k]) * model.weights[i]
                    np.add.at(model.expected, i, alpha[e - m][k] * step)
                    beta[e - m][k] += step
    return out


def fit(counts: dict[str, dict[str, int]], pieces: dict[str, int], rounds: int = ROUNDS) -> Model:
    """A model from word counts by language."""
    languages = sorted(counts)
    words = sorted(set().union(*counts.values()))
    table = np.array([[counts[x].get(w, 0) for x in languages] for w in words], float)
    # at first a piece is as likely as its length is short
    start = np.array([0.05 ** len(p) for p in pieces])[:, None] * np.ones(len(languages))
    model = Model(languages, pieces, start / start.sum(axis=0), np.full(len(languages), 1e-6))
    for _ in range(rounds):
        model.expected, model.expected_unknown = np.zeros_like(model.weights), np.zeros(len(languages))
        forward(model, words, table)
        total = model.expected.sum(axis=0) + model.expected_unknown
        weights = (model.expected + 0.01) / (total + 0.01 * len(pieces))
        model = Model(languages, pieces, weights, np.maximum((model.expected_unknown + 0.01) / (total * 100 + 1), FLOOR))
    return model


def fit_documents(docs: DataFrame, model_file: str, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """A model from labelled documents whose crc32(doc_id) mod 4 isn't 2.

    Bounded: the FIT_LANGUAGES languages with most such documents (ties by name), of each at most FIT_DOCUMENTS
    documents, those of least hash of their id and text, and their FIT_WORDS most frequent words (ties by the
    word). Null texts and labels aren't used.
    """
    rows = docs.select(quoted(doc_id).cast("string").alias("id"), quoted(text).alias("x"), quoted(lang).alias("l"))
    rows = rows.where("x is not null and l is not null and id is not null and crc32(cast(id as binary)) % 4 <> 2")
    size = F.count(F.lit(1)).alias("n")
    most = rows.groupBy("l").agg(size).orderBy(F.col("n").desc(), "l").limit(FIT_LANGUAGES)
    of = most.collect()
    if not of:
        return Model([], {}, np.zeros((0, 0)), np.zeros(0))
    # the hash below which about 1.5 FIT_DOCUMENTS of a language lie, then the exact first ones
    share = docs.sparkSession.createDataFrame([(r.l, min(1.0, 1.5 * FIT_DOCUMENTS / r.n + 200 / r.n)) for r in of], "l string, share double")
    h = F.struct(F.xxhash64("id", "x").alias("h"), F.col("id"))
    few = rows.withColumn("h", h).join(F.broadcast(share), "l").where((F.col("h.h") / F.lit(2.0**64) + 0.5) <= F.col("share"))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= FIT_DOCUMENTS)
    word = F.explode(F.regexp_extract_all(F.lower("x"), F.lit(r"\p{L}+"), F.lit(0)))
    n = few.select("l", word.alias("w")).groupBy("l", "w").agg(size)
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.col("n").desc(), "w"))).where(F.col("r") <= FIT_WORDS)
    counts: dict[str, dict[str, int]] = {r.l: {} for r in of}
    for r in top.select("l", "w", "n").collect():
        counts[r.l][r.w] = r.n
    return fit(counts, vocabulary(model_file))


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with the language of each whole text and its score added (columns of these names are replaced).

    A null text, or one without letters, is `und` with score 0; so is any text if the model has no
    language. Ties go to the language that sorts first. Repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: list[str | None]) -> list[pa.Array]:
        found = shared.value.scores(texts)
        return [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

    return with_made(docs, text, make, f"{names[0]} string, {names[1]} double")

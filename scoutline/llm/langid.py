"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all of its segmentations into pieces, by the forward algorithm; a
text's is the product over its words. Piece probabilities are expected counts over all
segmentations of the words of the labelled rows (forward-backward under a uniform start), smoothed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.llm.shared import gathered

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD = re.compile(r"[^\W\d_]+")
START = "▁"
#: Longer words are scored in parts of so many letters.
LONGEST = 30
#: Expected counts are kept as integers of this fraction, so that sums do not depend on their order.
UNIT = 1000
SMOOTH = 0.5
#: Languages, at most; more are an error. The model holds one number for each language and piece.
LANGUAGES = 500
#: Words that a worker remembers the scores of, and words that are scored together.
MEMO, GROUP = 400_000, 5000
#: Numbers that the remembered scores take, about; of many languages fewer words are remembered.
NUMBERS = 16_000_000
#: Letters that the trie knows.
COMMON = 120


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """Pieces of a sentencepiece model that hold letters only, in lower case, after an optional word start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [p for p in pieces if (b := p.removeprefix(START)) and b == b.lower() and b.isalpha()]


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case. WORD also takes fractions, superscripts, Roman and circled numerals, which are none."""
    words = WORD.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


@dataclass
class Lattice:
    """The vocabulary, and all segmentations of words: for words of one length, the piece on every stretch of letters.

    Piece 0 is any one letter outside of the vocabulary; NONE is no piece.
    """

    pieces: list[str]
    number: dict[str, int] = field(init=False)
    longest: int = field(init=False)
    #: Code of each code point: 1 and up for the commonest letters of the pieces, 0 for all others.
    code: np.ndarray = field(init=False)
    #: A trie of the pieces of common letters: the next state by state and code (0: none, 1: root), and the piece of each state.
    step: np.ndarray = field(init=False)
    piece: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.number = {p: i + 1 for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces), default=1)
        letters = [c for c, _ in Counter(c for p in self.pieces for c in p if c != START).most_common(COMMON)]
        codes = {c: i + 1 for i, c in enumerate([START, *letters])}
        self.code = np.zeros(0x110000, np.uint8)
        self.code[[ord(c) for c in codes]] = list(codes.values())
        nodes: dict[tuple[int, int], int] = {}
        held = {}
        for p, number in self.number.items():
            state = 1
            for c in p:
                if c not in codes:
                    break
                state = nodes.setdefault((state, codes[c]), len(nodes) + 2)
            else:
                held[state] = number
        self.step = np.zeros((len(nodes) + 2, len(codes) + 1), np.int32)
        for (state, c), to in nodes.items():
            self.step[state, c] = to
        self.piece = np.full(len(nodes) + 2, self.none, np.int32)
        self.piece[list(held)] = list(held.values())

    @property
    def none(self) -> int:
        return len(self.pieces) + 1

    def stretches(self, n: int, start: bool) -> list[tuple[int, int]]:
        """(from, to) in order of from. The word start is no piece by itself: it goes with the first letters."""
        return [(i, j) for i in range(n) if not (start and i == 1) for j in range(i + 1 + (start and i == 0), min(n, i + self.longest) + 1)]

    def pieces_of(self, words: list[str], start: bool) -> tuple[int, list[tuple[int, int]], np.ndarray]:
        """Length, stretches and the (words, stretches) pieces of words of one length."""
        words = [START + w for w in words] if start else words
        n = len(words[0])
        ends = self.stretches(n, start)
        ids = np.full((len(words), len(ends)), self.none, np.int32)
        codes = self.code[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].reshape(len(words), n)
        state, last = np.ones(len(words), np.int32), -1
        for e, (i, j) in enumerate(ends):
            if i != last:
                state, last = self.step[1, codes[:, i]], i
                if j > i + 1:
                    state = self.step[state, codes[:, i + 1]]
            else:
                state = self.step[state, codes[:, j - 1]]
            ids[:, e] = self.piece[state]
        # Words with a letter that isn't common are looked up stretch by stretch.
        for k in np.flatnonzero((codes == 0).any(1)):
            ids[k] = [self.number.get(words[k][i:j], self.none) for i, j in ends]
        # The shortest stretch from a place is a letter, of the vocabulary or not.
        short = [e for e, (i, j) in enumerate(ends) if j == i + 1 + (start and i == 0)]
        ids[:, short] = np.where(ids[:, short] == self.none, 0, ids[:, short])
        return n, ends, ids

    def expected(self, words: list[str], times: np.ndarray, start: bool) -> np.ndarray:
        """Expected counts of all pieces over all segmentations of the words, in UNITs, every piece as likely as any other."""
        n, ends, ids = self.pieces_of(words, start)
        p = np.where(ids == self.none, 0.0, 1.0 / (len(self.pieces) + 1))
        a, b = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
        a[0] = b[n] = 1.0
        for e, (i, j) in enumerate(ends):
            a[j] += a[i] * p[:, e]
        for e in range(len(ends) - 1, -1, -1):
            i, j = ends[e]
            b[i] += b[j] * p[:, e]
        share = np.stack([a[i] * p[:, e] * b[j] / a[n] for e, (i, j) in enumerate(ends)], 1)
        # Whole numbers below 2 ** 53: exact, in whatever order they are summed.
        return np.bincount(ids.ravel(), (np.round(share * UNIT) * times[:, None]).ravel(), self.none + 1)[:-1].astype(np.int64)

    def scores(self, words: list[str], start: bool, prob: np.ndarray) -> np.ndarray:
        """log P(word) in each language, (words, languages); prob is (pieces + 1, languages)."""
        n, ends, ids = self.pieces_of(words, start)
        p = np.concatenate([prob, np.zeros((1, prob.shape[1]))])
        a = np.zeros((n + 1, len(words), prob.shape[1]))
        a[0] = 1.0
        for e, (i, j) in enumerate(ends):
            a[j] += a[i] * p[ids[:, e]]
        return np.log(a[n])


def by_length(words: Iterable[str]) -> Iterator[list[str]]:
    """Words of one length at a time, GROUP at most."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for ws in groups.values():
        for i in range(0, len(ws), GROUP):
            yield ws[i : i + GROUP]


def parts(words: list[str]) -> Iterator[tuple[int, str, bool]]:
    """(number of the word, part, whether it starts the word)."""
    for k, w in enumerate(words):
        for i in range(0, len(w), LONGEST):
            yield k, w[i : i + LONGEST], i == 0


_MEMOS: dict[object, dict] = {}


def memo(key: object) -> dict:
    """A dictionary that the tasks of one Python worker share, for the newest key of its kind."""
    if key not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[key] = {}
    return _MEMOS[key]


@dataclass
class Languages:
    names: list[str]
    prob: np.ndarray
    lattice: Lattice
    key: int

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log P of each word in each language."""
        out = np.zeros((len(words), len(self.names)))
        for start in (True, False):
            own: dict[str, list[int]] = {}
            for k, x, s in parts(words):
                if s == start:
                    own.setdefault(x, []).append(k)
            for group in by_length(own):
                found = self.lattice.scores(group, start, self.prob)
                # Parts that start a word are different for different words.
                np.add.at(out, [k for x in group for k in own[x]], np.repeat(found, [len(own[x]) for x in group], 0))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Most likely language and its posterior under equal priors; und and 0.0 without letters or without languages."""
        held = memo(("scores", self.key))
        if "at" not in held:
            # At least all words that are looked up together.
            held |= {"at": {}, "table": np.zeros((max(50_000, min(MEMO, NUMBERS // max(1, len(self.names)))), len(self.names)))}
        at, table = held["at"], held["table"]
        room = len(table)
        words = [words_of(t) if t and self.names else [] for t in texts]
        totals = np.zeros((len(texts), len(self.names)))
        # Stretches of words, so that what is looked up together is bounded whatever the length of a text.
        todo: list[tuple[int, list[str]]] = []

        def flush() -> None:
            new = list(dict.fromkeys(w for _, ws in todo for w in ws if w not in at))
            if len(at) + len(new) > room:
                at.clear()
                new = list(dict.fromkeys(w for _, ws in todo for w in ws))
            if new:
                table[len(at) : len(at) + len(new)] = self.word_scores(new)
                at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
            for k, ws in todo:
                totals[k] += table[[at[w] for w in ws]].sum(0)
            todo.clear()

        size = 0
        for k, ws in enumerate(words):
            for lo in range(0, len(ws), 10_000):
                todo.append((k, ws[lo : lo + 10_000]))
                size += len(todo[-1][1])
                if size > room // 2:
                    flush()
                    size = 0
        flush()
        out = []
        for ws, total in zip(words, totals, strict=True):
            best = int(total.argmax()) if ws else -1
            out.append((self.names[best], float(1.0 / np.exp(total - total[best]).sum())) if ws else ("und", 0.0))
        return out


def learn(rows: DataFrame, path: str = VOCABULARY) -> Languages:
    """Piece probabilities from all rows (text, lang) with both; sums per language and piece are all that the driver gets."""
    lattice = Lattice(vocabulary(path))
    shared = rows.sparkSession.sparkContext.broadcast(lattice)
    n = len(lattice.pieces) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value
        counts: dict[str, np.ndarray] = {}
        for b in gathered(batches):
            seen: dict[str, Counter] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            for lang, words in seen.items():
                total = counts.setdefault(lang, np.zeros(n, np.int64))
                names = list(words)
                times = list(words.values())
                for start in (True, False):
                    own: Counter = Counter()
                    for k, x, s in parts(names):
                        if s == start:
                            own[x] += times[k]
                    for group in by_length(own):
                        total += lattice.expected(group, np.array([own[x] for x in group], np.float64), start)
        for lang, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "piece", "n"])

    usable = rows.where("text is not null and lang is not null").select("text", "lang")
    found = usable.mapInArrow(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).limit(LANGUAGES * n + 1).collect()
    names = sorted({r.lang for r in found})
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    at = {x: i for i, x in enumerate(names)}
    count = np.full((n, len(names)), SMOOTH)
    for r in found:
        count[r.piece, at[r.lang]] += r.n / UNIT
    prob = count / count.sum(0)
    return Languages(names, prob, lattice, hash((tuple(names), prob.tobytes())))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row per input row; learned from the rows that are not held out.

    Null text and text without a letter: und, score 0. Without any row to learn from every
    prediction is und. Of languages with equal posteriors the first by code point is predicted. Texts of any length
    are read whole; a word of more than LONGEST letters is scored as pieces of so many. Null and repeated doc_ids are rows
    like any other. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.where(~held_out()), path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            found = model.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")

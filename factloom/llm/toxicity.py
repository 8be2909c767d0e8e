"""Toxicity scoring behind a noisy-channel deobfuscator.

Channel: a writer's word reaches us with letters replaced by look-alikes (1d10t), letters repeated (loooser) or spread
out (i d i o t, i.d.i.o.t).  A token becomes a lattice - one column per run of equal characters, with the letters that
the run may stand for and the channel's cost of each - and Viterbi decoding finds the path that a character language
model of order 4 (counted over the whole corpus) makes most probable.  Tokens without look-alikes, symbols or repeated
letters have a single path, so decoding them is a no-op and they skip it; decoded tokens are remembered per worker.

The restored words are then scored: a lexicon of words, and of word beginnings (one to four distinct words with it) for
languages whose words vary, is learnt from labelled documents.  A feature counts once per *distinct* document (minhash of its words), so that copies of
one toxic document don't make its harmless words suspicious.  The score is 1 - product of (1 - precision) over a
document's distinct matches: the probability that at least one of them means what it meant in the labelled texts.

The lexicon is fitted on about `fit_rows` labelled documents of each class (smallest hash of the id; whole texts, whose
words are restored by tasks); the character counts and the scoring cover all text of all documents.

Defined cases: null, empty and blank texts get score 0; a null id is kept; repeated rows get equal rows each; labels that
are null or without a document, and ids with contradictory labels, are ignored; without toxic labelled documents nothing is learnt and all scores are 0; a
token of any length is decoded in time linear in it; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.grams import string_buffers
from factloom.llm.quality import labelled_sample

FIT_ROWS = 2000
THRESHOLD = 0.5
PRECISION = 0.9
PREFIXES = (7, 6, 5, 4)
MOST = 4  # distinct words of one beginning that count
CHANCE = np.log(1e-4)
BLOCK = 1 << 22
SYMBOLS = 27  # 0 is the word boundary, 1 to 26 are the letters
REMEMBERED = 400_000
SCHEMA = "doc_id bigint, score double, is_toxic boolean, n_restored int, hits array<string>"

LOOK_ALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "*": "aeiou"}
STRIP = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$|+") + "“”„‘’«»…¿¡–—"
SINGLE = rf"[\w{re.escape(''.join(c for c in LOOK_ALIKE if not c.isalnum()))}]"
SPACED = re.compile(rf"\s[^\w\s]*{SINGLE}(?:\s+{SINGLE}){{2,}}[^\w\s]*(?=\s)")  # punctuation may stick to both ends
TWICE = re.compile(r"(.)\1")
RUNS = re.compile(r"(.)\1*", re.DOTALL)
DECOR = re.compile(r"^([@$|+])\1\1+|([@$|+])\2\2+$")


def _table() -> np.ndarray:
    """Byte -> symbol; a byte after 0xC3 (Latin-1 letters in UTF-8) stands for its base letter, 0xC3 itself is dropped."""
    t = np.zeros(256, np.uint8)
    for c in range(128):
        if chr(c).isalpha():
            t[c] = ord(chr(c).lower()) - 96
    for c in range(0xC0, 0x100):
        base = unicodedata.normalize("NFD", chr(c))[0].lower()
        t[c - 0x40] = ord(base) - 96 if "a" <= base <= "z" else 19 if chr(c) == "ß" else 0
    t[0xC3] = 255
    return t


_SYMBOL = _table()


@lru_cache(maxsize=4096)
def symbol_of(letter: str) -> int:
    """1 to 26 for letters whose base is a to z, else 0."""
    base = "s" if letter == "ß" else unicodedata.normalize("NFD", letter)[0].lower()
    return ord(base) - 96 if "a" <= base <= "z" else 0


def symbols(raw: np.ndarray) -> np.ndarray:
    """Symbols of UTF-8 bytes, one boundary between words."""
    s = _SYMBOL[raw]
    other = (raw >= 0xC2) & (raw != 0xC3)
    if other.any():  # bytes that continue another lead byte aren't Latin-1 letters
        wrong = np.zeros(len(raw), bool)
        wrong[1:] = other[:-1]
        for _ in range(2):
            wrong[1:] |= wrong[:-1] & (raw[1:] >= 0x80) & (raw[1:] < 0xC0)
        s[wrong & (raw >= 0x80)] = 0
    s = s[s != 255]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep].astype(np.int32)


def gram_counts(s: np.ndarray) -> np.ndarray:
    """Counts of all order-4 grams; the history ends at a word boundary."""
    if not len(s):
        return np.zeros(SYMBOLS**4, np.int64)
    s = np.concatenate((np.zeros(3, np.int32), s, np.zeros(1, np.int32)))
    h1 = s[2:-1]
    h2 = np.where(h1 == 0, 0, s[1:-2])
    h3 = np.where(h2 == 0, 0, s[:-3])
    return np.bincount(((h3 * SYMBOLS + h2) * SYMBOLS + h1) * SYMBOLS + s[3:], minlength=SYMBOLS**4)


def block_end(raw: np.ndarray, at: int) -> int:
    """The first place from `at` on that follows a word boundary (an ASCII byte that is no letter), so that no word is cut."""
    while at < len(raw):
        gap = np.flatnonzero((raw[at - 1 : at + 65535] < 128) & (_SYMBOL[raw[at - 1 : at + 65535]] == 0))
        if len(gap):
            return at + int(gap[0])
        at += 65536
    return len(raw)


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """Order-4 counts over every text (a table of a fixed size, summed on the executors)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            offsets, raw = string_buffers(batch.column(0))
            a = 0
            while a < len(raw):
                b = block_end(raw, a + BLOCK)
                total += gram_counts(symbols(raw[a:b]))
                a = b
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(F.concat(F.col("text").cast("string"), F.lit(" ")).alias("text")).filter("text IS NOT NULL").mapInArrow(count, "gram int, n bigint")
    summed = rows.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most SYMBOLS**4 rows
    out = np.zeros(SYMBOLS**4, np.int64)
    out[summed["gram"].to_numpy()] = summed["n"].to_numpy()
    return out


def log_model(counts: np.ndarray, weight: float = 6.0) -> np.ndarray:
    """log P(symbol | history) by interpolation of orders 1 to 4."""
    n = counts.reshape((SYMBOLS,) * 4).astype(np.float64)
    p = np.full((SYMBOLS,) * 4, 1 / SYMBOLS)
    for drop in (3, 2, 1, 0):
        part = n.sum(axis=tuple(range(drop)), keepdims=True)
        p = (part + weight * p) / (part.sum(axis=-1, keepdims=True) + weight)
    return np.log(np.broadcast_to(p, n.shape)).astype(np.float32).reshape(-1)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Columns of (letters, cost of the channel)."""
    columns = []
    for m in RUNS.finditer(token):
        c, n = m.group(1), m.end() - m.start()
        if c.isalpha():
            columns.append([(c, 0.0)] if n == 1 else [(c + c, 0.0), (c, 1.0)] if n == 2 else [(c, 0.0), (c + c, 0.0)])
        else:
            options = [(x, 1.0 if c != "*" else 2.5) for x in LOOK_ALIKE.get(c, "")]
            if n > 1:
                options += [(x + x, cost) for x, cost in options if c != "*"]
            columns.append(options + ([("", 0.5), (" ", 0.5)] if c == " " else [(" ", 2.0)] if c.isalnum() else [("", 1.0), (" ", 1.5)]))
    return columns


def decode(token: str, model: np.ndarray) -> str:
    """Most probable writing of a lower-case token (Viterbi; a state is the last three symbols)."""
    states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    item = model.item
    for column in [*lattice(token), [(" ", 0.0)]]:
        after: dict[int, tuple[float, tuple]] = {}
        for h, (score, path) in states.items():
            for letters, cost in column:
                now, s = h, score - cost
                for c in letters:
                    k = symbol_of(c)
                    s += item(now * SYMBOLS + k)
                    now = now * SYMBOLS % SYMBOLS**3 + k if k else 0
                if now not in after or after[now][0] < s:
                    after[now] = (s, (path, letters))
        states = after  # all of them, at most SYMBOLS**3
    path, out = max(states.values(), key=lambda x: x[0])[1], []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out)).strip()


class Restorer:
    """Words of a text after decoding; tokens seen before are looked up."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def token(self, raw: str) -> tuple[tuple[str, ...], bool]:
        """(words, whether decoding changed the token) of a lower-case token."""
        got = self.known.get(raw)
        if got is None:
            plain = raw if raw.isascii() else unicodedata.normalize("NFC", raw)
            core = DECOR.sub("", plain.strip(STRIP)).strip(STRIP)
            if not any(map(str.isalpha, core)):
                got = (), False
            elif core.isalpha() and not TWICE.search(core):
                got = (core,), False
            else:
                words = decode(core, self.model)
                got = tuple(words.split()), words != core
            if len(raw) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[raw] = got
        return got

    def spaced(self, text: str) -> list[tuple[str, ...]]:
        """Words read from runs of three or more single letters, digits and look-alikes; symbols alone are none."""
        runs = (" ".join(m.group().split()) for m in SPACED.finditer(f" {text} "))
        return [self.token(run)[0] for run in runs if any(map(str.isalnum, run))]


def words_of(text: str, restorer: Restorer) -> tuple[set[str], int]:
    """(distinct restored words, distinct tokens that decoding changed)."""
    text = text.lower()
    out, changed = set(), 0
    for raw in set(text.split()):
        words, new = restorer.token(raw)
        out.update(words)
        changed += new
    for words in restorer.spaced(text):
        out.update(words)
        changed += 1
    return out, changed


def learn(sample: list[tuple[set[str], int]], toxic_share: float) -> dict[str, float]:
    """Feature -> precision from (words, toxic) documents.

    Features are words, and 'begin-k': at least k distinct words with that beginning, none of them a feature itself.
    """
    if not sample or not any(t for _, t in sample):
        return {}
    marks = [min((crc32(w.encode()) for w in words), default=0) for words, _ in sample]
    distinct = [len({m for m, (_, t) in zip(marks, sample) if t == k}) for k in (0, 1)]
    # so often that chance alone, among the words of this sample, would hardly put them all into toxic documents
    least = max(3, 0.01 * distinct[1], CHANCE / np.log(distinct[1] / (distinct[0] + distinct[1] + 1)))
    odds = toxic_share / max(1e-9, 1 - toxic_share)
    found: dict[str, float] = {}
    for cut in (None, *PREFIXES):
        seen: dict[str, tuple[set, set]] = defaultdict(lambda: (set(), set()))
        for m, (words, toxic) in zip(marks, sample):
            rest = [w for w in words if len(w) >= (cut or 3) and w not in found]
            if cut is None:
                features = rest
            else:
                rest = [w for w in rest if not any(f"{w[:c]}-1" in found for c in PREFIXES)]
                features = [f"{b}-{k}" for b, n in Counter(w[:cut] for w in rest).items() for k in range(1, min(n, MOST) + 1)]
            for f in features:
                seen[f][toxic].add(m)
        for feature, (clean, toxic) in seen.items():
            if len(toxic) >= least:
                a, b = len(toxic) / distinct[1] * odds, len(clean) / max(1, distinct[0])
                precision = a / (a + b) * len(toxic) / (len(toxic) + 0.1)
                if precision >= PRECISION:
                    found[feature] = precision
    return found


class Lexicon:
    """Evidence of toxicity in a set of words; what it finds out about a word is kept."""

    def __init__(self, features: dict[str, float]):
        self.features, self.known = features, {}
        self.begins = {f.rpartition("-")[0] for f in features if "-" in f}

    def evidence(self, words: set[str]) -> tuple[float, list[str]]:
        """(probability that a match means toxicity, matching words)."""
        alone, begun = [], defaultdict(list)
        for w in words:
            hit = self.known.get(w)
            if hit is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                hit = self.known[w] = self.features.get(w) or [w[:c] for c in PREFIXES if len(w) >= c and w[:c] in self.begins]
            if isinstance(hit, float):
                alone.append((w, hit))
            else:
                for b in hit:
                    begun[b].append(w)
        stems: dict[str, float] = {}
        hits = {w for w, _ in alone}
        for b, ws in begun.items():
            p = max((self.features.get(f"{b}-{k}", 0.0) for k in range(1, min(len(ws), MOST) + 1)), default=0.0)
            if p:
                hits.update(ws)
                stems[b[: PREFIXES[-1]]] = max(p, stems.get(b[: PREFIXES[-1]], 0.0))  # nested beginnings count once
        clean = 1.0
        for p in [p for _, p in sorted(alone)] + [p for _, p in sorted(stems.items())]:
            clean *= 1 - p
        return (1 - clean if hits else 0.0), sorted(hits)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, dict[str, float]]:
    """(character model of the corpus, lexicon)."""
    model = log_model(corpus_counts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            words = [sorted(words_of(t.as_py(), restorer)[0]) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "class", "words"])

    rows = labelled_sample(docs, labels, (fit_rows + 1) // 2, "toxic").select("doc_id", "class", "text").repartition(16).mapInArrow(restore, "doc_id bigint, class int, words array<string>")
    sample = [(set(w), c) for _, c, w in sorted(zip(*(x.to_pylist() for x in rows.toArrow().columns)))]  # distinct words of a bounded number of documents
    share = dict(labels.filter("toxic IN (0, 1)").groupBy(F.col("toxic").cast("int")).count().collect())
    return model, learn(sample, share.get(1, 0) / max(1, sum(share.values())))


class Judge:
    """Scores texts; what it learns about tokens is kept for the next text."""

    def __init__(self, model: np.ndarray, features: dict[str, float]):
        self.restorer, self.lexicon = Restorer(model), Lexicon(features)

    def score(self, text: str) -> tuple[float, int, list[str]]:
        """(score, tokens that decoding changed, matching words)."""
        words, changed = words_of(text, self.restorer)
        score, hits = self.lexicon.evidence(words)
        return score, changed, hits


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: (doc_id, score, is_toxic, n_restored, hits)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))  # 27**4 numbers and a lexicon of bounded support

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value)
        for batch in batches:
            scores, counts, hits = zip(*(judge.score(text.as_py() or "") for text in batch.column(1))) if len(batch) else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([s >= threshold for s in scores], pa.bool_()), pa.array(counts, pa.int32()), pa.array(hits, pa.list_(pa.string()))],
                names=["doc_id", "score", "is_toxic", "n_restored", "hits"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, SCHEMA)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that toxicity() doesn't call toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = Judge(*shared.value)
        for texts in batches:
            yield pd.Series([judge.score(t or "")[0] < threshold for t in texts], dtype=bool)

    return docs.filter(F.pandas_udf(clean, "boolean")(F.col(text_col).cast("string")))

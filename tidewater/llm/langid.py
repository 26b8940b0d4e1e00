"""Language identification: scripts narrow the candidates, word scores and a switching penalty give spans of languages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm import viterbi
from tidewater.llm.shared import byte_slices

#: Hashed buckets of character runs of 1 to 4 letters, and of whole words.
BUCKETS = 1 << 15
#: Texts of each language that the model is fitted on, about, and most languages that it can hold.
SAMPLE, LANGUAGES = 3000, 256
#: What a change of language costs, and bounds on a word's score (natural logarithms), so that one odd word costs no more than a change.
SWITCH, MOST = 6.0, 4.0
#: Score of a word in a language that isn't written in its script: no path takes it while another language is.
BARRED = -1e6
#: Added to the share of letters of the language that a text opens in, a few hundredths: a tie-break where two are nearly even.
OPENING = 0.05
#: Share of a language's letters that a script needs to count as one of its scripts.
SCRIPT_SHARE = 0.01
#: Words kept with their scores in each task.
KNOWN_WORDS = 300_000
#: Scores of words that a task holds at once, about; with many languages it so keeps fewer words and takes less text at a time.
HELD_NUMBERS = 16_000_000

# First code points of ranges and their scripts.
SCRIPTS = ("none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "georgian", "hangul", "kana", "han", "other")
_RANGES = (
    (0x0, "none"), (0x41, "latin"), (0x5B, "none"), (0x61, "latin"), (0x7B, "none"), (0xAA, "latin"), (0xAB, "none"), (0xB5, "latin"), (0xB6, "none"), (0xBA, "latin"), (0xBB, "none"),
    (0xC0, "latin"), (0xD7, "none"), (0xD8, "latin"), (0xF7, "none"), (0xF8, "latin"), (0x2B0, "none"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"),
    (0x600, "arabic"), (0x780, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1C90, "georgian"), (0x1CC0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2C00, "other"), (0x2E00, "none"), (0x2E80, "han"), (0x3000, "none"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x31F0, "kana"), (0x3200, "none"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "none"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"),
    (0xFF00, "none"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "none"), (0x10000, "other"), (0x1F000, "none"), (0x20000, "han"),
)
_STARTS = np.array([a for a, _ in _RANGES], np.uint32)
_SCRIPT_OF = np.array([SCRIPTS.index(s) for _, s in _RANGES], np.uint8)

#: Word characters of `re` less digits and the underscore, and of these runs the letters: numbers such as fractions are none.
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def word_spans(text: str) -> list[tuple[int, int]]:
    """Starts and ends of a text's runs of letters (category L)."""
    out = []
    for m in _WORD.finditer(text):
        out += [m.span()] if m[0].isalpha() else [p.span() for p in _LETTERS.finditer(text, *m.span())]
    return out


def words_of(text: str) -> list[str]:
    found = _WORD.findall(text)
    return found if all(map(str.isalpha, found)) else [text[a:b] for a, b in word_spans(text)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def scripts(points: np.ndarray) -> np.ndarray:
    return _SCRIPT_OF[np.searchsorted(_STARTS, points, side="right") - 1]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' character runs, one word after another, and their count for each word."""
    points = code_points("".join(f"\x02{w}\x03" for w in words)).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(points))
    owner = np.repeat(np.arange(len(words)), lengths)
    out, owners = [], []
    value = np.zeros(len(points), np.uint64)
    for n in range(1, 5):
        value = value[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        inside = at[: len(value)] + n <= ends[: len(value)]
        out.append((value[inside] ^ (value[inside] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 15))
        owners.append(owner[: len(value)][inside])
    buckets, owners = np.concatenate(out).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.bincount(owners, minlength=len(words))


def _counts(batches: Iterator[pa.RecordBatch], at: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Counts of buckets and scripts for each language, by its place, over all texts of a task."""
    sums: dict[str, np.ndarray] = {}
    for batch, texts in byte_slices(batches):
        langs = batch.column("lang").to_pylist()
        for lang in set(langs):
            text = " ".join(t.decode("utf-8", "replace").lower() for t, own in zip(texts, langs, strict=True) if own == lang)
            words = words_of(text)
            if words:
                kinds = Counter(words)
                buckets, runs = word_features(list(kinds))
                hits = np.bincount(buckets, np.repeat(np.fromiter(kinds.values(), float, len(kinds)), runs), minlength=BUCKETS)
                seen = np.bincount(scripts(code_points("".join(words))), minlength=len(SCRIPTS))
                sums[lang] = sums.get(lang, 0) + np.concatenate([hits, seen])
    for lang, values in sums.items():
        full = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), at[lang]), pa.int32()), pa.array(full, pa.int64()), pa.array(values[full], pa.float64())], names=["lang", "i", "n"])


class Model:
    """Scores of buckets for each language, and the scripts that each is written in."""

    def __init__(self, langs: list[str], hits: np.ndarray, seen: np.ndarray):
        self.langs = langs
        share = (hits + 0.5) / (hits.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        logs = np.log(share)
        self.scores = (logs - logs.sum(axis=0) / max(1, len(langs))).T.astype(np.float32)  # bucket x language
        self.prior = hits.sum(axis=1) / max(1, hits.sum())
        letters = seen[:, 1:].sum(axis=1, keepdims=True)
        self.allowed = seen >= np.maximum(SCRIPT_SHARE * letters, 1)  # language x script


def fit(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """A model of the languages in `docs` (doc_id, text, lang), from about `sample` texts of each.

    The texts are those whose hash is lowest, one at least, so each is taken or not by itself: no sort and no shuffle of texts, and a
    language with a third of all rows is no more work than another. Counts of buckets are summed by Spark; at most
    `languages` times BUCKETS numbers reach the driver. Every value of `lang` is learned, however rare; with more than
    `languages` of them no model is made and a ValueError says so. Rows without text or lang teach nothing; repeated rows
    count as often as they stand; an empty table gives a model without languages.
    """
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003
    sizes = docs.where("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("count"), F.min(draw).alias("least"))
    sizes = sizes.limit(languages + 1).collect()
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} values of lang: a model holds no more, and none is left out")
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPTS))))
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], max(r["least"], min(1.0, sample / r["count"])))))
    taken = docs.where(F.col("lang").isin(langs) & F.col("text").isNotNull()).where(draw <= F.element_at(share, F.col("lang")))
    sums = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    counted = taken.select("text", "lang").mapInArrow(partial(_counts, at={lang: k for k, lang in enumerate(langs)}), "lang int, i long, n double")
    found = counted.groupBy("lang", "i").agg(F.sum("n").alias("n")).toArrow()
    sums[found["lang"].to_numpy(), found["i"].to_numpy()] = found["n"].to_numpy()
    return Model(langs, sums[:, :BUCKETS], sums[:, BUCKETS:])


class Identifier:
    """Labels the words of batches of texts; the scores of words are kept."""

    def __init__(self, model: Model):
        self.model = model
        held = HELD_NUMBERS // max(1, len(model.langs))
        self.most_known, self.most_chars, self.most_scored = min(KNOWN_WORDS, held), 4 * held, max(1, min(20_000, held // 32))
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.langs)), np.float32)

    def _score(self, words: list[str]) -> np.ndarray:
        """Sums over a word's runs, bounded; languages that don't use its script are no candidates, unless none does."""
        buckets, runs = word_features(words)
        starts = np.cumsum(runs) - runs
        scores = np.add.reduceat(self.model.scores[buckets], starts, axis=0) / np.sqrt(runs)[:, None]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        kinds = scripts(code_points("".join(words)))
        own = np.zeros((len(words), len(SCRIPTS)), np.int64)
        np.add.at(own, (np.repeat(np.arange(len(words)), lengths), kinds), 1)
        script = own[:, 1:].argmax(axis=1) + 1
        scores = np.clip(scores, -MOST, MOST)
        allowed = self.model.allowed[:, script].T
        return np.where(allowed | ~allowed.any(axis=1, keepdims=True), scores, BARRED).astype(np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        if len(self.at) > self.most_known:
            self._reset()
        get = self.at.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        missing = list(dict.fromkeys(words[i] for i in np.flatnonzero(ids < 0).tolist()))
        if missing:
            first = len(self.at)
            while len(self.rows) < first + len(missing):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for a in range(0, len(missing), self.most_scored):
                part = missing[a : a + self.most_scored]
                self.rows[first + a : first + a + len(part)] = self._score(part)
            self.at.update(zip(missing, range(first, first + len(missing)), strict=True))
            for i in np.flatnonzero(ids < 0).tolist():
                ids[i] = self.at[words[i]]
        return ids

    def label(self, texts: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """For each text its words, and for each word the index of its language and the words' scores."""
        words = [words_of(t.lower()) for t in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self._ids([w for own in words for w in own])
        scores = self.rows[ids]
        labels = viterbi.decode(scores, lengths, SWITCH) if len(ids) and scores.shape[1] else np.zeros(len(ids), np.int16)
        ends = np.cumsum(lengths)
        return [(w, labels[e - n : e], scores[e - n : e]) for w, n, e in zip(words, lengths, ends, strict=True)]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of runs of words of one language, in code points of the text."""
        (_, labels, _), out = self.label([text])[0], []
        places = word_spans(text)
        if len(places) != len(labels):  # lower-casing changed what is a word; offsets are those of the lower-cased text
            places = word_spans(text.lower())
        for (a, b), k in zip(places, labels, strict=True):
            if out and out[-1][2] == self.model.langs[k]:
                out[-1] = (out[-1][0], b, out[-1][2])
            else:
                out.append((a, b, self.model.langs[k]))
        return out

    def _parts(self, texts: list[str]) -> Iterator[list[str]]:
        """The texts in turn, about most_chars characters at a time; a longer text comes alone."""
        part, held = [], 0
        for text in texts:
            if part and held + len(text) > self.most_chars:
                yield part
                part, held = [], 0
            part.append(text)
            held += len(text)
        if part:
            yield part

    def predict(self, texts: list[str]) -> list[tuple[str, float, int]]:
        """Language of most letters, its share of them as the score, and the number of spans. OPENING goes to the first span's."""
        out = []
        for words, labels, scores in (found for part in self._parts(texts) for found in self.label(part)):
            if not words or not self.model.langs:
                out.append(("und", 0.0, 0))
                continue
            letters = np.bincount(labels, np.fromiter(map(len, words), np.float64, len(words)), minlength=len(self.model.langs))
            share = letters / letters.sum()
            weight = share.copy()
            weight[labels[0]] += OPENING
            best = int(np.lexsort((self.model.prior, scores.sum(axis=0, dtype=np.float64), weight))[-1])
            out.append((self.model.langs[best], float(share[best]), 1 + int((labels[1:] != labels[:-1]).sum())))
        return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, n_spans) for every row of `docs` (doc_id, text); `und` with score 0 for no letters or null.

    Only the text is read, whole and whatever its length; other columns may have any names. Letters of scripts that no
    language is written in are scored by their runs all the same. Each row is judged by itself, so repeated rows and rows
    of one or no doc_id have their own results. Of languages with as many letters (and OPENING) that with the greater sum
    of word scores wins, then the one with more training text, then the later in the alphabet. A model without languages
    gives `und`; an empty table gives no rows.
    """
    id_type, made = docs.schema["doc_id"].dataType, []

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Identifier(model))
        for batch, texts in byte_slices(batches):
            found = made[0].predict([t.decode("utf-8", "replace") for t in texts])
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "lang_pred", "score", "n_spans"])

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.IntegerType())])
    return docs.select("doc_id", "text").mapInArrow(each, schema)

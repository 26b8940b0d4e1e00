"""Quality rules: base counts, then the divergence of a text's histograms from those of its language."""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.shared import byte_slices, map_texts, stored

#: Character classes, in the histogram's order.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")
#: Ends of sentences and other punctuation of running text; the symbols that are counted by themselves.
STOPS, SYMBOLS = ".,;:'\"-()?", "#*$%&|<>"
#: Base rule: least words, and most percent of words in repeated windows of WINDOW words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: Verdict: a text is rejected if its Jensen-Shannon distance (base 2, from 0 to 1) to the nearest reference is beyond
#: a + b / sqrt(words): short texts stray by chance. Below the guard, in words, it isn't judged.
CHAR_LIMIT, CHAR_GUARD = (0.20, 1.2), 20
WORD_LIMIT, WORD_GUARD = (0.12, 2.0), 60
#: Words that a text needs to be counted in its language's reference.
REFERENCE_WORDS = 40
#: Common words that are learned of a language, the texts that it needs for a reference, and such languages at most.
LEARNED_WORDS, REFERENCE_TEXTS, LANGUAGES = 30, 50, 256
#: Words counted in a task before they are passed on, and numbers of word histograms that a task handles at once.
COUNTED_WORDS, HELD_NUMBERS = 300_000, 2_000_000

_PUNCTUATION = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


class Vocabulary(NamedTuple):
    """Where each common word of any language is counted, and for each language the places of its own."""

    at: dict[bytes, int]
    places: dict[str, list[int]]

    @classmethod
    def of(cls, words: dict[str, list[bytes]]) -> Vocabulary:
        at = {w: i for i, w in enumerate(sorted({w for own in words.values() for w in own}))}
        return cls(at, {lang: [at[w] for w in own] for lang, own in words.items()})


@cache
def _class_table() -> np.ndarray:
    """The class of each code point."""
    table = np.full(sys.maxunicode + 1, CLASSES.index("other"), np.uint8)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if ch in SYMBOLS:
            table[c] = CLASSES.index("symbol")
        elif ch in " \t\n\x0b\x0c\r":
            table[c] = CLASSES.index("space")
        elif ch in STOPS:
            table[c] = CLASSES.index("stop")
        elif kind == "Lu":
            table[c] = CLASSES.index("upper")
        elif kind[0] == "L" or kind[0] == "M":
            table[c] = CLASSES.index("lower")
        elif kind == "Nd":
            table[c] = CLASSES.index("digit")
    return table


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words which is in the text twice or more."""
    if len(words) <= WINDOW:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    hashes = np.zeros(len(words) - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(hashes)]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    return len(lines) - len(set(lines))


def plain_words(text: bytes) -> list[bytes]:
    """The words that histograms are of: A-Z lower-cased, without ASCII punctuation."""
    return text.lower().translate(_PUNCTUATION).split()


def profile(texts: list[bytes], vocabulary: Vocabulary) -> dict[str, list]:
    """Base counts and histograms of each text; that of common words as pairs of a place and its count, all other words last."""
    table, at, rows = _class_table(), vocabulary.at, []
    for text in texts:
        words = text.split()
        points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        chars = np.bincount(table[points], minlength=len(CLASSES))
        plain = plain_words(text)
        places, counts = np.unique(np.fromiter((at.get(w, len(at)) for w in plain), np.int64, len(plain)), return_counts=True)
        common = np.stack([places, counts], axis=1)
        space = CLASSES.index("space")
        rows.append((len(words), int(len(points) - chars[space]), int(chars[CLASSES.index("symbol")]), duplicate_lines(text), repeated_words(words), chars.astype("<i8").tobytes(), common.astype("<i8").tobytes()))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common")
    return {n: [r[i] for r in rows] for i, n in enumerate(names)}


def char_shares(chars: list[bytes]) -> np.ndarray:
    """Character shares without space."""
    counts = np.frombuffer(b"".join(chars), "<i8").reshape(-1, len(CLASSES))[:, [i for i, c in enumerate(CLASSES) if c != "space"]].astype(float)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def word_counts(common: list[bytes], vocabulary: Vocabulary) -> Iterator[tuple[slice, np.ndarray]]:
    """Counts of all common words, with those of all others last, for some of the texts at a time."""
    width = len(vocabulary.at) + 1
    step = max(1, HELD_NUMBERS // width)
    for a in range(0, len(common), step):
        part = common[a : a + step]
        pairs = np.frombuffer(b"".join(part), "<i8").reshape(-1, 2)
        counts = np.zeros((len(part), width))
        counts[np.repeat(np.arange(len(part)), [len(c) // 16 for c in part]), pairs[:, 0]] = pairs[:, 1]
        yield slice(a, a + len(part)), counts


def word_shares(counts: np.ndarray, places: list[int]) -> np.ndarray:
    """Shares of a language's common words with those of all others last."""
    own, total = counts[:, places], counts.sum(axis=1, keepdims=True)
    return np.hstack([own, total - own.sum(axis=1, keepdims=True)]) / np.maximum(total, 1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of p to q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def _base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _word_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the shares, in millionths, of each word in the texts of each language that count for a reference."""

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.binary()), pa.array(sums.values(), pa.int64())], names=["lang", "word", "n"])

    sums: Counter[tuple[str, bytes]] = Counter()
    for batch, texts in byte_slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            words = text.split()
            if len(words) < max(LEAST_WORDS, REFERENCE_WORDS) or 100 * repeated_words(words) > MOST_REPEATED * len(words):
                continue
            plain = plain_words(text)
            for word, n in Counter(plain).items():
                sums[lang, word] += 1_000_000 * n // len(plain)
            if len(sums) > COUNTED_WORDS:
                yield made()
                sums.clear()
    yield made()


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The common words of every language in `docs` (text, lang) with REFERENCE_TEXTS texts or more, LEARNED_WORDS of each.

    Those are the words with the greatest mean shares over all of the language's texts that count for its reference, of
    equal ones the smaller. Words are summed by Spark, and LEARNED_WORDS of each language come to the driver; with more
    than LANGUAGES languages a ValueError says so.
    """
    some = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = [r["lang"] for r in some.groupBy("lang").count().where(F.col("count") >= REFERENCE_TEXTS).limit(LANGUAGES + 1).collect()]
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of lang have {REFERENCE_TEXTS} texts: no more references are held, and none is left out")
    words: dict[str, list[bytes]] = {}
    if langs:
        sums = some.where(F.col("lang").isin(langs)).select("text", "lang").mapInArrow(_word_sums, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
        for r in sums.withColumn("rank", rank).where(F.col("rank") <= LEARNED_WORDS).orderBy("lang", "rank").collect():
            words.setdefault(r.lang, []).append(bytes(r.word))
    return Vocabulary.of(words)


def _sums(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Sums of the shares of the texts in each language; each text counts alike, however long."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        chars = char_shares(batch.column("chars").to_pylist())
        for part, counts in word_counts(batch.column("common").to_pylist(), vocabulary):
            for lang in set(langs[part]):
                own = langs[part] == lang
                sums[lang] = sums.get(lang, 0) + np.concatenate([[own.sum()], chars[part][own].sum(axis=0), word_shares(counts[own], vocabulary.places[lang]).sum(axis=0)])
    for lang, values in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["lang", "i", "v"])


def references(profiles: DataFrame, vocabulary: Vocabulary) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean character and common-word shares of each language of the vocabulary, over all texts that pass the base rule.

    Some forty numbers of each language come to the driver, however large the corpus. A language with less than
    REFERENCE_TEXTS such texts has no reference.
    """
    fit = profiles.where(~_base_failed() & (F.col("n_words") >= REFERENCE_WORDS) & F.col("lang").isin(*vocabulary.places))
    sums: dict[str, dict[int, float]] = {}
    for r in fit.select("lang", "chars", "common").mapInArrow(partial(_sums, vocabulary=vocabulary), "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r.lang, {})[r.i] = r.v
    out = {}
    for lang, at in sorted(sums.items()):
        if at[0] >= REFERENCE_TEXTS:
            values = np.array([at[i] for i in range(len(at))]) / at[0]
            out[lang] = (values[1 : len(CLASSES)], values[len(CLASSES) :])
    return out


def _verdicts(made: dict[str, list], langs: list, vocabulary: Vocabulary, known: dict[str, tuple[np.ndarray, np.ndarray]], char_limit: tuple[float, float], word_limit: tuple[float, float]) -> dict[str, pa.Array]:
    """Distances and verdicts of the texts with the profiles `made`."""
    words, repeated = np.array(made["n_words"], np.int64), np.array(made["n_repeat_words"], np.int64)
    chars = char_shares(made["chars"])
    char_far = np.min([distance(chars, c) for c, _ in known.values()], axis=0) if known else np.zeros(len(words))
    word_far = np.zeros(len(words))
    for part, counts in word_counts(made["common"], vocabulary) if known else ():
        word_far[part] = np.min([distance(word_shares(counts, vocabulary.places[lang]), w) for lang, (_, w) in known.items()], axis=0)
    failed = (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)
    has_own = np.array([lang in known for lang in langs], bool)
    kept, out = ~failed, {}
    for name, far, guard, limit in (("char_distance", char_far, CHAR_GUARD, char_limit), ("word_distance", word_far, WORD_GUARD, word_limit)):
        judged = (words >= guard) & has_own
        kept &= ~judged | (far <= limit[0] + limit[1] / np.sqrt(np.maximum(words, 1)))
        out[name] = pa.array(far, mask=~judged)
    return out | {"base_failed": pa.array(failed), "kept": pa.array(kept)}


def judge(docs: DataFrame, char_limit: tuple[float, float] = CHAR_LIMIT, word_limit: tuple[float, float] = WORD_LIMIT) -> DataFrame:
    """(doc_id, base counts, char_distance, word_distance, base_failed, kept) for every row of `docs` (doc_id, text, lang).

    A text's distance is the least to any language's reference. A row whose own `lang` has no reference (null, or too few
    texts to learn one) is left unjudged by it, as is one below the guards: its distance is null and only the base rule
    holds. A null or empty text has no words, so it fails the base rule; a text of any length is judged whole. Each row is
    judged by itself, so repeated rows and rows of one or no doc_id have their own verdicts, alike for equal rows; all of
    them count in the references. A distance equal to the limit is within it. Other columns are not read, whatever their
    names; an empty table gives no rows.
    """
    known_words = vocabulary(docs)
    profiles = stored(map_texts(docs, partial(profile, vocabulary=known_words), f"{BASE}, chars binary, common binary", ("doc_id", "lang")), "profiles")
    known = references(profiles, known_words)
    given = [n.split()[0] for n in BASE.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {n: batch.column(n).to_pylist() for n in (*given, "chars", "common")}
            found = _verdicts(made, batch.column("lang").to_pylist(), known_words, known, char_limit, word_limit)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(n) for n in given), *found.values()], names=["doc_id", *given, *found])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return profiles.mapInArrow(each, f"doc_id {id_type}, {BASE}, char_distance double, word_distance double, base_failed boolean, kept boolean")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that judge() rejects. Each row is judged by itself, whatever its doc_id and the rows beside it.

    Texts are read three times, for common words, for the references and for the verdicts; no text is shuffled or stored. Null and empty texts go,
    as they fail the base rule; of repeated rows all stay or all go. All columns pass as they are, whatever their names; an
    empty table gives an empty table.
    """
    known_words = vocabulary(docs)
    known = references(map_texts(docs, partial(profile, vocabulary=known_words), f"{BASE}, chars binary, common binary", ("lang",)), known_words)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches):
            found = _verdicts(profile(texts, known_words), batch.column("lang").to_pylist(), known_words, known, CHAR_LIMIT, WORD_LIMIT)
            yield batch.filter(found["kept"])

    return docs.mapInArrow(each, docs.schema)

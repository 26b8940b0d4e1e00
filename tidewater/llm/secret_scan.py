"""Secrets in text: patterns, and formats of credentials learned as probabilistic automata from labelled examples."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from tidewater.llm.shared import map_texts

KINDS = ("assign", "access", "hex", "secret")
#: The patterns as they are defined. A run of hex digits or of a key's characters is taken whole, so its length is in the pattern.
_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
#: What a match of the first holds in lower case, one of each.
_NEEDS = (":", "="), ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind index) of the patterns' matches that are long enough, by start and then kind."""
    may = any(c in text for c in _NEEDS[0]) and any(map(text.lower().count, _NEEDS[1]))
    spans = [(*m.span(), 0) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] if may else []
    spans += [(*m.span(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    spans += [(*m.span(), 2) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], s[2]))


# The labelled table.

#: What may enclose a run without being part of it.
_OUTER = "./-_"
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = _UPPER + _LOWER + _DIGIT
_URL64, _BASE64 = _ALNUM + "-_", _ALNUM + "+/"

# How well-known credentials are written. Each is a list of parts: text, or characters and least and most of them.
FORMATS: dict[str, list] = {
    "code_host": [("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), (_ALNUM, 36, 36)],
    "code_host_fine": [("github_pat_",), (_ALNUM, 22, 22), ("_",), (_ALNUM, 59, 59)],
    "code_host_other": [("glpat-",), (_URL64, 20, 20)],
    "chat": [("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), (_DIGIT, 10, 13), ("-",), (_DIGIT, 10, 13), ("-",), (_ALNUM, 24, 24)],
    "payment": [("sk_live_", "sk_test_", "rk_live_", "rk_test_", "pk_live_"), (_ALNUM, 24, 34)],
    "maps": [("AIza",), (_URL64, 35, 35)],
    "packages": [("npm_",), (_ALNUM, 36, 36)],
    "packages_other": [("pypi-",), (_URL64, 85, 180)],
    "mail": [("SG.",), (_URL64, 22, 22), (".",), (_URL64, 43, 43)],
    "signed": [("eyJ",), (_URL64, 17, 60), (".eyJ",), (_URL64, 20, 160), (".",), (_URL64, 43, 43)],
    "service": [("sk-",), (_ALNUM, 32, 48)],
    "base64_key": [(_BASE64, 40, 40)],
    "base64_key_padded": [(_BASE64, 43, 43), ("=",)],
    "plain_key": [(_ALNUM, 32, 32)],
    "upper_hex": [(_DIGIT + "ABCDEF", 32, 32)],
    "upper_hex_long": [(_DIGIT + "ABCDEF", 40, 40)],
}
#: Labelled examples of a format, and of runs that are no credentials.
EXAMPLES, PLAIN = 150, 3000


def labelled(seed: int = 13, examples: int = EXAMPLES, plain: int = PLAIN) -> dict[str, list[str]]:
    """The small labelled table, made by rule: credentials of each format, and under `plain` other runs of the same characters."""
    rng = random.Random(seed)
    some = lambda of, least, most: "".join(rng.choice(of) for _ in range(rng.randint(least, most)))
    credential = lambda parts: "".join(some(*p) if isinstance(p[-1], int) else rng.choice(p) for p in parts)
    table = {name: [credential(parts) for _ in range(examples)] for name, parts in FORMATS.items()}
    vowels = "aeiou"

    def word(least: int = 2, most: int = 12) -> str:
        return "".join(rng.choice(vowels) if rng.random() < 0.42 else rng.choice("bcdfghjklmnprstvwz" + "nrstl" * 3) for _ in range(rng.randint(least, most)))

    name = lambda: rng.choice([word(), word().capitalize()])
    digits = lambda a, b: some(_DIGIT, a, b)
    kinds = [
        lambda: word(10, 40),
        lambda: rng.choice([word(10, 30).upper(), word(10, 30).capitalize()]),
        lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 6))),
        lambda: rng.choice("_-").join(name() for _ in range(rng.randint(2, 8))),
        lambda: "_".join(word().upper() for _ in range(rng.randint(2, 5))),
        lambda: ".".join([*(word() for _ in range(rng.randint(1, 4))), rng.choice(["com", "org", "example.com", "net"])]),
        lambda: "/".join([*(name() for _ in range(rng.randint(2, 8))), rng.choice(["index.html", word() + ".py", digits(1, 6), ""])]),
        lambda: f"/{word()}/{word()}/{digits(1, 4)}-{digits(2, 2)}-{digits(2, 2)}/{word()}_{digits(1, 8)}.{rng.choice(['csv', 'jpg', 'parquet', 'tar.gz'])}",
        lambda: f"20{digits(2, 2)}-{digits(2, 2)}-{digits(2, 2)}T{digits(2, 2)}",
        lambda: digits(6, 24),
        lambda: "-".join(some(_DIGIT + "abcdef", n, n) for n in (8, 4, 4, 4, 12)),
        lambda: rng.choice("-=._/+") * rng.randint(8, 60),
        lambda: f"{word()}{digits(1, 4)}.{word()}{digits(0, 2)}.example.com",
        lambda: "+".join(word() for _ in range(rng.randint(2, 6))),
        lambda: f"{word()}={name()}",
        lambda: f"{word()}-{digits(1, 2)}.{digits(1, 2)}.{digits(1, 3)}-{word()}",
        lambda: f"{digits(1, 3)}.{digits(1, 9)}",
    ]
    runs = [rng.choice(kinds)() for _ in range(plain)]
    table["plain"] = runs + [bare for r in runs if (bare := r.strip(_OUTER)) != r]
    return table


# Grammar inference.

#: Classes of characters, on which states have transitions; each other character of a run is a class of its own.
_CLASSES = (_LOWER, _UPPER, _DIGIT, "+", "/", "_", ".", "=", "-")
_CLASS_OF = {c: k for k, of in enumerate(_CLASSES) for c in of}
#: How rarely two states that behave alike may be kept apart by a test.
ALPHA = 1e-4


@dataclass
class State:
    """Visits, ends, and for each character class the characters that were read there and the next state."""

    visits: int = 0
    ends: int = 0
    read: dict[int, Counter] = field(default_factory=dict)
    next: dict[int, int] = field(default_factory=dict)


def prefix_tree(words: list[str]) -> list[State]:
    """A state for each beginning of the words' classes."""
    states = [State()]
    for word in words:
        at = 0
        for c in word:
            states[at].visits += 1
            k = _CLASS_OF[c]
            states[at].read.setdefault(k, Counter())[c] += 1
            if k not in states[at].next:
                states[at].next[k] = len(states)
                states.append(State())
            at = states[at].next[k]
        states[at].visits += 1
        states[at].ends += 1
    return states


def _alike(x: int, n: int, y: int, m: int, bound: float) -> bool:
    """Hoeffding's test: whether x of n and y of m may come from one rate."""
    return abs(x / n - y / m) < bound * (n**-0.5 + m**-0.5)


def compatible(states: list[State], a: int, b: int, alpha: float = ALPHA) -> bool:
    """Whether two states, and then all that follows them alike, pass the test for their ends, classes and characters."""
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    pairs = [(a, b)]
    while pairs:
        x, y = (states[s] for s in pairs.pop())
        if not _alike(x.ends, x.visits, y.ends, y.visits, bound):
            return False
        for k in x.read.keys() | y.read.keys():
            of_x, of_y = x.read.get(k, Counter()), y.read.get(k, Counter())
            if not _alike(of_x.total(), x.visits, of_y.total(), y.visits, bound):
                return False
            if any(not _alike(of_x[c], x.visits, of_y[c], y.visits, bound) for c in of_x.keys() | of_y.keys()):
                return False
        pairs += [(x.next[k], y.next[k]) for k in x.next.keys() & y.next.keys()]
    return True


def _fold(states: list[State], into: int, other: int) -> None:
    """Adds the tree under `other` to what is under `into`."""
    pairs = [(into, other)]
    while pairs:
        a, b = pairs.pop()
        x, y = states[a], states[b]
        x.visits += y.visits
        x.ends += y.ends
        for k, read in y.read.items():
            x.read.setdefault(k, Counter()).update(read)
            if k in x.next:
                pairs.append((x.next[k], y.next[k]))
            else:
                x.next[k] = y.next[k]


def infer(words: list[str], alpha: float = ALPHA) -> list[State]:
    """A probabilistic automaton: states of the words' prefix tree merged wherever they are statistically compatible.

    Kept states are visited from the root; of the states that hang on them the most visited comes next and is folded into
    the first kept state that it is compatible with, or else is kept. Only trees hang on kept states, so folding ends.
    """
    states = prefix_tree(words)
    kept = [0]
    while True:
        is_kept = set(kept)
        hanging = [(-states[s].visits, r, k, s) for r in kept for k, s in states[r].next.items() if s not in is_kept]
        if not hanging:
            break
        _, r, k, s = min(hanging)
        for into in kept:
            if compatible(states, into, s, alpha):
                states[r].next[k] = into
                _fold(states, into, s)
                break
        else:
            kept.append(s)
    place = {s: i for i, s in enumerate(kept)}
    return [State(states[s].visits, states[s].ends, states[s].read, {k: place[n] for k, n in states[s].next.items()}) for s in kept]


# Scores.

#: What is added to counts, and the log of the odds beyond which a run is taken for a credential.
SMOOTH, ODDS = 0.1, 8.0
#: Runs that are scored at once, some 20 MB.
SCORED = 20_000


class Formats:
    """The automata of all formats and of plain runs as tables, so that many runs are scored against all of them at once."""

    def __init__(self, table: dict[str, list[str]]):
        self.names = [n for n in table if n != "plain"] + ["plain"]
        automata = [infer(table[n]) for n in self.names]
        self.sizes = [len(a) for a in automata]
        self.starts = np.cumsum([0, *self.sizes[:-1]])
        total = sum(self.sizes)
        self.next = np.zeros((total, len(_CLASSES)), np.int32)
        self.log = np.zeros((total, 128), np.float32)
        for start, automaton in zip(self.starts, automata, strict=True):
            for i, state in enumerate(automaton):
                going = sum(read.total() for read in state.read.values())
                for k, of in enumerate(_CLASSES):
                    read = state.read.get(k, Counter())
                    self.next[start + i, k] = start + state.next.get(k, i)
                    share = (read.total() + SMOOTH) / (going + SMOOTH * len(_CLASSES))
                    for c in of:
                        self.log[start + i, ord(c)] = math.log(share * (read[c] + SMOOTH) / (read.total() + SMOOTH * len(of)))
        lengths = [Counter(map(len, table[n])) for n in self.names[:-1]]
        self.shortest, self.longest = min(min(c) for c in lengths), max(max(c) for c in lengths)
        # A credential has a length that its format was seen with, or one between them; plain runs have any.
        self.lengths = np.full((self.longest + 1, len(self.names)), -np.inf, np.float32)
        for f, c in enumerate(lengths):
            width = max(c) - min(c) + 1
            for n in range(min(c), max(c) + 1):
                self.lengths[n, f] = math.log(0.8 * c[n] / c.total() + 0.2 / width)
        self.lengths[:, -1] = -math.log(self.longest)
        self.classes = np.zeros(128, np.int64)
        for c, k in _CLASS_OF.items():
            self.classes[ord(c)] = k

    def score(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each run (none longer than the longest format) the likeliest format and the log of its odds against a plain run."""
        if len(runs) > SCORED:
            parts = [self.score(runs[i : i + SCORED]) for i in range(0, len(runs), SCORED)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        size = np.array([len(r) for r in runs], np.int64)
        order = np.argsort(-size, kind="stable")
        longest = int(size.max(initial=0))
        letters = np.zeros((len(runs), longest), np.uint8)
        for row, i in enumerate(order.tolist()):
            letters[row, : size[i]] = np.frombuffer(runs[i].encode("ascii"), np.uint8)
        states = np.repeat(self.starts[None], len(runs), axis=0)
        total = self.lengths[size[order]].astype(np.float64)
        active = np.searchsorted(-size[order], -np.arange(longest), side="left")
        for t in range(longest):
            n = active[t]
            c = letters[:n, t].astype(np.int64)[:, None]
            total[:n] += self.log[states[:n], c]
            states[:n] = self.next[states[:n], self.classes[c]]
        best = total[:, :-1].argmax(axis=1)
        odds = total[np.arange(len(runs)), best] - total[:, -1]
        out_best, out_odds = np.zeros(len(runs), np.int64), np.zeros(len(runs))
        out_best[order], out_odds[order] = best, odds
        return out_best, out_odds


@cache
def default_formats() -> Formats:
    return Formats(labelled())


#: Runs of the characters that credentials are written in, and where a run may join several things.
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_SPLITS = (re.compile(r"[^=/+]+"), re.compile(r"[^=/+.]+"))


def candidates(text: str, shortest: int, longest: int) -> list[tuple[int, int]]:
    """Starts and ends of all runs and of their parts between separators, with and without what may enclose them, as long as credentials can be."""
    out = []
    for m in _RUN.finditer(text):
        start, end = m.span()
        options = {(start, end)}
        for split in _SPLITS:
            options.update(p.span() for p in split.finditer(text, start, end))
        for a, b in options:
            bare = text[a:b].rstrip(_OUTER)
            inner = a + len(bare) - len(bare.lstrip(_OUTER)), a + len(bare)
            out += [(x, y) for x, y in {(a, b), inner} if shortest <= y - x <= longest]
    return sorted(set(out))


def finder(formats: Formats):
    """A function from UTF-8 texts to (base spans, all spans, format names of the added ones)."""

    def find(texts: list[bytes]) -> list[tuple[list, list, list]]:
        words = [t.decode("utf-8", "replace") for t in texts]
        places = [candidates(t, formats.shortest, formats.longest) for t in words]
        runs = [t[a:b] for t, own in zip(words, places, strict=True) for a, b in own]
        known = {r: i for i, r in enumerate(dict.fromkeys(runs))}
        best, odds = formats.score(list(known))
        out, at = [], 0
        for text, own in zip(words, places, strict=True):
            base = base_spans(text)
            added, of = [], [known[r] for r in runs[at : at + len(own)]]
            at += len(own)
            likely = sorted((i for i, k in enumerate(of) if odds[k] > ODDS), key=lambda i: (-odds[of[i]], own[i]))
            taken = bytearray(len(text) if likely else 0)
            for a, b in [s[:2] for s in base] if likely else ():
                taken[a:b] = b"\1" * (b - a)
            for i in likely:
                a, b = own[i]
                if taken.find(1, a, b) < 0:
                    taken[a:b] = b"\1" * (b - a)
                    added.append((a, b, formats.names[best[of[i]]]))
            spans = sorted([*base, *((a, b, 3) for a, b, _ in added)], key=lambda s: (s[0], s[2]))
            out.append((base, spans, sorted(added)))
        return out

    return find


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, table: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, formats) for every row of `docs` (doc_id, text).

    The three counts and base_sha256 are of the patterns' spans; `spans` has the automata's, too, as kind `secret`: n_added
    of them, which `formats` names as format:start:end. Offsets are code points, ends exclusive; malformed UTF-8 counts as
    U+FFFD. Added spans touch no other span; of those that overlap the one with the largest odds stays, then the first.
    Null and empty texts have none; a text of any length is read whole; rows are read each by itself, so repeated rows have
    equal results. Other columns are not read, whatever their names; an empty table gives no rows.
    `table` (labelled() by default) is what the automata are inferred from, on the driver; it has a few thousand short rows,
    whatever the corpus.
    """
    formats, made = default_formats() if table is None else Formats(table), []

    def each(texts: list[bytes]) -> dict[str, list]:
        if not made:
            made.append(finder(formats))
        found = made[0](texts)
        out = {f"n_{k}": [sum(s[2] == i for s in base) for base, _, _ in found] for i, k in enumerate(KINDS[:3])}
        out["base_sha256"] = [hashlib.sha256(written(base).encode()).hexdigest() for base, _, _ in found]
        out["spans"] = [written(spans) for _, spans, _ in found]
        out["n_added"] = [len(added) for _, _, added in found]
        out["formats"] = [",".join(f"{name}:{a}:{b}" for a, b, name in added) for _, _, added in found]
        return out

    return map_texts(docs, each, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, formats string")

"""Personal data and secrets: patterns with checks, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache, lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import viterbi
from tidewater.llm.shared import free_name, map_texts

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("none", *KINDS)

# The patterns as they are defined, but written so that no text makes them go back over it: a run of digits is entered at
# its start alone, and never given back.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: A token is a run without white space; of a longer run than LONG characters each part up to a delimiter, cut every LONG
#: characters where there is none, so that all characters of a text are in some token's features.
LONG = 64
_RUN = re.compile(r"[^\x20\x09-\x0D]+")
_PART = re.compile(rf"[^=&;,{{}}\"'<>|:?]{{1,{LONG}}}[=&;,{{}}\"'<>|:?]{{0,8}}|[=&;,{{}}\"'<>|:?]{{1,{LONG}}}")


def tokens_of(text: str) -> list[str]:
    found = _RUN.findall(text)
    return found if max(map(len, found), default=0) <= LONG else [text[a:b] for a, b in token_spans(text)]


def token_spans(text: str) -> list[tuple[int, int]]:
    """Starts and ends of a text's tokens."""
    spans = [m.span() for m in _RUN.finditer(text)]
    if all(b - a <= LONG for a, b in spans):
        return spans
    return [part for a, b in spans for part in ([(a, b)] if b - a <= LONG else [m.span() for m in _PART.finditer(text, a, b)])]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ outwards, as what stands before an @ can't hold another."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, end := domain.end()))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind index) of the patterns' matches that pass their checks, by start and then kind."""
    spans = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        spans += [(*m.span(), 1) for m in _IP.finditer(text) if all(int(p[-4:] if p.lstrip("0")[3:] == "" else 999) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((*m.span(), 2))
        spans += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans, key=lambda s: (s[0], s[2]))


# The model.

#: Hashed features of a token, and steps and rates of the training.
BUCKETS, STEPS, RATE, DECAY = 4096, 100, 0.1, 2e-3
#: Words that name what follows them.
CUES = ("password", "passwd", "pwd", "token", "secret", "key", "api", "tel", "phone", "fax", "call", "mail", "card", "version", "akia")
_CUE = re.compile("|".join(CUES))
#: A word for a secret with a sign that gives it a value, and the value if it is in the same token.
_GIVES = re.compile(r"(?:password|passwd|pwd|token|secret|key)[\"']?[:=][\"']?(.*)", re.DOTALL)
_SECRET_CUES = {"password", "passwd", "pwd", "token", "secret", "key"}
#: Tokens kept with their features in each task.
KNOWN_TOKENS = 200_000


#: Code points to their class: letters to x or X, digits to 9. Beyond Latin, characters stand for themselves.
_CLASS = {c: "9" if chr(c).isdigit() else "X" if chr(c).isupper() else "x" for c in range(0x250) if chr(c).isalnum()}
_HEX = re.compile(r"(?:.*=)?[\"']?[0-9a-fA-F]{16,}[\"']?[.,;:!?&}|<>]*\Z")


@lru_cache(100_000)
def _class_features(classes: str, length: int, hexes: bool) -> tuple[int, ...]:
    body = classes.strip(".,;:!?\"'()")
    upper, digit, lower, size = body.count("X"), body.count("9"), body.count("x"), min(length, 40)
    marks = f"{upper > 0}{digit > 0}{lower > 0}{'=' in body}{'@' in body}"
    short = re.sub(r"(.)\1\1+", r"\1\1", body)
    names = [f"s{short}", f"m{marks}", f"n{size // 4}", f"nm{size // 8}{marks}", f"d{digit // 2}", f"h{hexes}", f"e{classes[-1:]}"]
    return tuple(crc32(n.encode()) % BUCKETS for n in names)


def features(token: str) -> list[int]:
    """Hashed features of a token's shape (classes of its characters, runs cut to two), length, end, quote and cue words.

    All but the last two depend on the classes alone, so that few kinds of tokens need work.
    """
    found = _class_features(token.translate(_CLASS), len(token), bool(len(token) >= 16 and _HEX.match(token)))
    marks = ["q"] if token[:1] in "\"'" else []
    if cues := set(_CUE.findall(lower := token.lower())):
        marks += [f"c{cue}" for cue in cues]
        if cues & _SECRET_CUES:
            gives = _GIVES.search(lower)
            marks.append("names" if not gives else "opens" if len(gives[1]) < 6 else "gives")
    return [*found, *(crc32(m.encode()) % BUCKETS for m in marks)] if marks else list(found)


def labelled(seed: int = 7, rows: int = 400) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: tokens and their labels, made by rule from invented words and data."""
    rng = random.Random(seed)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyzäéñ": "".join(rng.choice(of) for _ in range(n))
    digits = lambda n: letters(n, "0123456789")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mixed = upper + upper.lower() + "0123456789"

    def word() -> str:
        w = letters(rng.choice([rng.randint(1, 14)] * 9 + [rng.randint(15, 26)]))
        w = rng.choice([w] * 8 + [w.capitalize()] * 2 + [w.upper(), w.upper() + "!!", w + "***", w + "$$$", w + "%%%", w + "&&&", "|"])
        return w + rng.choice([""] * 8 + [".", ",", "?", ":"])

    def data(kind: str) -> list[str]:
        if kind == "email":
            return [f"{letters(rng.randint(2, 9), upper.lower())}{rng.choice(['', '.', '_'])}{digits(rng.randint(0, 2))}@{letters(5, upper.lower())}.{rng.choice(['com', 'org', 'example.net'])}"]
        if kind == "ip":
            return [".".join(str(rng.randint(1, 255)) for _ in range(4))]
        if kind == "card":
            return rng.choice([[digits(16)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))]])
        if kind == "phone":
            return rng.choice([["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"+{digits(2)}", digits(3), digits(7)], [f"{digits(3)}-{digits(3)}-{digits(4)}"]])
        token = rng.choice(["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 20, 32, 40, 64]))), letters(rng.randint(20, 40), mixed)])
        if rng.random() < 0.5:  # of letters alone
            token = letters(rng.choice([rng.randint(8, 16), rng.randint(8, 40)]), rng.choice([upper, upper.lower(), upper + upper.lower()]))
        return rng.choice([["AKIA" + letters(16, rng.choice([upper, upper + "234567"]))], [f"{rng.choice(CUES[:5])}={token[: rng.choice([10, 18, 40])]}"], [rng.choice(["token", "Token", "password", "secret"]), "=", f'"{token}"'], [f'api_key="{token}"'], [rng.choice(["secret:", "password:", "token:"]), token], [f"sk-{token}"], [f"ghp_{letters(36, mixed)}"]])

    plain = [["version", "3."], ["Version", "2.0."], ["CC", "BY-NC", "4.0."], ["in", str(rng.randint(1900, 2030))], ["page", digits(2)], ["key", "words"], ["a", "token", "of"], ["the", "secret", "is"], ["password", word(), word()], ["token", word(), word()], ["the", "secret", letters(16)], ["a", "key", letters(18)], ["tokens", "and", letters(14)], ["key", "=", letters(3)], [letters(24)], [letters(20).upper()], [digits(3) + "."], ["5", "=", "2"], ["http://www.example.com/a?b=1"], [f"{digits(2)}.{digits(2)}.20{digits(2)}"], ["x" * 40], ["COVID-19"], ["iPhone"], ["$" + digits(3)], [digits(1) + "," + digits(3)]]

    def cut_run() -> list[tuple[str, str]]:
        """Parts of a long run without white space, as of a link or of data without blanks, with a secret or without."""
        name = lambda: letters(rng.randint(2, 9), upper.lower())
        value = lambda: rng.choice([name(), name(), digits(rng.randint(1, 6)), letters(rng.randint(10, 20), mixed[26:])])
        link = rng.random() < 0.5
        out = ["https:", f"//{name()}.example.com/{name()}/{name()}?"] if link else ['{"']
        tags = ["none"] * len(out)
        secret = rng.choice(["password", "token", "api_key", "secret", "passwd"]) if rng.random() < 0.6 else None
        at, n = rng.randint(0, 3), rng.randint(4, 6)
        for i in range(n):
            key, own = (secret, True) if secret and i == at else (name(), False)
            what = ("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 20, 32, 40, 64]))) if rng.random() < 0.6 else letters(rng.randint(20, 40), mixed)) if own else value()
            out += [f"{key}=", f"{what}&"] if link else [f'{key}":"', what + ('","' if i < n - 1 else '"}')]
            tags += ["none", "secret" if own else "none"]
        return list(zip(out, tags, strict=True))

    table = []
    for _ in range(rows):
        tokens, tags = [], []
        for _ in range(rng.randint(1, 5)):
            for _ in range(rng.randint(0, 6)):
                tokens.append(word())
                tags.append("none")
            if rng.random() < 0.1 and len(tokens) < 12:
                for token, tag in cut_run():
                    tokens.append(token)
                    tags.append(tag)
                break
            kind = rng.choice([*KINDS, "secret", "none", "none", "none"])
            part = rng.choice(plain) if kind == "none" else data(kind)
            if kind != "none" and rng.random() < 0.2:
                part = [*part[:-1], part[-1] + rng.choice(".,")]
            tokens += part
            tags += [kind] * len(part)
        table.append((tokens, tags))
    return table


def train(table: list[tuple[list[str], list[str]]]) -> dict[str, np.ndarray]:
    """Weights of the features of a token and of its two neighbours, and of transitions, by gradient ascent on the likelihood."""
    longest, n = max(len(t) for t, _ in table), len(LABELS)
    known: dict[str, int] = {}
    ids = np.zeros((len(table), longest + 2), int)  # 0: no token
    gold = np.zeros((len(table), longest), int)
    mask = np.zeros((len(table), longest), bool)
    for r, (tokens, tags) in enumerate(table):
        ids[r, 1 : len(tokens) + 1] = [known.setdefault(t, len(known) + 1) for t in tokens]
        gold[r, : len(tags)] = [LABELS.index(t) for t in tags]
        mask[r, : len(tags)] = True
    table_of = np.zeros((len(known) + 1, BUCKETS))
    table_of[0, 0] = 1
    for token, i in known.items():
        table_of[i, features(token)] = 1
    used = np.flatnonzero(table_of.any(axis=0))
    x = table_of[:, used]
    weights = [np.zeros((len(used), n)) for _ in range(3)] + [np.zeros((n, n))]
    means, squares = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    one_hot = np.eye(n)[gold] * mask[:, :, None]
    pairs = mask[:, 1:]
    rows = np.arange(len(table))
    for step in range(1, STEPS + 1):
        scores = [x @ w for w in weights[:3]]
        e = sum(s[ids[:, o : o + longest]] for o, s in enumerate(scores))
        trans = weights[3]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            ways = alpha[:, t - 1, :, None] + trans
            top = ways.max(axis=1)
            alpha[:, t] = np.where(mask[:, t, None], top + np.log(np.exp(ways - top[:, None]).sum(axis=1)) + e[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ways = trans + (beta[:, t + 1] + e[:, t + 1])[:, None, :]
            top = ways.max(axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], top + np.log(np.exp(ways - top[:, :, None]).sum(axis=2)), 0)
        end = alpha[rows, mask.sum(axis=1) - 1]
        norm = end.max(axis=1) + np.log(np.exp(end - end.max(axis=1, keepdims=True)).sum(axis=1))
        marginal = np.exp(alpha + beta - norm[:, None, None]) * mask[:, :, None]
        both = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - norm[:, None, None, None]) * pairs[:, :, None, None]
        grads, rest = [], one_hot - marginal
        for o in range(3):
            by_token = np.zeros((len(x), n))
            np.add.at(by_token, ids[:, o : o + longest].ravel(), rest.reshape(-1, n))
            grads.append(x.T @ by_token)
        grads.append(np.einsum("bti,btj->ij", one_hot[:, :-1] * pairs[:, :, None], one_hot[:, 1:]) - both.sum(axis=(0, 1)))
        for k, g in enumerate(grads):
            g = g / len(table) - DECAY * weights[k]
            means[k] = 0.9 * means[k] + 0.1 * g
            squares[k] = 0.99 * squares[k] + 0.01 * g * g
            weights[k] += RATE * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-8)
    full = np.zeros((3, BUCKETS, n), np.float32)
    full[:, used] = np.stack(weights[:3])
    return {"tokens": full, "transitions": weights[3]}


@cache
def default_model() -> dict[str, np.ndarray]:
    return train(labelled())


class Tagger:
    """Labels the tokens of batches of texts. Scores of a token depend on it alone, so they are kept for frequent tokens."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.kinds: dict[tuple[int, ...], int] = {}
        self.scores = np.zeros((1024, 3, len(LABELS)), np.float32)
        self.scores[0] = self.model["tokens"][:, 0]
        self.size = 1

    def _known(self, tokens: list[str]) -> np.ndarray:
        get = self.at.get
        ids = np.fromiter((get(t, -1) for t in tokens), np.int64, len(tokens))
        for i in np.flatnonzero(ids < 0).tolist():
            if (at := get(tokens[i])) is None:
                kind = tuple(sorted(set(features(tokens[i]))))
                if (at := self.kinds.get(kind)) is None:
                    at = self.kinds[kind] = self.size
                    if self.size == len(self.scores):
                        self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                    self.scores[at] = self.model["tokens"][:, kind].sum(axis=1)
                    self.size += 1
                self.at[tokens[i]] = at
            ids[i] = at
        return ids

    def tag(self, texts: list[list[str]]) -> np.ndarray:
        """A label index for each token of all texts, one after another."""
        if len(self.at) > KNOWN_TOKENS:
            self._reset()
        lengths = np.array([len(t) for t in texts], np.int64)
        ids = self._known([t for tokens in texts for t in tokens])
        if not len(ids):
            return ids
        ends = np.cumsum(lengths[lengths > 0])
        before, after = np.roll(ids, 1), np.roll(ids, -1)
        before[np.concatenate([[0], ends[:-1]])] = 0
        after[ends - 1] = 0
        return viterbi.decode(self.scores[before, 0] + self.scores[ids, 1] + self.scores[after, 2], lengths, self.model["transitions"])


def _fits(body: str, kind: int) -> bool:
    """Whether what the model takes for data of a kind passes that kind's check by itself; a secret is the model's own to tell, if it isn't mere marks."""
    digits = sum(c.isdigit() for c in body)
    if kind == 3:
        return 7 <= digits <= 15 and digits >= 0.6 * sum(c.isalnum() for c in body)
    if kind == 4:
        return sum(c.isalnum() for c in body) >= 8
    return (0, len(body), kind) in base_spans(body)


def added_spans(text: str, labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The model's spans that touch no base span and pass their kind's check: runs of tokens of one label, or else each token.

    So a card right after a phone is found, though the patterns take both for one number and drop it, while nothing that
    fails a check by itself comes back. Outer punctuation goes.
    """
    runs: list[tuple[int, list[tuple[int, int]]]] = []
    for (a, b), label in zip(token_spans(text), labels, strict=True):
        kind = int(label) - 1
        if kind >= 0:
            if runs and runs[-1][0] == kind and text[runs[-1][1][-1][1] : a] in (" ", ""):
                runs[-1][1].append((a, b))
            else:
                runs.append((kind, [(a, b)]))
    out = []
    for kind, places in runs:
        whole = (places[0][0], places[-1][1])
        for options in ([whole], places):
            found = []
            for a, b in options:
                body = text[a:b].rstrip(".,;:!?&|<>{}" + ("\"'" if text[a] not in "\"'" and "=" not in text[a:b] else ""))
                if _fits(body, kind) and not any(a < y and x < a + len(body) for x, y, _ in base):
                    found.append((a, a + len(body), kind))
            if found:
                out += found
                break
    return out


def finder(model: dict[str, np.ndarray]):
    """A function from UTF-8 texts to their base spans and all spans."""
    tagger = Tagger(model)

    def find(texts: list[bytes]) -> list[tuple[str, list, list]]:
        words = [t.decode("utf-8", "replace") for t in texts]
        tokens = [tokens_of(t) for t in words]
        labels = tagger.tag(tokens)
        hits = labels > 0
        out, at = [], 0
        for text, own in zip(words, tokens, strict=True):
            base = base_spans(text)
            spans = base
            if hits[at : at + len(own)].any():
                spans = sorted(base + added_spans(text, labels[at : at + len(own)], base), key=lambda s: (s[0], s[2]))
            out.append((text, base, spans))
            at += len(own)
        return out

    return find


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span's kind in its place; of overlapping spans the first gives the kind."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, table: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_secret, n_spans) for every row of `docs` (doc_id, text).

    The first four counts and base_sha256 are of the patterns' spans; `spans` and `n_spans` have the model's, too: n_added
    of them, n_secret of which are secrets. Offsets are code points, ends exclusive. Null and empty texts have none; a text
    of any length is read whole; rows are read each by itself, so repeated rows have equal results. Spans that start
    together are in the order of KINDS. Other columns are not read, whatever their names; an empty table gives no rows.
    `table` (labelled() by default) trains the model on the driver; it has a few hundred short rows, whatever the corpus.
    """
    model, made = default_model() if table is None else train(table), []

    def each(texts: list[bytes]) -> dict[str, list]:
        if not made:
            made.append(finder(model))
        found = made[0](texts)
        out = {f"n_{k}": [sum(s[2] == i for s in base) for _, base, _ in found] for i, k in enumerate(KINDS[:4])}
        out["base_sha256"] = [hashlib.sha256(written(base).encode()).hexdigest() for _, base, _ in found]
        out["spans"] = [written(spans) for _, _, spans in found]
        out["n_added"] = [len(spans) - len(base) for _, base, spans in found]
        out["n_secret"] = [sum(s[2] == KINDS.index("secret") for s in spans) for _, _, spans in found]
        out["n_spans"] = [len(spans) for _, _, spans in found]
        return out

    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, n_spans long"
    return map_texts(docs, each, schema)


def redact_pii(docs: DataFrame) -> DataFrame:
    """`docs` with each span of personal data replaced by its kind, and n_chars brought up to date where it is there.

    A map over rows: no shuffle, and no row goes. A null text stays null and an empty one empty; repeated rows are changed
    alike; of overlapping spans the first gives the kind. All other columns pass through as they are, whatever their names.
    An empty table gives an empty table.
    """
    model, made, redacted = default_model(), [], free_name(docs, "_redacted")

    def each(texts: list[bytes]) -> dict[str, list]:
        if not made:
            made.append(finder(model))
        return {redacted: [redact(text, spans) if spans else None for text, _, spans in made[0](texts)]}

    out = map_texts(docs, each, f"{redacted} string", tuple(docs.columns))
    out = out.withColumn("text", F.coalesce(redacted, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(redacted).isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)

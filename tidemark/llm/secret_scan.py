"""Secret scans: fixed patterns, and a linear-chain conditional random field over all tokens of a text.

Tokens are runs of letters and digits and single other characters; separators only part them. Every token of a text is
tagged secret begin, inside or outside, by Viterbi over the whole text. Features: the token's shape, length, spread of
characters, vowels and changes of class, its neighbours, the shape of the run without separators that holds it, the two
words before and the word after that run, and of the file how many long runs of key characters it has. Steps between
tokens have weights of their own where a separator stands between them.

Features depend on one run and its place only, so a run's scores are computed once and kept in a bounded table.
A token that scores so far above secret for outside that no choice of its neighbours could outweigh it is outside in the
best path; that leaves short gaps, in which Viterbi runs: the result is that of Viterbi over the whole text.

The field is trained here on a bounded sample of the corpus: passages of at most `PASSAGE` characters, `SAMPLE` of least
hash of each of three kinds: around a pattern's match, around a digit, anywhere. The matched values are secrets. Their key
words are hidden in half of them. In two thirds of the other passages made-up text is planted: secrets of 8 to 40
characters that no pattern need match (with and without a key word before them) or harmless runs (addresses, dates,
numbers, names of files). Training runs on the driver, by batches, in a fixed order.

Spans: the patterns' matches (`assign`, `access`, `hex`, each leftmost and non-overlapping) and the field's
(`field`), where no pattern's match covers it; `n_tagged` counts the field's spans, covered ones too. Offsets are code
points, end exclusive. Null texts are empty. Repeated rows get equal results. Columns named `spans` or `n_tagged` are replaced, other extra
columns kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, materialise, worker_state

KINDS = ("assign", "access", "hex", "field")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CHUNK = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}"
TOKEN = r"[^\W_]+|[^\w\s]|_"
#: Passages of each kind, and characters on each side of a passage's middle.
SAMPLE = 1500
PASSAGE = 240
#: Lessons made of each passage.
LESSONS = 2
EPOCHS = 8
BATCH = 64
#: Most words that features name, and how often a passage word must come to be one.
WORDS, WORD_SEEN = 3000, 5
#: Hashed features; the weights are (WIDTH + 1) x 3 (the last row stays zero) and 2 x 3 x 3 numbers.
WIDTH = 1 << 17
OUT, BEGIN, INSIDE = 0, 1, 2
#: Runs, their tokens and characters whose scores a worker keeps.
TABLE_RUNS, TABLE_TOKENS, TABLE_CHARS = 600_000, 1_000_000, 20_000_000
BLOCK = 50_000


def patterns() -> dict:
    return {"assign": re.compile(ASSIGN, re.I | re.A), "access": re.compile(ACCESS), "hex": re.compile(HEX), "chunk": re.compile(CHUNK), "token": re.compile(TOKEN), "run": re.compile(r"\S+"), "digit": re.compile(r"[0-9]"), "plain": re.compile(r"([^\w\s]*)([^\W\d_]+)([^\w\s]*)"), "letter": re.compile(r"[^\W\d_]")}


def base_spans(text: str, rx: dict, chunks: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The patterns' matches by start, then kind. access and hex matches of this length lie in one chunk each."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", *m.span()) for m in rx["assign"].finditer(text) if len(m[2]) >= 12]
    for a, b in chunks:
        found += [("access", *m.span()) for m in rx["access"].finditer(text, a, b) if len(m[0]) >= 18]
        found += [("hex", *m.span()) for m in rx["hex"].finditer(text, a, b) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def chunks_of(text: str, rx: dict) -> list[tuple[int, int]]:
    return [m.span() for m in rx["chunk"].finditer(text)]


# ---------------------------------------------------------------- features
VOWELS = str.maketrans("", "", "aeiouyAEIOUY")
NINES = str.maketrans("0123456789", "9" * 10)


def classes(s: str) -> str:
    """The class of each character: d, u, l, x (other letters and digits) or the character itself."""
    return "".join("d" if "0" <= c <= "9" else "u" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "x" if c.isalnum() else c for c in s)


LONG = [n if n < 4 else 4 + int(2 * math.log2(n / 4)) for n in range(65)]


def long(n: int) -> int:
    """The class of a length."""
    return LONG[n] if n < 64 else LONG[64]


def shape(s: str) -> str:
    kinds = classes(s) if s.isascii() else "x"
    return f"{''.join(k for k in 'dulx' if k in kinds) or s[:1]}{long(len(s))}"


def spread(s: str) -> int:
    """Bits of entropy per character, in fourths."""
    n = len(s)
    return round(-4 * sum(k / n * math.log2(k / n) for k in map(s.count, set(s))))


def switches(s: str) -> int:
    """Changes of class between neighbours, but for a capital before small letters."""
    kinds = classes(s)
    return min(9, sum(a != b and (a, b) != ("u", "l") for a, b in zip(kinds, kinds[1:])))


def numbered(names: list[str]) -> list[int]:
    return [xxhash.xxh32_intdigest(x) % WIDTH for x in names]


def vowels(word: str) -> int:
    return 5 * (len(word) - len(word.translate(VOWELS))) // len(word)


def base16(word: str) -> bool:
    return not word.strip("0123456789abcdefABCDEF")


def plain(run: str, rx: dict) -> tuple[str, str, str] | None:
    """Marks, one word in one case (or with a capital), marks."""
    if run.isalpha():
        parts = "", run, ""
    elif m := rx["plain"].fullmatch(run):
        parts = m.groups()
    else:
        return None
    word = parts[1]
    low = word.lower()
    return parts if word == low or word[1:] == low[1:] or word == word.upper() else None


def key_of(run: str, rx: dict, known: frozenset[str]) -> str | tuple:
    """Runs of one key have the same features: words not among the known ones count by form, digits all alike."""
    if parts := plain(run, rx):
        lead, word, trail = parts
        low = word.lower()
        if low in known:
            return run
        part = word if len(word) <= 200 else word[:200]
        return lead, trail, 0 if word == low else 1 if word[1:] == low[1:] else 2, word.isascii(), long(len(word)), vowels(part), base16(part)
    return run if rx["letter"].search(run) else run.translate(NINES)


def run_features(run: str, rx: dict, known: frozenset[str]) -> tuple[list[tuple[int, int]], list[list[int]], list[list[int]]]:
    """Of a run without separators: its tokens' places and features, and the features that it gives to the tokens of
    the next run, of the one after that, and of the run before."""
    name = lambda w: w.lower() if w.lower() in known else "?"
    places = [m.span() for m in rx["token"].finditer(run)]
    words = [run[a:b] for a, b in places]
    head = run[:400]  # shapes of a very long run are those of its beginning
    core = re.sub(r"^[^\w]+|[^\w]+$", "", head)
    marks = "".join(sorted({w for w in words[:60] if not w.isalnum()}))[:4]
    whole = [f"run {shape(core)}", f"run tokens {min(len(words), 6)}", f"run marks {marks}"]
    simple = plain(run, rx) is not None or not rx["letter"].search(run)
    whole += ["run simple"] if simple else [f"run spread {spread(core) if core else ''} {long(len(core))}", f"run switches {switches(core)}"]
    own = []
    for i, w in enumerate(words):
        before, after = words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""
        x = ["bias", f"shape {shape(w)}", f"previous {shape(before) if before else ''}", f"next {shape(after) if after else ''}", f"place {min(i, 3)} {i + 1 == len(words)}"]
        if w.isalnum():
            part = w[:200]
            if not simple:
                x += [f"spread {spread(part)} {long(len(w))}", f"switches {switches(part)} {long(len(w))}"]
            x += [f"vowels {vowels(part)} {long(len(w))} {part.isalpha()}", f"hex {base16(part)} {part.isdigit()}"]
            back = next((v for v in reversed(words[max(0, i - 3) : i]) if v.isalnum()), "")
            x += [f"key {name(back)}", f"word {name(w)}"]
        own.append(numbered(x + whole))
    last = name(next((v for v in reversed(words[-4:]) if v.isalnum()), ""))
    end = run[-1] if not run[-1].isalnum() else ""
    given = [numbered([f"1 before {last}", f"1 ends {end}", f"1 shape {shape(core)}"]), numbered([f"2 before {last}", f"2 ends {end}"]), numbered([f"1 after {shape(words[0]) if words else ''}"])]
    return places, own, given


EDGE = numbered(["1 before edge"]), numbered(["2 before edge"]), numbered(["1 after edge"])


def file_features(n_chunks: int) -> list[int]:
    return numbered([f"file {min(n_chunks, 8)}"])


def sequence(text: str, n_chunks: int, rx: dict, known: frozenset[str], kept: dict | None = None) -> tuple[list[tuple[int, int]], list[list[int]], list[int]]:
    """Of a short text: its tokens' places and features, and whether a separator stands before them (1) or not (0)."""
    kept = {} if kept is None else kept  # by run
    runs = []
    for m in rx["run"].finditer(text):
        if m[0] not in kept:
            kept[m[0]] = run_features(m[0], rx, known)
        runs.append((m.start(), *kept[m[0]]))
    places, features, apart = [], [], []
    for k, (at, own, rows, _) in enumerate(runs):
        around = (runs[k - 1][3][0] if k else EDGE[0]) + (runs[k - 2][3][1] if k > 1 else EDGE[1]) + (runs[k + 1][3][2] if k + 1 < len(runs) else EDGE[2]) + file_features(n_chunks)
        places += [(at + a, at + b) for a, b in own]
        features += [row + around for row in rows]
        apart += [int(i == 0) for i in range(len(own))]
    return places, features, apart


# ---------------------------------------------------------------- the field
#: Inside never follows outside, nor opens a text.
FORBIDDEN = np.array([[0.0, 0.0, -1e4], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
OPENING = np.array([0.0, 0.0, -1e4])


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def expectations(scores: np.ndarray, apart: np.ndarray, n: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of chains (scores: chain x token x tag; n: their lengths): each token's tag probabilities, the expected
    steps by kind, and the logarithm of the normaliser."""
    size, length, _ = scores.shape
    move = (step + FORBIDDEN)[apart]
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0] + OPENING
    for i in range(1, length):
        forward[:, i] = scores[:, i] + log_sum(forward[:, i - 1, :, None] + move[:, i], 1)
    for i in range(length - 2, -1, -1):
        backward[:, i] = np.where((i < n - 1)[:, None], log_sum(move[:, i + 1] + (scores[:, i + 1] + backward[:, i + 1])[:, None, :], 2), 0.0)
    z = log_sum(forward[np.arange(size), n - 1], 1)
    on = np.arange(length) < n[:, None]
    p = np.where(on[:, :, None], np.exp(np.minimum(forward + backward - z[:, None, None], 0.0)), 0.0)
    pairs = np.exp(np.minimum(forward[:, :-1, :, None] + move[:, 1:] + (scores + backward)[:, 1:, None, :] - z[:, None, None, None], 0.0)) * on[:, 1:, None, None]
    kinds = np.stack([(pairs * (apart[:, 1:] == k)[:, :, None, None]).sum(axis=(0, 1)) for k in (0, 1)])
    return p, kinds, z


def padded(batch: list[tuple[list, list, list]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (filled up with WIDTH), tags, kinds of step, lengths."""
    n = np.array([len(tags) for _, tags, _ in batch])
    most = max(len(f) for features, _, _ in batch for f in features)
    features = np.full((len(batch), n.max(), most), WIDTH, np.int64)
    tags, apart = np.zeros((len(batch), n.max()), np.int64), np.zeros((len(batch), n.max()), np.int64)
    for k, (rows, own, parts) in enumerate(batch):
        for i, row in enumerate(rows):
            features[k, i, : len(row)] = row
        tags[k, : n[k]], apart[k, : n[k]] = own, parts
    return features, tags, apart, n


def gradient(batch: list[tuple[list, list, list]], emit: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the batch's tags and its gradient by emit and step. A chain: features, tags, kinds of step."""
    features, tags, apart, n = padded(batch)
    scores = emit[features].sum(axis=2)
    p, kinds, z = expectations(scores, apart, n, step)
    on = np.arange(tags.shape[1]) < n[:, None]
    seen = (np.eye(3)[tags] * on[:, :, None])
    by_tag = seen - p
    at = features.reshape(-1)
    emit_by = np.stack([np.bincount(at, np.repeat(by_tag[:, :, k].reshape(-1), features.shape[2]), WIDTH + 1) for k in range(3)], axis=1)
    emit_by[WIDTH] = 0
    steps = np.zeros((2, 3, 3))
    inner = on[:, 1:]
    np.add.at(steps, (apart[:, 1:][inner], tags[:, :-1][inner], tags[:, 1:][inner]), 1)
    likely = (scores * seen).sum() + (steps * step).sum() - z.sum()
    return float(likely), emit_by, steps - kinds


def fit(chains: list[tuple[list, list, list]], epochs: int = EPOCHS, rate: float = 0.25, decay: float = 2e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights (emit, step), by adaptive steps on the log-likelihood of batches of chains of like lengths."""
    emit, step = np.zeros((WIDTH + 1, 3)), np.zeros((2, 3, 3))
    emit_sq, step_sq = np.full_like(emit, 1e-2), np.full_like(step, 1.0)
    by_length = sorted(range(len(chains)), key=lambda k: len(chains[k][1]))
    batches = [[chains[k] for k in by_length[i : i + BATCH]] for i in range(0, len(chains), BATCH)]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for b in order.permutation(len(batches)):
            _, emit_by, step_by = gradient(batches[b], emit, step)
            emit_by, step_by = emit_by / len(batches[b]), step_by / len(batches[b])
            emit_sq += emit_by**2
            step_sq += step_by**2
            emit += rate * emit_by / np.sqrt(emit_sq) - decay * emit * (emit_by != 0)
            step += rate * step_by / np.sqrt(step_sq)
    return emit, step


def viterbi(scores: np.ndarray, apart: np.ndarray, step: np.ndarray, before: int | None = None, after: int | None = None) -> list[int]:
    """The best tags; before and after: the tag that stands before the first token, and (tag, kind of step) after the last."""
    move = (step + FORBIDDEN).tolist()
    e, best, back = scores.tolist(), None, []
    for i, own in enumerate(e):
        if best is None:
            start = OPENING.tolist() if before is None else move[int(apart[0])][before]
            best = [own[t] + start[t] for t in range(3)]
            continue
        m = move[int(apart[i])]
        now, came = [], []
        for t in range(3):
            a, b, c = best[0] + m[0][t], best[1] + m[1][t], best[2] + m[2][t]
            k = 0 if a >= b and a >= c else 1 if b >= c else 2
            now.append((a, b, c)[k] + own[t])
            came.append(k)
        best = now
        back.append(came)
    if after is not None:
        best = [best[t] + move[after][t][OUT] for t in range(3)]
    tags = [max(range(3), key=lambda t: best[t])]
    for came in reversed(back):
        tags.append(came[tags[-1]])
    return tags[::-1]


def sure(scores: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Tokens that are outside in the best path.

    Take a path with a secret token and make it outside; if the next token was inside, make that one a begin. The steps to the
    token, from it and, if the next tag changes too, from the next one, lose no more than the greatest differences of their
    weights, and the next token its difference of scores. What gains more than that cannot be secret in the best path.
    """
    gain = scores[:, OUT] - scores[:, 1:].max(axis=1)
    to = max(0.0, (step[:, :, BEGIN] - step[:, :, OUT]).max(), (step[:, 1:, INSIDE] - step[:, 1:, OUT]).max())
    on = max(0.0, (step[:, 1:, :INSIDE] - step[:, :1, :INSIDE]).max())
    turned = (step[:, 1:, INSIDE] - step[:, :1, BEGIN]).max() + max(0.0, (step[:, INSIDE] - step[:, BEGIN]).max())
    least = np.full(len(scores), to + on)
    least[:-1] = np.maximum(least[:-1], to + turned + scores[1:, INSIDE] - scores[1:, BEGIN])
    return gain > least + 1e-6


def decode(scores: np.ndarray, apart: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best tags of a whole text: Viterbi in the gaps between sure tokens."""
    tags = np.zeros(len(scores), np.int8)
    edge = np.diff(np.concatenate([[1], sure(scores, step).astype(np.int8), [1]]))
    for a, b in zip(np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist()):
        tags[a:b] = viterbi(scores[a:b], apart[a:b], step, None if a == 0 else OUT, None if b == len(scores) else int(apart[b]))
    return tags


class Runs(dict):
    """Numbers of runs, and by number their tokens' scores and what they give to the runs around them. Runs of one key
    share a number."""

    def __init__(self, emit: np.ndarray, known: frozenset[str], rx: dict):
        super().__init__()
        self.emit, self.known, self.rx = emit, known, rx
        self.edge = np.stack([emit[x].sum(axis=0) for x in EDGE])
        self.reset()

    def trim(self) -> None:
        """Forgets all runs, or also what is kept by key, where a bound is passed."""
        if len(self) > TABLE_RUNS or self.n_chars > TABLE_CHARS:
            self.clear()
            self.n_chars = 0
        if self.n_tokens > TABLE_TOKENS or self.key_chars > TABLE_CHARS:
            self.reset()

    def reset(self) -> None:
        self.clear()
        self.by_key: dict[str | tuple, int] = {}
        self.n_tokens = self.n_chars = self.key_chars = 0
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.given, self.scores = np.zeros((1024, 3, 3)), np.zeros((4096, 3))

    def __missing__(self, run: str) -> int:
        self.n_chars += len(run)
        key = key_of(run, self.rx, self.known)
        if (k := self.by_key.get(key)) is not None:
            self[run] = k
            return k
        places, own, given = run_features(run, self.rx, self.known)
        k, n = len(self.by_key), len(places)
        if k >= len(self.first):
            self.first, self.count, self.given = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.given))
        while self.n_tokens + n > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.first[k], self.count[k] = self.n_tokens, n
        for i, x in enumerate(own):
            self.scores[self.n_tokens + i] = self.emit[x].sum(axis=0)
        self.given[k] = [self.emit[x].sum(axis=0) for x in given]
        self.n_tokens += n
        self.key_chars += len(run)
        self.by_key[key] = self[run] = k
        return k

    def text_scores(self, text: str, n_chunks: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and kinds of step of all tokens of the text, by parts of BLOCK runs."""
        runs, scores, apart = text.split(), [np.zeros((0, 3), np.float32)], [np.zeros(0, np.int8)]
        of_file = self.emit[file_features(n_chunks)].sum(axis=0)
        last = np.stack([self.edge, self.edge])  # what the two runs before give
        for i in range(0, len(runs), BLOCK):
            self.trim()
            part = runs[i : i + BLOCK + 1]  # one more, for what it gives back
            k = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            m = min(BLOCK, len(part))
            given = np.concatenate([last, self.given[k], self.edge[None]])
            around = given[1 : m + 1, 0] + given[:m, 1] + given[3 : m + 3, 2] + of_file
            last = given[m : m + 2]
            n = self.count[k[:m]]
            start = np.cumsum(n) - n
            at = np.repeat(self.first[k[:m]] - start, n) + np.arange(n.sum())
            scores.append((self.scores[at] + np.repeat(around, n, axis=0)).astype(np.float32))
            parted = np.zeros(int(n.sum()), np.int8)
            parted[start[n > 0]] = 1
            apart.append(parted)
        return np.concatenate(scores), np.concatenate(apart)


def tagged(text: str, n_chunks: int, runs: Runs, step: np.ndarray) -> list[tuple[int, int]]:
    """Places of the field's secrets in the text."""
    scores, apart = runs.text_scores(text, n_chunks)
    tags = decode(scores, apart, step)
    if not tags.any():
        return []
    wanted, out = set(np.flatnonzero(tags).tolist()), []
    for i, m in enumerate(runs.rx["token"].finditer(text)):
        if i in wanted:
            if tags[i] == BEGIN:
                out.append(m.span())
            else:
                out[-1] = (out[-1][0], m.end())
    return out


# ---------------------------------------------------------------- training
#: Words that announce a secret, and how.
KEYS = ("password", "passwd", "pwd", "pw", "pass", "passphrase", "secret", "token", "api key", "apikey", "api_key", "key", "auth", "credential", "credentials", "access key", "private key", "login", "bearer", "client_secret", "signing key", "license key")
FORMS = ("{k}: {s}", "{k}={s}", '{k} = "{s}"', "{k} {s}", "{k} is {s}", "{k} {w}: {s}", "'{k}': '{s}'", "{k}:{s}", "{k} -> {s}", "--{k} {s}", "{k} {s} {w}")
BARE = ("{s}", "{s}", '"{s}"', "({s})", "{w}={s}", "{w}: {s}")


def made_up_secret(rng: random.Random, words: list[str]) -> tuple[str, bool]:
    """A secret of 8 to 40 characters, and whether it shows without a key word."""
    n, letters = rng.randint(8, 40), string.ascii_letters + string.digits
    some = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    kind = rng.randrange(10)
    if kind == 0:
        s = some(letters, n)
    elif kind == 9:
        s = some(string.ascii_lowercase + string.digits, n - 1) + some(string.digits, 1)
    elif kind == 1:
        s = some(letters + "+/", n - 2) + rng.choice(("", "=", "=="))
    elif kind == 2:
        s = some(letters + "!@#$%^&*-_.?~", n - 3) + rng.choice("!@#$%^&*?") + some(string.digits, 1) + some(string.ascii_letters, 1)
    elif kind == 3:
        s = some(rng.choice(("0123456789abcdef", "0123456789ABCDEF")), n)
    elif kind == 4:
        s = some(string.ascii_letters, n)
    elif kind == 5:
        s = (rng.choice(words).capitalize() + some(string.digits, rng.randint(2, 4)) + rng.choice(("", "!", "#", "$", "?"))).rjust(8, rng.choice("xQ7_"))
    elif kind == 6:
        s = "-".join(some(string.ascii_uppercase + string.digits, rng.randint(4, 6)) for _ in range(rng.randint(2, 5)))
    elif kind == 7:
        s = some(string.ascii_lowercase, rng.randint(2, 5)) + rng.choice("_-") + some(letters, max(8, n - 6))
    else:
        s = "".join(rng.choice(words).lower() for _ in range(rng.randint(2, 4))).ljust(12, "e")
    s = s[:40]
    return s, any(c.isdigit() for c in s) and any(c.isalpha() for c in s) or kind == 4 and len(s) > 11


def made_up_harmless(rng: random.Random, words: list[str]) -> str:
    w = lambda: rng.choice(words).lower()
    d = lambda k: "".join(rng.choices(string.digits, k=k))
    made = (
        lambda: f"{w()}.{w()}@{w()}.{rng.choice(('org', 'com', 'net', 'de'))}", lambda: f"{w()}{d(2)}@{w()}{d(1)}.example.com", lambda: f"https://www.{w()}.{w()}.org/{w()}/{d(4)}?page={d(1)}&ref={w()}", lambda: f"http://{w()}.com/{w()}-{w()}-{d(3)}.html",
        lambda: f"20{d(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}T12:{rng.randint(10, 59)}:00Z", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{d(2)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}-beta{d(1)}", lambda: f"/usr/local/{w()}/{w()}{d(1)}.{d(2)}/{w()}",
        lambda: f"({d(3)}) 555-{d(4)}", lambda: f"+1{d(10)}", lambda: f"+{d(2)} {d(3)} {d(7)}", lambda: f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}", lambda: f"ISBN 978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
        lambda: f"{w()}{w().capitalize()}{w().capitalize()}()", lambda: f"{w()}_{w()}_{d(2)}.txt", lambda: f"#{d(5)}", lambda: f"{d(2)},{d(3)},{d(3)}.{d(2)}", lambda: f"{w().upper()}-{d(2)}", lambda: f"{w()}-{w()}-{w()}", lambda: f"{w()}{rng.choice(('***', '###', '%%%', '&&&', '$$$'))}",
        lambda: f"the {rng.choice(KEYS)} {w()} {w()}", lambda: f"{rng.choice(KEYS)}: {w()}, {w()}", lambda: f"{w().capitalize()}s{w()}{w()}", lambda: f"{d(3)}-{d(2)}-{d(4)}",
    )
    return rng.choice(made)()


def values_of(text: str, rx: dict) -> list[tuple[int, int, tuple[int, int] | None]]:
    """Places of the patterns' secret values, and of their key words."""
    out = [(*m.span(2), m.span(1)) for m in rx["assign"].finditer(text) if len(m[2]) >= 12]
    for _, a, b in base_spans(text, rx, chunks_of(text, rx)):
        if not any(a < q and p < b for p, q, _ in out):
            out.append((a, b, None))
    return sorted(out)


def lesson(passage: str, n_chunks: int, seed: int, rx: dict, known: frozenset[str], kept: dict | None = None) -> tuple[list, list, list]:
    """A chain to learn from: features, tags, kinds of step."""
    rng, found = random.Random(seed), values_of(passage, rx)
    words = [w for w in re.findall(r"[^\W\d_]+", passage) if 2 < len(w) < 13] or ["some", "other", "words"]
    places = [(a, b) for a, b, _ in found]
    what = rng.randrange(3)
    if found and rng.random() < 0.5:  # other words in place of the key words
        for k in reversed(range(len(found))):
            if found[k][2]:
                (a, b), new = found[k][2], rng.choice((rng.choice(words), rng.choice(words), rng.choice(KEYS)))
                passage = passage[:a] + new + passage[b:]
                places = [(p + len(new) - b + a, q + len(new) - b + a) if p >= b else (p, q) for p, q in places]
    elif not found and what:
        at = rng.choice([m.end() for m in re.finditer(r"\s", passage)] or [0])
        if what == 1:
            s, shows = made_up_secret(rng, words)
            form = rng.choice(BARE) if shows and rng.random() < 0.4 else rng.choice(FORMS if shows else FORMS[:3] + FORMS[6:8])
            key = rng.choice(KEYS)
            key = rng.choice((key, key.capitalize(), key.upper()))
            extra = form.replace("{k}", key).replace("{w}", rng.choice(words))
            places = [(at + extra.index("{s}"), at + extra.index("{s}") + len(s))]
            extra = extra.replace("{s}", s)
        else:
            extra = made_up_harmless(rng, words)
        passage, n_chunks = passage[:at] + extra + " " + passage[at:], n_chunks + sum(b - a >= 16 for a, b in places)
    spots, features, apart = sequence(passage, n_chunks, rx, known, kept)
    tags = []
    for a, b in spots:
        own = next((p for p, q in places if a < q and b > p), None)
        before = spots[len(tags) - 1] if tags else None
        tags.append(OUT if own is None else INSIDE if before and tags[-1] != OUT and before[1] > own else BEGIN)
    return features, tags, apart


def passages(df: DataFrame, text: str, n: int) -> list[tuple[str, int, str, int]]:
    """At most n passages of each kind: kind, hash, passage, number of long runs in the text that it is from."""

    def around(x: str, a: int, b: int) -> str | None:
        """The runs that lie in reach of [a, b), whole; nothing if the ones in the middle are very long."""
        while a and b - a < 2 * PASSAGE and not x[a - 1].isspace():
            a -= 1
        while b < len(x) and b - a < 2 * PASSAGE and not x[b].isspace():
            b += 1
        lo, hi = max(0, a - PASSAGE), min(len(x), b + PASSAGE)
        while lo and not x[lo - 1].isspace() and lo < a:
            lo += 1
        while hi < len(x) and not x[hi].isspace() and hi > b:
            hi -= 1
        whole = (not lo or x[lo - 1].isspace()) and (hi == len(x) or x[hi].isspace())
        return x[lo:hi] if whole and hi > lo and hi - lo <= 4 * PASSAGE else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rx, names = patterns(), ("match", "digit", "any")
        kept, limit = {k: {} for k in names}, dict.fromkeys(names, 1 << 63)
        for batch in batches:
            for x in batch.column(0):
                x = x.as_py() or ""
                h = xxhash.xxh64_intdigest(x) >> 1
                if not x or h >= max(limit.values()):
                    continue
                every = chunks_of(x, rx)
                at, spans = h % len(x), base_spans(x, rx, every)
                digit = rx["digit"].search(x, at) or rx["digit"].search(x)
                for kind, spot in (("match", spans[h % len(spans)][1:] if spans else None), ("digit", digit.span() if digit else None), ("any", (at, at))):
                    if spot is None or h >= limit[kind] or (passage := around(x, *spot)) is None:
                        continue
                    kept[kind][h] = (passage, len(every))
                    if len(kept[kind]) > n + 200:
                        kept[kind] = dict(sorted(kept[kind].items())[:n])
                        limit[kind] = max(kept[kind])
        rows = [(k, h, *r) for k, own in kept.items() for h, r in sorted(own.items())[:n]]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["kind", "h", "passage", "n_chunks"])

    found = materialise(df.select(text).mapInArrow(run, "kind string, h long, passage string, n_chunks long"), "passages")
    return [tuple(r) for k in ("match", "digit", "any") for r in found.where(F.col("kind") == k).dropDuplicates(["h"]).orderBy("h").limit(n).collect()]


def vocabulary(texts: list[str]) -> frozenset[str]:
    """The words that features name: those of KEYS, and the most frequent ones of the passages."""
    seen = Counter(w.lower() for x in texts for w in re.findall(r"[^\W\d_]+", x) if len(w) < 13)
    often = sorted((-n, w) for w, n in seen.items() if n >= WORD_SEEN)[:WORDS]
    return frozenset(w for _, w in often) | frozenset(w for k in KEYS for w in re.split("[ _]", k))


def learn(found: list[tuple[str, int, str, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Weights of tokens' features and of steps, and the known words, from passages."""
    rx, known = patterns(), vocabulary([p for _, _, p, _ in found])
    kept: dict = {}  # of the passages' runs: bounded as they are
    chains = [lesson(p, n_chunks, LESSONS * h + k, rx, known, kept) for _, h, p, n_chunks in found for k in range(LESSONS)]
    return *fit([c for c in chains if c[1]], epochs), sorted(known)


def train(df: DataFrame, text: str = "text", n: int = SAMPLE, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    return learn(passages(df, text, n), epochs)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(df: DataFrame, field: tuple[np.ndarray, np.ndarray, list[str]], text: str = "text") -> DataFrame:
    """df with spans (kind, start, end), by start, then kind, and n_tagged."""
    sent = df.sparkSession.sparkContext.broadcast((field[0].astype(np.float32), *field[1:]))  # arrays and words only: workers need no class to read them
    name = uuid.uuid4().hex
    rest = [c for c in df.columns if c not in ("spans", "n_tagged")]
    at = rest.index(text)
    schema = T.StructType([*df.select(*rest).schema, T.StructField("spans", SPANS), T.StructField("n_tagged", T.LongType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rx = patterns()
        emit, step, known = sent.value
        state = worker_state()  # a worker keeps its table over all tasks of this field
        if state.get("field") != name:
            state["field"], state["runs"] = name, Runs(emit, frozenset(known), rx)
        runs = state["runs"]
        for batch in batches:
            found, n_tagged = [], []
            for x in batch.column(at):
                x = x.as_py() or ""
                every = chunks_of(x, rx)
                spans, own = base_spans(x, rx, every), tagged(x, len(every), runs, step)
                more = [("field", a, b) for a, b in own if not any(p <= a and b <= q for _, p, q in spans)]
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in (sorted(spans + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else spans)])
                n_tagged.append(len(own))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind), pa.array(n_tagged, pa.int64())], names=[*rest, "spans", "n_tagged"])

    return df.select(*rest).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] != "field")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_tagged")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(find_secrets(docs, train(docs)))


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLE_SQL: dict[str, str] = {}

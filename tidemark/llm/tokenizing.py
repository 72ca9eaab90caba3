"""Exact byte-level BPE of whole texts through a table of pre-tokens.

Byte-level BPE merges inside a pre-token only, so a text's ids are the ids of its pre-tokens in order. The table
keeps what each pre-token gives: first those vocabulary strings that were proved, before any document is read, to
encode alone as one token; then, as they turn up, the pre-tokens that had to be merged. Its size is bounded; what is
beyond the bound is merged again, never dropped.

A text goes to the library as a whole if it holds a special token's string or a character that this Python's
Unicode tables do not know (its class may differ between libraries).

Where ids are wanted, not counts, `Encoder` runs the same split and the same merges in one pass of another library over
ranks taken from the same file; it makes sure first that the file's merges are in the order of their ids.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from .common import worker_state

#: The split that byte-level BPE vocabularies of this family use before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens kept by one worker.
TABLE_LIMIT = 400_000


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_tokenizer(path: str | None = None) -> str:
    """The tokenizer file's text, to be sent with the tasks: executors need no such file."""
    with open(path or default_tokenizer_path(), encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or not pre.get("use_regex", True):
        raise ValueError("the pre-token table holds for byte-level BPE without normalizer and prefix space only")
    return text


def prove_single_tokens(spec: str) -> dict[str, int]:
    """Vocabulary strings that are one pre-token and that the library encodes alone as exactly their own id."""
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    added = {x["id"] for x in json.loads(spec)["added_tokens"]}
    byte_of = bytes_by_letter()
    split = regex.compile(PATTERN)
    strings, ids = [], []
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            s = bytes(byte_of[c] for c in token).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            continue
        if i not in added and split.fullmatch(s) and split.findall(s) == [s] and known(s):
            strings.append(s)
            ids.append(i)
    return {s: i for s, i, e in zip(strings, ids, tokenizer.encode_batch(strings, add_special_tokens=False)) if e.ids == [i]}


def known(s: str) -> bool:
    return s.isascii() or all(unicodedata.category(c) != "Cn" for c in s)


class PreTokens(dict):
    """pre-token -> what `value` makes of its ids; merges what is missing."""

    def __init__(self, spec: str, proved: dict[str, int], value, limit: int = TABLE_LIMIT):
        import regex
        from tokenizers import Tokenizer

        super().__init__((s, value([i])) for s, i in proved.items())
        self.tokenizer, self.value, self.limit = Tokenizer.from_str(spec), value, limit + len(proved)
        self.proved = proved
        self.split = regex.compile(PATTERN).findall
        self.special = [x["content"] for x in json.loads(spec)["added_tokens"]]

    def __missing__(self, s: str):
        if not known(s):
            raise LookupError(s)
        made = self.value(self.tokenizer.encode(s, add_special_tokens=False).ids)
        if len(self) >= self.limit:
            self.clear()
            self.update((s, self.value([i])) for s, i in self.proved.items())
        self[s] = made
        return made

    def of(self, text: str):
        """The values of the text's pre-tokens, or of the text as the library encodes it."""
        if not any(x in text for x in self.special):
            try:
                return list(map(self.__getitem__, self.split(text)))
            except LookupError:
                pass
        return [self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)]


class Encoder:
    """A text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.special = [x["content"] for x in json.loads(spec)["added_tokens"]]
        ranks = byte_ranks(spec)
        self.fast = tiktoken.Encoding("from file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        # UTF-16 units that send a text to the library: unassigned here, or half of a pair
        self.unsure = np.array([0xD800 <= c < 0xE000 or unicodedata.category(chr(c)) == "Cn" for c in range(0x10000)])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        plain = text.isascii() or not self.unsure[np.frombuffer(text.encode("utf-16-le"), np.uint16)].any()
        if self.fast and plain and not any(x in text for x in self.special):
            try:
                return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
            except BaseException as e:  # its regex engine gives up on very long runs of spaces, by a panic or a ValueError
                if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                    raise
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def byte_ranks(spec: str) -> dict[bytes, int] | None:
    """bytes -> id, if the ids rise in the order of the merges, so that lower ids merge first; else None."""
    model = json.loads(spec)["model"]
    byte_of = bytes_by_letter()
    vocab = model["vocab"]
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in merged or any(a >= b for a, b in zip(merged, merged[1:])) or len(merged) + 256 != len(vocab):
        return None
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}


def bytes_by_letter() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}


def counter(spec: str, proved: dict[str, int]) -> PreTokens:
    """The worker's table for one tokenizer; its values are numbers of tokens."""
    kept = worker_state()
    key = ("count", hash(spec))
    if key not in kept:
        kept[key] = PreTokens(spec, proved, len)
    return kept[key]


def encoder(spec: str) -> Encoder:
    """The worker's encoder for one tokenizer."""
    kept = worker_state()
    key = ("ids", hash(spec))
    if key not in kept:
        kept[key] = Encoder(spec)
    return kept[key]

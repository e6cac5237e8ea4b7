"""Token ids of whole texts by a public tokenizer, with a bounded memory of words in each worker."""

from __future__ import annotations

import json
import string

import numpy as np

WORDS_KEPT = 600_000
LONGEST_KEPT = 48
#: The normalizer and pre-tokenizer under which a text's ids are those of its words and marks, in order.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def parts_by_words(description: dict) -> bool:
    """Whether a tokenizer lower-cases, drops white space and encodes each word by itself, marking its end."""
    normalizers = (description.get("normalizer") or {}).get("normalizers") or []
    steps = (description.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = description["model"]
    return (
        [n["type"] for n in normalizers] == _NORMALIZERS and normalizers[1]["pattern"] == {"Regex": r"\s+"} and normalizers[1]["content"] == " "
        and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _WORDS} and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["add_prefix_space"]
        and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["continuing_subword_prefix"] and not model["dropout"]
    )


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
    return [others.get(b, chr(b)) for b in range(256)]


class _Parts(dict):
    """Ids of the parts of texts, learned as they come up and kept in two generations of half of `most` parts.

    A full generation replaces the older one; what is still in use is taken over from there.
    """

    def __init__(self, learn, most: int):
        self.learn, self.most, self.older = learn, most, {}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(part)
        if ids is None:
            ids = self.learn(self, part)
        if len(part) <= LONGEST_KEPT:
            self[part] = ids
        return ids


class WordTokenizer:
    """Ids of texts, the same as Tokenizer.encode(text, add_special_tokens=False) gives.

    Where the tokenizer's file says that each word is encoded by itself, the ids of a part between spaces
    and line ends are asked for once and kept, about `kept` parts in all (WORDS_KEPT if none is given).
    With any other tokenizer whole texts are encoded by the library.
    """

    def __init__(self, path: str, kept: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.n_ids = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        with open(path, encoding="utf-8") as f:
            self.by_words = parts_by_words(json.load(f))
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.kept = kept or WORDS_KEPT
        self.forget()

    def forget(self) -> None:
        self.parts = _Parts(self._learned, self.kept)

    def _learned(self, known: _Parts, part: str) -> bytes:
        """Ids of a part. A Latin-1 word, or a run of marks, is one symbol string for the model; a word and marks behind it are two."""
        body = part if part.isalpha() else part.rstrip(string.punctuation)
        if not (body.isascii() or max(body) < "\u0100") or body and not body.isalpha():
            return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        low, tail = body.lower(), part[len(body) :]
        if low and (tail or low != part):
            return known[low] + known[tail]
        word = low or tail
        spelled = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_words:
            return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids_of = self.parts.__getitem__
        return [np.frombuffer(b"".join(map(ids_of, _loosened(t).replace("\n", " ").split(" "))), "<u4") for t in texts]


#: What the tokenizer's patterns take for white space in Latin-1.
_BLANKS = b"\x09\x0a\x0b\x0c\x0d\x20\x85\xa0"
#: Latin-1 bytes by kind: letters and digits, white space, others.
_KINDS = bytes(97 if chr(b).isalnum() else 32 if b in _BLANKS else 33 for b in range(256))


def _loosened(text: str) -> str:
    """text lower-cased, with spaces about full stops and commas, where that surely changes no id.

    That is so in Latin-1 without special tokens: letters lower-case one by one there, and a mark that
    stands next to no other mark is a part by itself for the tokenizer.
    """
    if "<|" in text:
        return text
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    text = text.lower()
    return text if b"!!" in raw.translate(_KINDS) else text.replace(".", " . ").replace(",", " , ")


def encoded(words: WordTokenizer, texts: list[bytes], end_id: int, at_once: int = 2_000_000):
    """The ids of each text and end_id behind them, in order; texts are taken together up to at_once bytes."""
    end, held, size = np.array([end_id], "<u4"), [], 0
    for text in texts:
        held.append(text.decode("utf-8", "replace"))
        size += len(text)
        if size >= at_once:
            yield from (np.concatenate([x, end]) for x in words.encode_many(held))
            held, size = [], 0
    yield from (np.concatenate([x, end]) for x in words.encode_many(held))


_PER_WORKER: dict[str, WordTokenizer] = {}


def tokenizer(path: str, kept: int | None = None) -> WordTokenizer:
    """One for each worker process, so its memory of words serves all of the worker's tasks."""
    if path not in _PER_WORKER:
        _PER_WORKER[path] = WordTokenizer(path)
    found = _PER_WORKER[path]
    found.kept = found.parts.most = kept or WORDS_KEPT
    return found

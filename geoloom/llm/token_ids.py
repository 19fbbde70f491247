"""Whole-text encoding by the tokenizers library, one new pre-token at a time.

The ids of a text are the ids of its pre-tokens in order, for a vocabulary
whose pre-tokenizer drops white space.  Each worker keeps a bounded table of
the pre-tokens it has met; only new ones reach the library, many at once.  Text
outside the plain range below goes to the library by white-space words.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Characters that NFC leaves alone and that are lower-cased one by one, and white space.
_PLAIN = re.compile("[\t-\r -~¡-ɏ‐-‧€]*")
#: The vocabulary's pre-tokens, for lower-cased text of that range.
_LETTER = "a-zªµºÀ-ÖØ-öø-ɏ"
_PRETOKEN = re.compile(rf"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼½¾]|[^\s0-9²³¹¼½¾{_LETTER}]+")


class WordEncoder:
    """Texts to little-endian unsigned 32-bit ids.

    ``max_words`` bounds the table; when it is full it starts anew.
    """

    def __init__(self, tokenizer_file: str, max_words: int = 400_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.file, self.tokenizer = tokenizer_file, None
        with open(tokenizer_file) as file:
            model = json.load(file)["model"]
        suffix = model.get("end_of_word_suffix")
        # The same merges for text that is already split and lower-cased.
        self.merges = Tokenizer.from_file(tokenizer_file)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Ids that end a pre-token.
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        if suffix:
            self.ends[[i for piece, i in model["vocab"].items() if piece.endswith(suffix)]] = True
        self.max_words = max_words
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """The library alone; loaded only where a text needs it."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.file)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            ids = np.array(self.merges.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(part):
                self.known.update((w, self.whole(w)) for w in part)
                continue
            raw = ids.tobytes()
            self.known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, [0, *cuts], cuts, strict=False))

    def _split(self, text: str) -> list[str] | None:
        # special tokens are the library's to find
        return _PRETOKEN.findall(text.lower()) if _PLAIN.fullmatch(text) and "<|" not in text else None

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; call it with some megabytes of text at once."""
        get = self.known.get
        split: list[tuple[list[str], list]] = []
        new: set[str] = set()
        for raw in texts:
            if (words := self._split(raw.decode("utf-8", "replace"))) is None:
                words, ids = [], [self._other(w.decode("utf-8", "replace")) for w in raw.split()]
            elif None in (ids := list(map(get, words))):
                new.update([w for w, i in zip(words, ids, strict=True) if i is None])
            split.append((words, ids))
        if len(self.known) + len(new) > self.max_words:
            self.known.clear()
        if new:
            self._learn(list(new))
        return [b"".join(ids if None not in ids else [i or self.known[w] for w, i in zip(words, ids, strict=True)]) for words, ids in split]

    def _other(self, word: str) -> bytes:
        if (words := self._split(word)) is None:
            return self.whole(word)
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(list(dict.fromkeys(new)))
        return b"".join([self.known[w] for w in words])


def groups(texts: list[bytes], size: int = 4 << 20):
    """Index ranges of consecutive texts of about ``size`` bytes together."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_encoders: dict[str, WordEncoder] = {}


def encoder(tokenizer_file: str) -> WordEncoder:
    """The worker process's encoder, kept between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = WordEncoder(tokenizer_file)
    return _encoders[tokenizer_file]

"""Token ids of whole texts with a cache by word, for tokenizers that never join across white space."""

from __future__ import annotations

import json
import os
import string
import struct
from functools import lru_cache
from itertools import islice
from unicodedata import is_normalized

import numpy as np

from .common import give_back

#: Words that a worker remembers, from task to task; beyond, the half that it met first stays, which holds the frequent ones.
CACHE_WORDS = 700_000
#: Words that are tokenized as one text, where each is one piece.
TOGETHER = 200
MARKS = string.punctuation.encode()
# How a tokenizer must normalise and cut for its ids to be put together from those of words.
LOWERS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _cache(path: str) -> WordCache:
    return WordCache(path)


def word_cache(path: str, most: int = CACHE_WORDS) -> WordCache:
    """This process's cache for a tokenizer, which is to remember at most so many words from now on."""
    cache = _cache(path)
    cache.most = most
    return cache


class WordCache:
    """Ids of UTF-8 texts as little-endian unsigned 32-bit bytes.

    A tokenizer whose file lower-cases and drops white space before its merges, as LOWERS and CUTS say, gives a text the ids of its
    space-separated pieces, one after another. Each different piece is tokenized once and remembered; only ASCII white space cuts, so that all
    else is left to the tokenizer. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.most = CACHE_WORDS
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        cut = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        first = {"type": "Split", "pattern": {"Regex": CUTS}, "behavior": "Removed", "invert": True}
        then = [x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in cut[1:]]
        words = self.tokenizer.get_vocab()
        suffix = made["model"].get("end_of_word_suffix")
        #: Of each id whether its token ends a piece.
        self.ends = np.zeros(max(words.values(), default=0) + 1, bool)
        self.ends[[i for w, i in words.items() if suffix and w.endswith(suffix)]] = True
        self.by_word = made.get("normalizer") == LOWERS and cut[0] == first and all(then) and not made["model"].get("dropout")

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    def _encode(self, words: list[bytes]) -> None:
        """Remember the ids of words. Runs of letters are one piece each, so many go as one text whose ids the ends of pieces cut."""
        runs, rest = [], []
        for w in words:
            (runs if w.isalpha() or _letters(w) else rest).append(w)
        for at in range(0, len(runs), 100 * TOGETHER):
            parts = [runs[i : i + TOGETHER] for i in range(at, min(at + 100 * TOGETHER, len(runs)), TOGETHER)]
            for part, e in zip(parts, self.tokenizer.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
                if len(cuts) != len(part):
                    rest += part
                    continue
                data, start = ids.tobytes(), 0
                for w, stop in zip(part, cuts, strict=True):
                    self.known[w] = data[start:stop]
                    start = stop
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            self.known.update(zip(part, self._whole(part), strict=True))

    def settle(self) -> None:
        """At the end of a task: keep at most half the words and give free memory back, which an idle worker would hold."""
        if len(self.known) > self.most // 2:
            self.known = dict(islice(self.known.items(), self.most // 2))
        give_back()

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self._whole(texts)
        # The tokenizer lower-cases all but its special tokens, which start with <|; doing so first makes fewer words.
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.known) > self.most:
            self.known = dict(islice(self.known.items(), self.most // 2))
        known = self.known
        new = set().union(*words).difference(known)
        # ASCII marks behind a letter are a piece of their own: those words are put together from two known ones.
        ended = [(w, stem) for w in new if w[-1] in MARKS and (stem := w.rstrip(MARKS)) and b"<|" not in w and _letter_last(stem)]
        new.difference_update([w for w, _ in ended])
        new.update([stem for _, stem in ended])
        new.update([w[len(stem) :] for w, stem in ended])
        self._encode([w for w in new if w not in known])
        for w, stem in ended:
            known[w] = known[stem] + known[w[len(stem) :]]
        return [b"".join(map(known.__getitem__, w)) for w in words]


def _letters(word: bytes) -> bool:
    """Whether a word is letters only, composed and in lower case too."""
    if word.isascii():
        return False
    text = word.decode()
    return text.lower().isalpha() and is_normalized("NFC", text)


def _letter_last(word: bytes) -> bool:
    """Whether the last character is a letter and in lower case still ends with one."""
    return word[-1:].isalpha() or word[-1] > 127 and word[-4:].decode("utf-8", "ignore")[-1:].lower()[-1:].isalpha()

"""Subword ids by a public tokenizer, with a cache of words."""

from __future__ import annotations

import json
import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleanery.llm.common import Recent
from gleanery.llm.words import Words, words_of

#: Words whose ids a worker keeps: some 80 MB, as an entry takes under 200 bytes.
CACHED = 400_000
#: Words that are encoded as one text, and marks that may end a word: the vocabulary never joins them with a letter or digit before them.
JOINED, TAIL = 512, b".,!?;:|#$%*&+=~^_@/()[]{}-"
#: Letters that the vocabulary only lower-cases, and what splits texts such that they stay together.
LETTERS = "".join(chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if chr(c).isalpha())
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_loaded: dict[str, "Subwords"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def loaded(path: str) -> "Subwords":
    """The worker's own instance, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = Subwords(path)
    return _loaded[path]


def forget() -> None:
    """Frees the worker's instances, for steps that need none."""
    _loaded.clear()


def bodies(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null is empty."""
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column.cast(pa.binary())]


def lowered(texts: pa.Array) -> pa.Array:
    """The vocabulary ignores case, but for its special tokens' names."""
    return pc.if_else(pc.fill_null(pc.match_substring(texts, "<|"), False), texts, pc.ascii_lower(texts))


def _plain(part: str) -> bool:
    """Letters alone, and such as stay letters when normalized and lower-cased."""
    return part.isalpha() and max(part) < "\u0180" and part.lower().isalpha()


def _of_letters(tokenizer):
    """The same model for blank-separated words of lower-case LETTERS, without the normalizing and splitting that leave those as they are; the tokenizer itself if it splits otherwise."""
    from tokenizers import Tokenizer, pre_tokenizers

    state = lambda x: json.loads(x.__getstate__()) if x else {}
    split, steps = state(tokenizer.pre_tokenizer).get("pretokenizers", []), state(tokenizer.normalizer).get("normalizers", [])
    if [x["type"] for x in split] != ["Split", "ByteLevel"] or split[0]["pattern"] != {"Regex": SPLIT} or [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"]:
        return tokenizer
    found = Tokenizer(tokenizer.model)
    found.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return found


class Subwords:
    """Ids of a vocabulary that drops white space, so that a text's ids are its words' ids in turn.

    The vocabulary's own splitting never joins characters across blanks; the tests hold the result against encoding whole
    texts. Ids come as bytes: little-endian, 16 bits each.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.ends = np.zeros(1 << 16, dtype=bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.letters = _of_letters(self.tokenizer)
        self.words = Recent(CACHED)

    def of_words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all words in turn (16 bits each), and where each word's end."""
        found = self.words.values(words.unique, self.learned)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 2
        each = sizes[words.codes]
        ends = np.cumsum(each)
        first = np.cumsum(sizes) - sizes
        places = np.repeat(first[words.codes] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)
        return np.frombuffer(b"".join(found), dtype="<u2")[places], ends

    def of_text(self, text: bytes) -> bytes:
        return self.of_words(words_of(lowered(pa.array([text]).cast(pa.string()))))[0].tobytes()

    def learned(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words. A word is its lower-case stem and the marks after it, if the stem ends with a letter or digit: the
        vocabulary splits there, and ignores case. Words of LETTERS and marks are split and encoded together."""
        stems = pc.utf8_rtrim(words, characters=TAIL.decode())
        plain = pc.match_substring_regex(stems, f"^[{LETTERS}]+$")
        stems = pc.utf8_lower(stems.filter(plain)).dictionary_encode()
        marks = pc.utf8_ltrim(words.filter(plain), characters=LETTERS).dictionary_encode()
        of_stems, of_marks = self._plain_words(stems.dictionary.to_pylist(), self.letters), self._encoded(marks.dictionary.to_pylist())
        found = [of_stems[a] + of_marks[b] for a, b in zip(stems.indices.to_numpy().tolist(), marks.indices.to_numpy().tolist(), strict=True)]
        if len(found) == len(words):
            return found
        rest = self._other_words(words.filter(pc.invert(plain)).cast(pa.binary()).to_pylist())
        plain, both = plain.to_numpy(zero_copy_only=False), np.empty(len(words), dtype=object)
        both[plain], both[~plain] = found, rest
        return both.tolist()

    def _other_words(self, words: list[bytes]) -> list[bytes]:
        parts = [self._parts(w) for w in words]
        new = [p.decode() for p in {p for ps in parts for p in ps}]
        plain, others = [p for p in new if _plain(p)], [p for p in new if not _plain(p)]
        known = dict(zip((p.encode() for p in (*plain, *others)), (*self._plain_words(plain, self.tokenizer), *self._encoded(others)), strict=True))
        return [b"".join([known[p] for p in ps]) for ps in parts]

    def _encoded(self, parts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids := e.ids)}H", *ids) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def counted(self, words: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, lengths, times): ids of distinct stems and marks, how many each has, and how often it occurs in words (word -> times)."""
        times: dict[str, float] = {}
        for word, n in words.items():
            for part in self._parts(word):
                part = part.decode()
                times[part] = times.get(part, 0.0) + n
        plain = [p for p in times if _plain(p)]
        others = [p for p in times if not _plain(p)]
        ids, ends = self._plain_ids(plain, self.tokenizer)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        lengths = np.concatenate([np.diff(ends, prepend=0), np.array([len(f) for f in found], dtype=np.int64)])
        return np.concatenate([ids, *(np.array(f, dtype="<u2") for f in found)]), lengths, np.array([times[p] for p in (*plain, *others)])

    def _plain_ids(self, words: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters alone, encoded as texts of JOINED of them: ids, and where each word ends, which is after an id that ends a word."""
        if not words:
            return np.zeros(0, dtype="<u2"), np.zeros(0, dtype=np.int64)
        texts = [" ".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)]
        ids = np.concatenate([np.array(e.ids, dtype="<u2") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the vocabulary doesn't mark the ends of words")
        return ids, ends

    def _plain_words(self, words: list[str], tokenizer) -> list[bytes]:
        ids, ends = self._plain_ids(words, tokenizer)
        data, bounds = ids.tobytes(), [0, *(2 * ends).tolist()]
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    @staticmethod
    def _parts(word: bytes) -> tuple[bytes, ...]:
        if b"<|" in word:  # may be a special token, whose case counts
            return (word,)
        low = word.lower()
        stem = low.rstrip(TAIL)
        if len(stem) == len(low) or not stem or not (stem[-1:].isalnum() or stem[-1] >= 128 and stem.decode()[-1].lower()[-1].isalnum()):
            return (low,)
        return stem, low[len(stem) :]

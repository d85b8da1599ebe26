"""Exact token ids at the speed of a dictionary.

The tokenizers library splits a text into pieces and merges each piece on its
own.  For the two splitting rules below the pieces of a text whose characters
are all under U+0300 are found with one regular expression, and the library
encodes each different piece once; any other text goes through the library
whole.  The ids equal the library's either way.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: White space under U+0300 in the Unicode sense.
SPACE = "\t\n\x0b\x0c\r \x85\xa0"
#: Pieces that a worker keeps before it starts anew.
CACHE_PIECES = 600_000
#: Endings that both splitting rules cut off first.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: The splitting rule of the word-end vocabulary.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_ENCODERS: dict[tuple[str, bool], "PieceEncoder"] = {}


def _classes() -> tuple[str, str, str]:
    """Letters, numbers and white space under U+0300, as insides of regex classes."""
    import unicodedata

    letters = "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == "L")
    numbers = "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == "N")
    return letters, numbers, "".join(re.escape(c) for c in SPACE)


def _word_pattern() -> re.Pattern:
    letters, numbers, space = _classes()
    return re.compile("|".join(ENDINGS) + f"|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


def _byte_pattern() -> re.Pattern:
    letters, numbers, space = _classes()
    return re.compile("|".join(ENDINGS) + f"| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def _near(text: str) -> bool:
    """Whether all characters are under U+0300."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return max(text) < "\u0300"
    return True


class PieceEncoder:
    """Ids of whole texts under a tokenizer file, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, specials_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = specials_as_text
        spec = json.loads(self.tok.to_str())
        added = spec["added_tokens"]
        plain = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
        self.specials = {} if specials_as_text else {a["content"]: np.array([a["id"]], "<u4").tobytes() for a in added}
        self.split_specials = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.lower = False
        self.find = None
        model_plain = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec.get("post_processor")
        if plain and model_plain and self._is_byte_rule(spec):
            self.find = _byte_pattern().findall
        elif plain and model_plain and self._is_word_rule(spec):
            self.find, self.lower = _word_pattern().findall, True
        self.has_decoder = bool(spec.get("decoder"))
        self.cache: dict[str, bytes] = {}
        self._names: list[bytes] | None = None

    @staticmethod
    def _is_byte_rule(spec: dict) -> bool:
        pre = spec["pre_tokenizer"] or {}
        return spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")

    @staticmethod
    def _is_word_rule(spec: dict) -> bool:
        norm, pre = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        if [n.get("type") for n in norm.get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
            return False
        replace, steps = norm["normalizers"][1], pre.get("pretokenizers", [])
        if replace["pattern"] != {"Regex": "\\s+"} or replace["content"] != " " or [s.get("type") for s in steps] != ["Split", "ByteLevel"]:
            return False
        split, byte = steps
        return split["pattern"] == {"Regex": WORD_RULE} and split["behavior"] == "Removed" and split["invert"] and not byte["use_regex"] and not byte["add_prefix_space"]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if self.split_specials is None or not any(s in t for t in texts for s in self.specials):
            return self._encode_plain(texts)
        parts = [[(p, k % 2) for k, p in enumerate(self.split_specials.split(t))] for t in texts]
        plain = iter(self._encode_plain([p for ps in parts for p, special in ps if not special]))
        return [b"".join(self.specials[p] if special else next(plain) for p, special in ps) for ps in parts]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        slow, pieces = [], []
        for i, t in enumerate(texts):
            s = t.lower() if self.lower else t
            if self.find is not None and _near(t) and (s is t or _near(s)):
                pieces.append((i, self.find(s)))
            else:
                slow.append(i)
        if pieces:
            if len(self.cache) > CACHE_PIECES:
                self.cache.clear()
            cache, new = self.cache, set()
            for _, ps in pieces:
                new.update(ps)
            self._learn([p for p in new if p not in cache])
            get = cache.__getitem__
            for i, ps in pieces:
                out[i] = b"".join(map(get, ps))
        if slow:
            for i, e in zip(slow, self.tok.encode_batch([texts[i] for i in slow], add_special_tokens=False)):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def _learn(self, new: list[str]) -> None:
        """Encode pieces that are not known: words of letters many at once in one text, others each on its own."""
        glue = 0 if self.lower else 1  # the byte rule's words bring their space with them
        words = [p for p in new if p[glue:].isalpha() and (not glue or p[0] == " ")]
        for at in range(0, len(words), 2_000):
            part = words[at : at + 2_000]
            encoded = self.tok.encode((" " if self.lower else "").join(part), add_special_tokens=False)
            owner = np.array(encoded.word_ids)
            cuts = np.flatnonzero(np.diff(owner)) + 1
            if len(cuts) + 1 != len(part):
                self._learn_each(part)
            else:
                self._keep(part, np.array(encoded.ids, "<u4").tobytes(), np.concatenate([[0], cuts, [len(owner)]]))
        self._learn_each([p for p in new if not (p[glue:].isalpha() and (not glue or p[0] == " "))])

    def _learn_each(self, part: list[str]) -> None:
        for at in range(0, len(part), 20_000):
            some = part[at : at + 20_000]
            ids = [e.ids for e in self.tok.encode_batch(some, add_special_tokens=False)]
            self._keep(some, np.fromiter((x for i in ids for x in i), "<u4").tobytes(), np.cumsum([0, *map(len, ids)]))

    def _keep(self, part: list[str], flat: bytes, ends: np.ndarray) -> None:
        ends = (4 * ends).tolist()
        self.cache.update((p, flat[a:b]) for p, a, b in zip(part, ends, ends[1:]))

    def names(self) -> list[bytes]:
        """UTF-8 token text by id; ids without a token have none."""
        if self._names is None:
            vocab = self.tok.get_vocab(with_added_tokens=True)
            self._names = [None] * (max(vocab.values()) + 1)
            for token, i in vocab.items():
                self._names[i] = token.encode()
        return self._names

    def decode(self, ids: list[bytes]) -> list[str]:
        """What the library's decode(ids, skip_special_tokens=False) gives."""
        arrays = [np.frombuffer(i, "<u4") for i in ids]
        if self.has_decoder:
            return self.tok.decode_batch([a.tolist() for a in arrays], skip_special_tokens=False)
        names = self.names()  # without a decoder the library joins token texts by a space
        known, out = len(names), []
        for a in arrays:
            if len(a) and int(a.max()) >= known:
                a = a[a < known]
            out.append(b" ".join([n for n in map(names.__getitem__, a.tolist()) if n is not None]).decode())
        return out


def encoder(path: str, specials_as_text: bool = False) -> PieceEncoder:
    """One encoder for each tokenizer file and Python worker."""
    key = (path, specials_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, specials_as_text)
    return _ENCODERS[key]

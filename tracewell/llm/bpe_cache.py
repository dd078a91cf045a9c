"""Whole texts through the tokenizers library, with a cache of the ids of space-separated pieces.

A cut before a space that a non-space follows never divides a pre-token of these vocabularies: a run of white space
gives its last space to the word behind it, and the other pre-tokens hold no space inside. So the ids of a text are
those of its pieces in order. Only pieces not seen before are encoded: those of printable ASCII and Latin-1 characters, which
no normalization changes but for their case, by the vocabulary's merges alone (``Merges``, if its file describes one of the
two kinds of vocabulary that it knows), all others by the library.

With ``special`` the names of special tokens inside a text become their ids, as in the library by default: it divides a
text at them before anything else, so the parts between are encoded like texts. Else they are ordinary text.
"""
from __future__ import annotations

import json
import os
import re
from array import array
from itertools import filterfalse

import regex

ODD = re.compile(r" (?=\s|\Z)")
CUT = re.compile(r" (?=\S)")
KEEP = 700_000  # pieces held by one Python worker, some 150 MB
LONG = 48  # longer pieces are not held
PLAIN = re.compile("[\x21-\x7e\xa1-\xff]*")
# fixed values: the patterns of the two kinds of vocabulary files
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
MARKS = tuple(".,;:!?")  # one pre-token behind letters
WORD_END = "</w>"
END_BYTE = b"\xff"  # stands for the end of a word in merges; no UTF-8 text holds it

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of a vocabulary file, one per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """Ids of pieces by a vocabulary's merges; pre-tokens met before are looked up."""

    def __init__(self, held: dict, code: str):
        import tiktoken

        self.code, self.cache = code, {}
        model, letters = held["model"], byte_letters()
        self.word_end = model["end_of_word_suffix"] == WORD_END
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]

        def raw(token: str) -> bytes:
            end = self.word_end and token.endswith(WORD_END)
            return bytes(letters[c] for c in (token[:-len(WORD_END)] if end else token)) + (END_BYTE if end else b"")

        # a token's rank is its place among single bytes, then word ends, then merges in their order
        ordered = [bytes([b]) for b in range(256)]
        if self.word_end:
            ordered += [bytes([b]) + END_BYTE for b in range(255)]
        ordered += [raw("".join(pair)) for pair in merges]
        ranks = {token: i for i, token in enumerate(dict.fromkeys(ordered))}
        number = {raw(token): i for token, i in model["vocab"].items()}
        # as bytes; a merge that is no token never comes out of a vocabulary that fits
        self.ids = [array(code, [number[token]]).tobytes() if token in number else None for token in ranks]
        self.split = regex.compile(WORD_LEVEL if self.word_end else BYTE_LEVEL).findall
        self.merge = tiktoken.Encoding("merges", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    @staticmethod
    def fits(held: dict) -> bool:
        """Whether the file describes a vocabulary of one of the two kinds, with one merge for each token in the order of their ids."""
        model = held["model"]
        ids = [model["vocab"].get("".join(x.split(" ") if isinstance(x, str) else x)) for x in model.get("merges", [])]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        ordered = None not in ids and all(a < b for a, b in zip(ids, ids[1:]))
        cut, shape = held["pre_tokenizer"] or {}, held["normalizer"]
        bytes_only = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not shape and not model.get("end_of_word_suffix")
        steps = cut.get("pretokenizers", [{}])
        words_only = (
            model.get("end_of_word_suffix") == WORD_END and len(steps) == 2 and steps[0].get("pattern") == {"Regex": WORD_LEVEL} and steps[0].get("invert") is True
            and steps[0].get("behavior") == "Removed" and steps[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            and [x["type"] for x in (shape or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"])
        return bool(plain and ordered and (bytes_only or words_only))

    def encode(self, pieces: list[str], before: str) -> list[bytes]:
        """Ids of pieces that hold no white space, each behind ``before`` (a space or nothing)."""
        out, cache, merged = [], self.cache, self._merged
        if self.word_end:
            before = ""  # words take no space
        for piece in pieces:
            if self.word_end:
                piece = piece.lower()
            if piece.isalpha():  # all letters: one pre-token
                word = before + piece
                out.append(cache.get(word) or merged(word))
                continue
            if piece[-1:] in MARKS and piece[:-1].isalpha():
                found = (before + piece[:-1], piece[-1])
            else:
                found = self.split(before + piece)
            out.append(b"".join([cache.get(word) or merged(word) for word in found]))
        return out

    def _merged(self, word: str) -> bytes:
        raw = word.encode()
        ids = b"".join([self.ids[i] for i in self.merge(raw + END_BYTE if self.word_end else raw)])
        if len(word) <= LONG:
            self.cache[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # names of special tokens do not reach it unless they are ordinary text
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        marks = {i: x for i, x in self.library.get_added_tokens_decoder().items() if x.special}
        self.plain_marks = not any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in marks.values())
        self.mark_ids = {x.content: array(self.code, [i]).tobytes() for i, x in marks.items()}
        names = sorted(self.mark_ids, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        with open(path, encoding="utf-8") as held:
            described = json.load(held)
        self.merges = Merges(described, self.code) if Merges.fits(described) else None
        self.inner: dict[str, bytes] = {}  # pieces behind a space
        self.head: dict[str, bytes] = {}  # pieces at the start of a text

    def _learn(self, cache: dict[str, bytes], pieces: list[str], before: str) -> list[str]:
        others = pieces
        if self.merges:
            others, plain = [], []
            for x in pieces:
                (plain if (x.isascii() and x.isprintable() and " " not in x) or PLAIN.fullmatch(x) else others).append(x)
            cache.update(zip(plain, self.merges.encode(plain, before)))
        for at in range(0, len(others), 20_000):
            part = others[at:at + 20_000]
            found = self.library.encode_batch_fast([before + x for x in part], add_special_tokens=False)
            cache.update(zip(part, (array(self.code, x.ids).tobytes() for x in found)))
        return [x for x in pieces if len(x) > LONG] if max(map(len, pieces), default=0) > LONG else []

    def encode(self, texts: list[str], special: bool = False) -> list[bytes]:
        """Ids of each text as little-endian numbers of ``width`` bytes."""
        if special and self.marks and any(map(self.marks.search, texts)):
            if not self.plain_marks:
                raise ValueError("special tokens that take in white space or are normalized are not supported")
            parts = [self.marks.split(x) for x in texts]  # every second one is a name
            between = iter(self.encode([y for x in parts for y in x[::2]]))
            return [b"".join(self.mark_ids[y] if i % 2 else next(between) for i, y in enumerate(x)) for x in parts]
        if len(self.inner) + len(self.head) + (len(self.merges.cache) if self.merges else 0) > KEEP:
            self.inner.clear()
            self.head.clear()
            if self.merges:
                self.merges.cache.clear()
        inner, head, cut = self.inner, self.head, []
        missing: set[str] = set()
        first: set[str] = set()
        for text in texts:
            pieces = CUT.split(text) if ODD.search(text) else text.split(" ")
            cut.append(pieces)
            start = pieces[0]
            if start not in head:
                first.add(start)
            missing.update(filterfalse(inner.__contains__, pieces[1:]))
        drop = self._learn(inner, list(missing), " ")
        drop_head = self._learn(head, list(first), "")
        out = [head[p[0]] + b"".join(map(inner.__getitem__, p[1:])) for p in cut]
        for x in drop:
            del inner[x]
        for x in drop_head:
            del head[x]
        return out

"""Tokenizing whole texts with a word cache in front of the tokenizers library.

Both tokenizer files used here split a text, before the merge step, at every single space or
newline between two other characters: no token crosses it (byte-level: the space or newline
starts the next piece; word-end: both are dropped).  So a text is cut there, each distinct
piece is encoded once per worker by the library, and the ids of a text are the ids of its
pieces in a row.  A text with any other white space is cut at its lone spaces only.

A text that holds the string of a special token (which the library finds first) or U+0002, and every text
under a tokenizer file with other settings than these two, goes to the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common as C

CACHE_PIECES = 690_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters before this one need no normalization but lower case.
_BEYOND = "\u0250"
_MARKS = ".,;:!?"
#: A letter and the closing marks behind it, and what stands before marks to tell that they follow a letter.
_CLOSED = r"([A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-/:-@\[-`{-~]+)( |\z)"
_APART = "\x02"
#: That character, and white space but lone spaces and newlines between two other characters, as ``str.split`` sees it.
_ODD = (
    r"[\x02\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|[ \n][ \n]|\A[ \n]|[ \n]\z"
)
#: Bytes of the texts that are cut together, and of those that are taken at once at all.
GROUP_BYTES, LONG_BYTES = 4 << 20, 64 << 20


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    stands for itself, the others follow from U+0100 on in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _cuttable(settings: dict, space_leads: bool) -> bool:
    """Whether the file has the settings that cutting at spaces relies on."""
    before, normal, model = settings["pre_tokenizer"] or {}, settings["normalizer"] or {}, settings["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or settings.get("truncation") or settings.get("padding"):
        return False
    if space_leads:
        return not normal and before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before["use_regex"]
    steps = [x["type"] for x in normal.get("normalizers", ())], [x["type"] for x in before.get("pretokenizers", ())]
    return steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and bool(model.get("end_of_word_suffix"))


def _gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and items of the stretches of ``flat`` that ``of`` names, one behind the other."""
    first, size = first[of], size[of]
    ends = np.concatenate([[0], np.cumsum(size)])
    return ends, flat[np.arange(int(ends[-1])) + np.repeat(first - ends[:-1], size)]


class CachedTokenizer:
    """``ids(text)``: an array (uint16 if the vocabulary allows) equal to ``encode(text, add_special_tokens=False).ids``.

    The cache keeps the first ``CACHE_PIECES`` pieces a worker meets; others are encoded when
    they come, and it starts anew once four times as many have missed it.
    """

    def __init__(self, path: str, space_leads: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuttable = _cuttable(json.loads(self.tokenizer.to_str(pretty=False)), space_leads)
        self.merge = self.tokenizer.model.tokenize
        self.merges = Tokenizer(self.tokenizer.model)  # the same merges; white space parts what is never merged
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.space_leads = space_leads
        letters = byte_letters()
        self.space = letters[0x20] if space_leads else ""
        self.latin = {chr(c): "".join(letters[b] for b in chr(c).encode()) for c in range(0x250)}
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)  # ids that start with a space
        self.leads[[i for x, i in vocabulary.items() if self.space and x.startswith(self.space)]] = True
        self.mark_ids = {m: [t.id for t in self.merge(m)] for m in _MARKS}
        self.newline = [t.id for t in self.merge(letters[0x0A])] if space_leads else []
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 20, dtype=self.dtype)
        self.start = np.zeros(1 << 18, dtype=np.int64)
        self.missed = 0

    def _word(self, word: str, space: str) -> list[int] | None:
        """Ids of letters and closing marks, straight from the merge model; None for any other piece."""
        core = word.rstrip(_MARKS)
        if not core.isalpha():
            return None
        marks = word[len(core) :]
        if not self.space_leads:
            core = core.lower()
        if not core.isascii():
            if max(core) >= _BEYOND or not core.isalpha():
                return None
            core = "".join([self.latin[c] for c in core])
        ids = [t.id for t in self.merge(space + core)]
        if marks:
            if len(marks) == 1:
                ids += self.mark_ids[marks]
            else:
                ids += [t.id for t in self.merge(marks)]
        return ids

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces that follow a single space, or start with the newline before them."""
        out: list = []
        for p in pieces:
            if self.space_leads and p[:1] == "\n":
                word = self._word(p[1:], "")
                out.append(None if word is None else [*self.newline, *word])
            else:
                out.append(self._word(p, self.space))
        slow = [i for i, x in enumerate(out) if x is None]
        texts = [pieces[i] if not self.space_leads or pieces[i][:1] == "\n" else " " + pieces[i] for i in slow]
        for i, e in zip(slow, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=self.dtype)
        if not self.cuttable or _APART in text or any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        parts = text.split()
        head = None
        marks = text.count(" ") + text.count("\n")
        if len(parts) != marks + 1 or sum(map(len, parts)) + marks != len(text):  # other or repeated white space
            parts = _CUT.split(text)
            head = np.array(self.tokenizer.encode(parts[0], add_special_tokens=False).ids, dtype=self.dtype)
            if len(parts) == 1:
                return head
            parts = parts[1:]
        elif self.space_leads:
            parts = ("\n" + text.replace("\n", " \n")).split(" ")
        at = np.fromiter(map(self.index.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))
        new = np.flatnonzero(at < 0)
        fresh, number = [], {}
        if len(new):
            if self.missed > 4 * CACHE_PIECES:
                self._clear()
                return self.ids(text)
            fresh = list(dict.fromkeys([parts[i] for i in new.tolist()]))
            number = {p: len(self.index) + i for i, p in enumerate(fresh)}
            self._append(self._encode(fresh))
            at[new] = [number[parts[i]] for i in new.tolist()]
        first = self.start[at]
        size = self.start[at + 1] - first
        ends = np.cumsum(size)
        first -= ends - size
        body = self.flat[np.arange(int(ends[-1])) + np.repeat(first, size)]
        if fresh and len(self.index) + len(fresh) <= CACHE_PIECES:
            self.index.update(number)
        elif fresh:  # full: what was laid behind the cache served this text only
            self.missed += len(fresh)
        if head is not None:
            return np.concatenate([head, body])
        return body[len(self.newline) :] if self.space_leads else body

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """``ids`` of each text (null: empty).

        Texts of ``GROUP_BYTES`` are cut together in Arrow, so each distinct word of them is looked up once, without
        its closing marks, and those that the cache lacks are encoded in one call.
        """
        out = [np.empty(0, dtype=self.dtype)] * len(texts)
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        plain = (size > 0) & (size < LONG_BYTES) & (self.space_leads and self.cuttable)
        if plain.any():
            odd = pc.match_substring_regex(texts, _ODD)
            for x in self.special:
                odd = pc.or_(odd, pc.match_substring(texts, x))
            plain &= ~pc.fill_null(odd, True).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero((size > 0) & ~plain).tolist():
            out[i] = self.ids(texts[i].as_py())
        place = np.flatnonzero(plain)
        group = np.cumsum(size[place], dtype=np.int64) // GROUP_BYTES
        for some in np.split(place, np.flatnonzero(np.diff(group)) + 1):
            if len(some):
                for i, ids in zip(some.tolist(), self._group(texts.take(pa.array(some))), strict=True):
                    out[i] = ids
        return out

    def _group(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts without odd white space, where each piece follows a space."""
        if self.missed > 4 * CACHE_PIECES:
            self._clear()
        empty, newline = pa.scalar("", texts.type), pa.scalar("\n", texts.type)
        parts = pc.split_pattern(pc.binary_join_element_wise(empty, pc.replace_substring(texts, "\n", " \n"), newline), " ")
        pieces = parts.flatten().dictionary_encode()
        # of each distinct piece its letters and closing marks, which are merged apart, are looked up apart
        units = pc.split_pattern(pc.replace_substring_regex(self._joined(pieces.dictionary), _CLOSED, f"\\1 {_APART}\\2\\3"), " ").flatten()
        leads = ~pc.starts_with(units, _APART).to_numpy(zero_copy_only=False)
        units = units.dictionary_encode()
        words = self._joined(units.dictionary)[0].as_py().split(" ")
        at = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(at < 0).tolist()
        known = len(self.index)
        if new:
            new = self._lay_new(words, new)
            at[new] = known + np.arange(len(new))
        first = self.start[at]
        ends, body = _gathered(self.flat, first, self.start[at + 1] - first, units.indices.to_numpy())
        first = ends[:-1][leads]
        ends, body = _gathered(body, first, np.diff(first, append=ends[-1]), pieces.indices.to_numpy())
        kept = new[: max(0, CACHE_PIECES - known)]
        self.index.update(zip([words[i] for i in kept], range(known, known + len(kept)), strict=True))
        self.missed += len(new) - len(kept)
        ends = ends[parts.offsets.to_numpy()]
        return [body[a + len(self.newline) : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    @staticmethod
    def _joined(words: pa.Array) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")

    def _lay_new(self, words: list[str], new: list[int]) -> list[int]:
        """Lay the ids of ``words`` at ``new`` behind those of the cached pieces, in the order that is returned.

        Words of letters are merged in one call, parted by white space; an id that starts with a space starts a word.
        """
        quick, texts, other = [], [], []
        for i in new:
            word = words[i]
            if not word.isalpha():  # nor where a newline leads
                other.append(i)
                continue
            if not word.isascii():
                if max(word) >= _BEYOND:
                    other.append(i)
                    continue
                word = "".join([self.latin[c] for c in word])
            quick.append(i)
            texts.append(self.space + word)
        ids = np.array(self.merges.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        heads = np.flatnonzero(self.leads[ids])
        if len(heads) != len(quick) or (len(heads) and heads[0]):  # a vocabulary without some byte
            quick, other, ids, heads = [], new, ids[:0], heads[:0]
        apart = [i for i in other if words[i][:1] == _APART]
        other = [i for i in other if words[i][:1] != _APART]
        rest = self._encode([words[i] for i in other]) + [[t.id for t in self.merge(words[i][1:])] for i in apart]
        sizes = np.concatenate([np.diff(heads, append=len(ids)), np.fromiter(map(len, rest), dtype=np.int64, count=len(rest))])
        self._lay(np.concatenate([ids, np.array([x for e in rest for x in e], dtype=self.dtype)]), sizes)
        return quick + other + apart

    def _append(self, encoded: list[list[int]]) -> None:
        """Lay ids behind those of the cached pieces; they count only once the index has them."""
        sizes = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        self._lay(np.fromiter((x for e in encoded for x in e), dtype=self.dtype, count=int(sizes.sum())), sizes)

    def _lay(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        known = len(self.index)
        used = int(self.start[known])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while known + len(sizes) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[used : used + len(ids)] = ids
        self.start[known + 1 : known + 1 + len(sizes)] = used + np.cumsum(sizes)


_tokenizers: dict[tuple[str, bool], CachedTokenizer] = {}


def tokenizer(path: str, space_leads: bool) -> CachedTokenizer:
    """One per worker process."""
    t = _tokenizers.get((path, space_leads))
    if t is None:
        C.forget_words()  # a worker that an earlier stage used holds its fingerprints
        t = _tokenizers[path, space_leads] = CachedTokenizer(path, space_leads)
    return t

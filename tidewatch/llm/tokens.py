"""Encoding whole texts with a given tokenizer file, repeated words being encoded once.

Byte-level BPE never merges across the boundary before a single space that stands between two
other characters, so a text can be cut there and each piece looked up; a tokenizer that drops white
space can be fed word by word. Any other tokenizer gets the whole text, and so does every text that
holds the string of an added token, which the library tells from ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words remembered by a worker; beyond it those not met again lately are forgotten.
REMEMBERED = 400_000
# Bytes of text encoded together: the more, the fewer words are looked up again.
BATCH_BYTES = 6_000_000
GATHERED = 128  # texts whose ids are put together at once
_CUT = re.compile(r"(?<=\S)(?= \S)")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"  # besides blank and newline
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
# One or two of a word tokenizer's units: letters, or letters and the signs after them.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)([!-/:-@\\[-`{-~]*)")


class Memory:
    """The ids of words met lately, in two generations."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, words: set[str]) -> list[str]:
        """Those not remembered; the others are kept for another generation."""
        if len(self.new) > REMEMBERED // 2:
            self.old, self.new = self.new, {}
        gone = []
        for w in words - self.new.keys():
            if w in self.old:
                self.new[w] = self.old[w]
            else:
                gone.append(w)
        return gone


class Encoder:
    """``encode`` gives each text's ids as bytes, little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        described = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in described.get("added_tokens", [])]
        self.cut = _way_to_cut(described)
        # Whether an id ends a unit (words) or starts with a space (the other way of cutting).
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.endswith("</w>") if self.cut is _words else token.startswith("\u0120")
        self.first, self.later = Memory(), Memory()

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if self.cut is None or any(a in t for a in self.added)]
        known = dict(zip(whole, self._one_by_one([texts[i] for i in whole]), strict=True))
        rest = [i for i in range(len(texts)) if i not in known]
        if rest:
            known.update(zip(rest, self._by_pieces([texts[i] for i in rest]), strict=True))
        return [known[i] for i in range(len(texts))]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        """Texts cut into words, each different word looked up once, and the ids gathered in the words' order."""
        odd = [] if self.cut is _words else [i for i, t in enumerate(texts) if _odd(t)]
        plain = sorted(set(range(len(texts))) - set(odd))
        ready = _spaced if self.cut is _words else str
        cut = pc.split_pattern(pa.array([ready(texts[i]) for i in plain], pa.string()), " ")
        if odd:
            cut = pa.concat_arrays([cut, pa.array([self.cut(texts[i]) for i in odd], pa.list_(pa.string()))])
        words = cut.flatten().dictionary_encode()
        codes, names = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        heads = offsets[:-1]
        later = np.ones(len(codes), bool)
        later[heads] = False
        asked = np.zeros(len(names), bool)
        asked[codes[later]] = True
        firsts, codes[heads] = np.unique(codes[heads], return_inverse=True)
        codes[heads] += len(names)
        known = self._learn(self.later, {names[i] for i in np.flatnonzero(asked)}, self._words if self.cut is _words else self._after_spaces)
        table = [known[w] if a else b"" for w, a in zip(names, asked.tolist(), strict=True)]
        first = [names[i] for i in firsts]
        known = self._learn(self.first, set(first), self._one_by_one)
        table += [known[w] for w in first]
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        ids, starts = np.frombuffer(b"".join(table), "<u4"), np.cumsum(sizes) - sizes
        out = []
        for at in range(0, len(texts), GATHERED):
            bounds = offsets[at : at + GATHERED + 1]
            own = codes[bounds[0] : bounds[-1]]
            size = sizes[own]
            ends = np.cumsum(size)
            found = ids[np.repeat(starts[own] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
            stops = (4 * np.append(0, ends)[bounds - bounds[0]]).tolist()
            out += [found[a:b] for a, b in zip(stops, stops[1:])]
        return [ids for _, ids in sorted(zip(plain + odd, out, strict=True))]

    def _learn(self, memory: Memory, words: set[str], encode) -> dict[str, bytes]:
        new = memory.missing(words)
        known = memory.new
        known.update(zip(new, encode(new), strict=True))
        return known

    def _one_by_one(self, texts: list[str], lead: str = "") -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([lead + t for t in texts] if lead else texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _together(self, texts: list[str]) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)[0].ids, "<u4")

    def _after_spaces(self, words: list[str]) -> list[bytes]:
        """Words that follow a space, as one text: each begins with an id that starts with a space."""
        if _OTHER_SPACE.search("".join(words)):
            plain = [w for w in words if w.split() == [w]]
        else:  # no word holds a blank, so a newline is all that there can be
            plain = [w for w in words if w and "\n" not in w]
        if not plain:
            return self._one_by_one(words, " ")
        ids = self._together([" " + " ".join(plain)])
        found = _cut_at(ids, np.append(np.flatnonzero(self.edge[ids]), len(ids)))
        if len(found) != len(plain):
            return self._one_by_one(words, " ")
        return self._with_rest(words, plain, found, " ")

    def _words(self, words: list[str]) -> list[bytes]:
        """Words of one or two units as one text: each unit ends with an id that says so."""
        units = [(w, 1 + bool(m[2])) for w in words if (m := _PLAIN.fullmatch(w))]
        if not units:
            return self._one_by_one(words)
        plain = [w for w, _ in units]
        ids = self._together([" ".join(plain)])
        ends = np.flatnonzero(self.edge[ids]) + 1
        counts = np.cumsum([n for _, n in units])
        if len(ends) != counts[-1]:
            return self._one_by_one(words)
        return self._with_rest(words, plain, _cut_at(ids, np.append(0, ends[counts - 1])), "")

    def _with_rest(self, words: list[str], plain: list[str], found: list[bytes], lead: str) -> list[bytes]:
        known = dict(zip(plain, found, strict=True))
        rest = [w for w in words if w not in known]
        known.update(zip(rest, self._one_by_one(rest, lead), strict=True))
        return [known[w] for w in words]

    @property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size()


def _cut_at(ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    data, bounds = ids.tobytes(), (4 * at).tolist()
    return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def _odd(text: str) -> bool:
    """Whether some space does not stand between two other characters, or there is white space of other kinds."""
    edge = text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text
    return edge or (any(c in text for c in _ASCII_SPACE) if text.isascii() else bool(_OTHER_SPACE.search(text)))


def _before_spaces(text: str) -> list[str]:
    """The first piece, then those that follow a space, without it."""
    if not _odd(text):
        return text.split(" ")
    head, *rest = _CUT.split(text)
    return [head, *(p[1:] for p in rest)]


def _spaced(text: str) -> str:
    if text.isascii() or not _BEYOND_LATIN.search(text):  # there, lower case is the same everywhere
        text = text.lower()
    return text.replace("\n", " ")


def _words(text: str) -> list[str]:
    return _spaced(text).split(" ")


def _way_to_cut(described: dict):
    """How a tokenizer's texts may be cut, from its own description; None for not at all."""
    before, first = described.get("pre_tokenizer") or {}, described.get("normalizer")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in described.get("added_tokens", [])):
        return None
    if described.get("post_processor") and described["post_processor"]["type"] != "ByteLevel":
        return None
    if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not first:
        return _before_spaces
    steps = before.get("pretokenizers", [])
    if steps and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]:
        kinds = {n["type"] for n in (first or {}).get("normalizers", [])}
        if "\\s" not in steps[0]["pattern"].get("Regex", "\\s").replace("[^\\s", "") and kinds <= {"NFC", "Replace", "Lowercase"}:
            return _words
    return None


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of rows whose texts have about ``BATCH_BYTES`` together, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and worker."""
    return Encoder(path)

"""Ids of texts under a byte-level tokenizer, remembered by word in the Python worker.

The tokenizer must cut words as the published byte-level pattern does: a space belongs to the word behind
it, and no cut depends on what lies beyond a space that follows a visible character. So a text may be cut
before every such space, and each unit has the same ids wherever it stands. Arrow splits a batch of texts and
numbers its distinct units; only those are looked at one by one, and their ids are then put in place by NumPy.
"""

from __future__ import annotations

import os
import re
import sys
import types
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_WORDS = 900_000
STOPS = ".,;:!?"
# Letters of old blocks only: the tokenizer's Unicode tables may be older than Python's.
LAST_LETTER = "ɐ"
# Latin letters whose lower case is one letter, which U+0130 lacks.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
CUT = re.compile(r"(?<=\S) ")


def check_byte_level(description: dict) -> None:
    """Refuse tokenizers whose words are cut in another way than the units here."""
    cut = description.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    tokens = description.get("added_tokens") or []
    open_tokens = any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in tokens)
    if not plain or description.get("normalizer") or description.get("post_processor") or open_tokens:
        raise ValueError("the tokenizer is not plain byte-level")


def check_lower_words(description: dict) -> None:
    """Refuse tokenizers that do not lower-case and take letters, digits and other signs as separate words."""
    steps = [n["type"] for n in (description.get("normalizer") or {}).get("normalizers", [])]
    cuts = (description.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = cuts[0].get("pattern", {}).get("Regex", "") if cuts else ""
    words = pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and cuts[0].get("invert")
    plain = all(t["content"].startswith("<|") and not t["normalized"] for t in description.get("added_tokens") or [])
    ends = description["model"].get("end_of_word_suffix") == "</w>"
    if steps != ["NFC", "Replace", "Lowercase"] or not (words and ends and plain) or description.get("post_processor"):
        raise ValueError("the tokenizer does not take words one by one")


def strings(array: pa.Array) -> list[str]:
    """Python strings of an array without nulls; several times faster than one scalar after the other."""
    return array.to_numpy(zero_copy_only=False).tolist()


def placed(payloads: list[bytes], at: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the payloads numbered ``at``, in a row, and how many each has."""
    width = np.dtype(kind).itemsize
    lengths = np.fromiter(map(len, payloads), np.int32, len(payloads)) // width
    data = np.frombuffer(b"".join(payloads), kind)
    sizes, starts = lengths[at], (np.cumsum(lengths) - lengths)[at]
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind_of_place = np.int32 if total < 1 << 31 else np.int64
    places = np.repeat((starts - ends + sizes).astype(kind_of_place), sizes)
    places += np.arange(total, dtype=kind_of_place)
    return data[places], sizes


class WordMemory:
    """Payloads (little-endian unsigned ``kind`` ids) of texts.

    ``words`` maps the parts of units (a word, its stops, a line break) to their payloads. It is emptied when
    full, so memory is bounded; results do not depend on what it holds.
    """

    def __init__(self, tokenizer_json: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.width = Tokenizer.from_str(tokenizer_json), kind, np.dtype(kind).itemsize
        self.words: dict[str, bytes] = {}
        self.line_break = self.plain(["\n"])[0]
        self.stops = Stops(self.plain)

    def plain(self, texts: list[str]) -> list[bytes]:
        """Each text encoded by itself."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    @staticmethod
    def joins(word: str) -> bool:
        """Whether a word may stand in a joined text."""
        return word.split() == [word.removeprefix(" ")]

    def joined(self, words: list[str]) -> list[bytes]:
        """Words without white space but for a leading space, encoded as the lines of one text.

        The line break between two of them is always a token of its own.
        """
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, self.kind)
        breaks = np.flatnonzero(ids == np.frombuffer(self.line_break, self.kind)[0])
        if len(breaks) != len(words) - 1:
            return self.plain(words)
        data = ids.tobytes()
        starts = [0] + ((breaks + 1) * self.width).tolist()
        ends = (breaks * self.width).tolist() + [len(data)]
        return [data[a:b] for a, b in zip(starts, ends)]

    @staticmethod
    def parts(unit: str) -> list[str]:
        """What a unit consists of; its ids are those of its parts in a row."""
        lines = unit.split("\n")
        if len(lines) > 1 and unit.split() != [lines[0].removeprefix(" "), *lines[1:]]:
            return [unit]
        found = []
        for i, line in enumerate(lines):
            if i:
                found.append("\n")
            word = line.rstrip(STOPS)
            if word and word != line and word[-1] < LAST_LETTER and word[-1].isalpha():
                found += [word, line[len(word) :]]
            else:
                found.append(line)
        return found

    def learn(self, words: list[str]) -> list[bytes]:
        """Payloads of parts, from memory or newly encoded."""
        found = list(map(self.words.get, words))
        missing = [i for i, payload in enumerate(found) if payload is None]
        if not missing:
            return found
        unknown = list({words[i] for i in missing})
        if len(self.words) + len(unknown) > MAX_WORDS:
            self.words.clear()
        bare, odd = [], []
        for word in unknown:
            (bare if self.joins(word) else odd).append(word)
        for at in range(0, len(bare), 2000):
            some = bare[at : at + 2000]
            self.words.update(zip(some, self.joined(some)))
        self.words.update(zip(odd, self.plain(odd)))
        for i in missing:
            found[i] = self.words[words[i]]
        return found

    def by_hand(self, units: list[str]) -> list[bytes]:
        """Payloads of units of any kind."""
        parts = [self.parts(unit) for unit in units]
        known = iter(self.learn(list(chain.from_iterable(parts))))
        return [b"".join(islice(known, len(p))) for p in parts]

    def of_units(self, units: pa.Array) -> list[bytes]:
        """Payloads of distinct units, each behind a space."""
        words = pc.utf8_rtrim(units, STOPS)
        # Line breaks are part of a unit but no word's.
        odd = pc.match_substring(units, "\n").to_numpy(zero_copy_only=False)
        stopped = pc.not_equal(words, units).to_numpy(zero_copy_only=False) & ~odd
        whole, cut, behind = strings(units), strings(words), []
        for i in np.flatnonzero(stopped).tolist():
            word = cut[i]
            if word and word[-1] < LAST_LETTER and word[-1].isalpha():
                behind.append((i, whole[i][len(word) :]))
            else:
                odd[i] = True
        plain = pc.if_else(pa.array(odd), "", pc.binary_join_element_wise(" ", words, ""))
        known = self.learn(strings(plain))
        for i, stops in behind:
            known[i] += self.stops[stops]
        left = np.flatnonzero(odd).tolist()
        for i, payload in zip(left, self.by_hand([" " + whole[i] for i in left])):
            known[i] = payload
        return known

    def payloads(self, texts: pa.Array) -> list[bytes]:
        """The payload of each text; there are no nulls."""
        split = pc.split_pattern(texts, " ")
        encoded = pc.dictionary_encode(pc.list_flatten(split))
        at = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        first = ends - sizes
        units = encoded.dictionary
        # No cut may be behind white space: texts with such a space are cut one by one.
        trimmed = pc.utf8_rtrim_whitespace(units)
        loose = pc.or_(pc.not_equal(trimmed, units), pc.equal(units, "")).to_numpy(zero_copy_only=False)
        by_hand = np.zeros(len(sizes), bool)
        if loose.any():
            by_hand[np.searchsorted(ends, np.flatnonzero(loose[at]), side="right")] = True
        # The first unit of a text has no space before it, which all others have.
        starts = pc.if_else(pa.array(by_hand), "", units.take(pa.array(at[first])))
        at[first] = len(units) + np.arange(len(sizes))
        ids, counts = placed(self.of_units(units) + self.by_hand(strings(starts)), at, self.kind)
        bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[ends] * self.width
        data, bounds = ids.tobytes(), bounds.tolist()
        found = [data[a:b] for a, b in zip([0, *bounds], bounds)]
        for i in np.flatnonzero(by_hand).tolist():
            cut = CUT.split(texts[i].as_py())
            found[i] = b"".join(self.by_hand([cut[0], *(" " + u for u in cut[1:])]))
        return found


class LowerWordMemory(WordMemory):
    """The same for a tokenizer that lower-cases, drops white space and marks the end of every word.

    A text is cut at white space; letters and the stops behind them are words of their own.
    """

    def __init__(self, tokenizer_json: str, kind: str):
        super().__init__(tokenizer_json, kind)
        ends = [i for word, i in self.tokenizer.get_vocab().items() if word.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True

    @staticmethod
    def joins(word: str) -> bool:
        return LATIN.fullmatch(word) is not None

    def joined(self, words: list[str]) -> list[bytes]:
        """Words of plain letters, encoded as one text; each ends with the one token that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self.plain(words)
        data, bounds = ids.tobytes(), (ends * self.width).tolist()
        return [data[a:b] for a, b in zip([0, *bounds], bounds)]

    def of_units(self, units: pa.Array) -> list[bytes]:
        # Special tokens are looked for before letters are lowered.
        lowered = pc.if_else(pc.match_substring(units, "<|"), units, pc.ascii_lower(units))
        words = pc.utf8_rtrim(lowered, STOPS)
        stopped = pc.not_equal(words, lowered).to_numpy(zero_copy_only=False)
        whole, cut, behind = strings(lowered), strings(words), []
        for i in np.flatnonzero(stopped).tolist():
            word = cut[i]
            if word and LATIN.match(word[-1]):
                behind.append((i, whole[i][len(word) :]))
            else:
                cut[i] = whole[i]
        known = self.learn(cut)
        for i, stops in behind:
            known[i] += self.stops[stops]
        return known

    def payloads(self, texts: pa.Array) -> list[bytes]:
        split = pc.ascii_split_whitespace(texts)
        encoded = pc.dictionary_encode(pc.list_flatten(split))
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = encoded.indices.to_numpy(zero_copy_only=False)
        ids, counts = placed(self.of_units(encoded.dictionary), at, self.kind)
        bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[ends] * self.width
        data, bounds = ids.tobytes(), bounds.tolist()
        return [data[a:b] for a, b in zip([0, *bounds], bounds)]


class Stops(dict):
    """Payloads of rows of stops, encoded when first met. A text of stops alone keeps this from growing far."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, stops: str) -> bytes:
        if len(self) > 10_000:
            self.clear()
        value = self[stops] = self.encode([stops])[0]
        return value


def memory_of(job: str, make) -> object:
    """What this Python worker remembers for ``job``; shipped functions are new in every task, modules are not."""
    held = sys.modules.setdefault("_bankflow_llm_memory", types.ModuleType("_bankflow_llm_memory"))
    if getattr(held, "job", None) != job:
        held.job, held.value = job, make()
    return held.value

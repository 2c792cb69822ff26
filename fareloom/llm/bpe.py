"""BPE encoding and decoding with forced cuts.

A byte pair that no vocabulary token holds side by side can never be merged
across, whatever the merge order. Words are cut at such pairs, the fragments
are encoded on their own, and their ids are put one after another.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from fareloom.llm.text import as_text, list_array, parts

#: Words, and fragments, whose ids a task remembers; then it starts afresh.
REMEMBERED = 1 << 18


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves, the others for the
    characters from 256 on, in order.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Vocabulary:
    """What a tokenizer file says, in the form that encoding needs; small, made on the driver and sent to tasks."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or split[1]["type"] != "ByteLevel":
            raise ValueError(f"{path}: not a lower-casing byte-level BPE with word ends")
        self.end = model["end_of_word_suffix"]
        self.pattern = split[0]["pattern"]["Regex"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.ranks = {}
        for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.ranks.setdefault((left, right), rank)

    def joined_pairs(self) -> set[tuple[str, str]]:
        """Neighbouring symbols inside any token; a word's last symbol carries the end mark."""
        pairs = set()
        for token in self.ids:
            symbols = self.symbols(token)
            pairs.update(zip(symbols, symbols[1:]))
        return pairs

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)


# Letters and digits newer than Unicode 16, whose tables the tokenizer library has.
# The regex module knows them, so they are taken out of its classes.
NEWER_LETTERS = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2\U00016ff3"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    r"\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    r"\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
NEWER_DIGITS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"

# Capitals newer than Unicode 15, first and last, and the distance to their small letters.
NEWER_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x0264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1),
    (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x019B - 0xA7DC), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
)

#: Up to so many symbols a fragment's pairs are kept in a list, beyond that in a queue.
LONG = 128


class Encoder:
    """Encodes texts in a task; remembers the words and fragments that it has met.

    A symbol is held by its token id; pairs are keyed by both ids in one number.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = v = vocabulary
        self.plain = {c: v.ids[c] for c in byte_letters().values() if c in v.ids}
        self.last = {c: v.ids[c + v.end] for c in byte_letters().values() if c + v.end in v.ids}
        self.letters = byte_letters()
        # Neighbours inside some token, as two letters; the end mark behind them where the second ends a word.
        self.joined = {a + b.removesuffix(v.end) + v.end * b.endswith(v.end) for a, b in v.joined_pairs()}
        self.ranks, self.made = {}, {}
        for (left, right), rank in v.ranks.items():
            pair = v.ids[left] << 32 | v.ids[right]
            self.ranks[pair], self.made[pair] = rank, v.ids[left + right]
        letter, digit = rf"[\p{{L}}--[{NEWER_LETTERS}]]", rf"[\p{{N}}--[{NEWER_DIGITS}]]"
        rule = v.pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{letter}{digit}]")
        self.words = regex.compile(rule.replace(r"[\p{L}]", letter).replace(r"[\p{N}]", digit), regex.V1)
        self.special = regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")") if v.special else None
        # White space by Unicode; str.split() would also part at the four separators U+001C to U+001F.
        self.spaces = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
        self.capitals = {c: chr(c + by) for low, high, by in NEWER_CAPITALS for c in range(low, high + 1)}
        self.new_capital = regex.compile("[" + "".join(map(chr, self.capitals)) + "]")
        self.memo: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def fragments(self, word: str) -> list[str]:
        """One word's byte letters, cut wherever a neighbouring pair is in no token; the last ends on the end mark."""
        letters = word if word.isascii() and word.isalnum() else "".join(
            [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        )
        joined, end, low, out = self.joined, self.v.end, 0, []
        for at in range(1, len(letters) - 1):
            if letters[at - 1 : at + 1] not in joined:
                out.append(letters[low:at])
                low = at
        if len(letters) > 1 and letters[-2:] + end not in joined:
            out.append(letters[low:-1])
            low = len(letters) - 1
        out.append(letters[low:] + end)
        return out

    def fragment_ids(self, fragment: str) -> list[int]:
        end = self.v.end
        if fragment.endswith(end) and len(fragment) > len(end):
            body, last = fragment[: -len(end) - 1], fragment[-len(end) - 1]
            ids = [self.plain[c] for c in body if c in self.plain] + [self.last[last]] * (last in self.last)
        else:
            ids = [self.plain[c] for c in fragment if c in self.plain]
        return self.merged(ids) if len(ids) <= LONG else self.merged_long(ids)

    def merged(self, ids: list[int]) -> list[int]:
        """The pair of least rank is merged first, the leftmost of equals."""
        never = 1 << 60
        ranks, made = self.ranks, self.made
        queue = [ranks.get(a << 32 | b, never) for a, b in zip(ids, ids[1:])]
        while queue and (least := min(queue)) < never:
            i = queue.index(least)
            ids[i : i + 2] = [made[ids[i] << 32 | ids[i + 1]]]
            del queue[i]
            if i:
                queue[i - 1] = ranks.get(ids[i - 1] << 32 | ids[i], never)
            if i < len(queue):
                queue[i] = ranks.get(ids[i] << 32 | ids[i + 1], never)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same with a queue and links, for fragments of any length."""
        ranks, end = self.ranks, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = [(ranks[p], i, p) for i, p in enumerate(a << 32 | b for a, b in zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(queue)
        held = list(ids)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if held[i] < 0 or j >= end or held[i] << 32 | held[j] != pair:
                continue  # one of the two has been merged meanwhile
            held[i], held[j] = self.made[pair], -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (new := held[i] << 32 | held[k]) in ranks:
                    heapq.heappush(queue, (ranks[new], i, new))
            if (h := before[i]) >= 0 and (new := held[h] << 32 | held[i]) in ranks:
                heapq.heappush(queue, (ranks[new], h, new))
        return [i for i in held if i >= 0]

    def _learn(self, piece: str) -> bytes:
        """Packed ids of a piece; one of a single fragment shares the bytes with it."""
        ids: list[bytes] = []
        parts = self.parts
        for word in self.words.findall(piece):
            for part in self.fragments(word):
                found = parts.get(part)
                if found is None:
                    if len(parts) >= REMEMBERED:
                        parts.clear()
                    parts[part] = found = array("i", self.fragment_ids(part)).tobytes()
                ids.append(found)
        if len(self.memo) >= REMEMBERED:
            self.memo.clear()
        self.memo[piece] = packed = ids[0] if len(ids) == 1 else b"".join(ids)
        return packed

    def _plain(self, text: str) -> list[bytes]:
        text = unicodedata.normalize("NFC", text)
        if "\u03a3" in text:  # str.lower() has another sigma at the end of words
            text = text.replace("\u03a3", "\u03c3")
        if not text.isascii() and self.new_capital.search(text):
            text = text.translate(self.capitals)
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        pieces = self.spaces.split(text.lower()) if odd else text.lower().split()
        known = self.memo.get
        return [known(p) or self._learn(p) for p in pieces if p]

    def encode(self, text: str) -> np.ndarray:
        if self.special is None or "<" not in text:
            return np.frombuffer(b"".join(self._plain(text)), dtype=np.int32)
        out = []
        for part in self.special.split(text):
            if part in self.v.special:
                out.append(np.array([self.v.special[part]], np.int32).tobytes())
            elif part:
                out += self._plain(part)
        return np.frombuffer(b"".join(out), dtype=np.int32)


def _vocabulary(tokenizer: str | Vocabulary) -> Vocabulary:
    return tokenizer if isinstance(tokenizer, Vocabulary) else Vocabulary(tokenizer)


class Decoder:
    """Spells ids in a task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.table = [vocabulary.tokens.get(i) for i in range(max(vocabulary.tokens) + 1)]
        self.whole = None not in self.table

    def decode(self, ids: np.ndarray) -> str:
        numbers = ids.tolist()
        if self.whole and (not numbers or 0 <= min(numbers) and max(numbers) < len(self.table)):
            return " ".join(map(self.table.__getitem__, numbers))
        known = (self.table[i] for i in numbers if i is not None and 0 <= i < len(self.table))
        return " ".join(t for t in known if t is not None)


def encode(text: Column, tokenizer: str | Vocabulary) -> Column:
    """Token ids of whole texts as array<int>, without adding special tokens.

    ``tokenizer`` is the path of a tokenizer file, read on the driver. Special
    tokens written in a text become their ids, as the file says. Null or empty
    text has no ids.
    """
    vocabulary = _vocabulary(tokenizer)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary)
        for texts in parts(batches):
            yield list_array([encoder.encode(t) for t in as_text(texts)], pa.int32())

    return F.arrow_udf(run, "array<int>")(text)


def decode(ids: Column, tokenizer: str | Vocabulary) -> Column:
    """The tokens of ``ids`` joined by spaces, special ones included; the file names no decoder.

    Ids outside the vocabulary are left out. Null or no ids give empty text.
    """
    vocabulary = _vocabulary(tokenizer)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(vocabulary)
        none = np.zeros(0, np.int32)
        for batch in batches:
            for low in range(0, len(batch), 512):
                rows = batch.slice(low, 512)
                values = (none if r.values is None else r.values.to_numpy(zero_copy_only=False) for r in rows)
                yield pa.array([decoder.decode(v) for v in values], pa.string())

    return F.arrow_udf(run, "string")(ids)


def round_trip(text: Column, tokenizer: str | Vocabulary) -> Column:
    """struct<ids, decoded>: ``encode``, and ``decode`` of its ids, in one Python step."""
    vocabulary = _vocabulary(tokenizer)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for texts in parts(batches):
            ids = [encoder.encode(t) for t in as_text(texts)]
            spelled = pa.array([decoder.decode(i) for i in ids], pa.string())
            yield pa.StructArray.from_arrays([list_array(ids, pa.int32()), spelled], names=["ids", "decoded"])

    return F.arrow_udf(run, "struct<ids:array<int>,decoded:string>")(text)


def joined_ids(ids: Column) -> Column:
    """Ids in decimal, one space between them."""
    return F.array_join(ids.cast("array<string>"), " ")

"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

The merge list of a public tokenizer file is given; nothing is trained. From it a *sufficient
lookahead* is computed: a token boundary found in a prefix of a word stays one, whatever
follows, once that many symbols stand behind it. The encoder therefore emits tokens as soon as
they are stable and keeps a buffer of bounded length, however long a word is.

Why it is sufficient. Merges are applied in rank order. Compare the run on a prefix with the run
on the whole word, and let A be the right end of the part in which both agree. A merge of rank r
of (a, b) can move A only by crossing it: the last agreed token is a, and A moves left by the
length of a. Before a later merge (a', b') can move A again, the token right of A must have grown
out of a, so a lies on the left spine of b'. The largest sum of lengths along such a chain of
rising ranks bounds how far A moves. It holds if every merge ranks after those that make its
parts; for another list no bound is claimed, and words are encoded whole.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import map_rows

#: Characters of a text that are looked at together.
WINDOW = 1 << 16
#: Words of up to this many symbols are encoded at once and remembered; longer ones are streamed.
SHORT = 256
#: Words that a task remembers before those not met since the last time there were as many are forgotten.
REMEMBERED = 60_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Merges:
    """Vocabulary and merge list of a tokenizer file with word ends, and the lookahead they need."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.final = [vocab[c + self.end] for c in alphabet]
        self.order: dict[tuple[int, int], int] = {}
        self.out_of = [0] * len(model["merges"])
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if self.order.setdefault((vocab[left], vocab[right]), rank) == rank:
                self.out_of[rank] = vocab[left + right]
        self.length = {i: 1 for i in (*self.inner, *self.final)}
        self.lookahead = self._sufficient_lookahead()

    def _sufficient_lookahead(self) -> int | None:
        """In symbols; None if some merge ranks before one that makes its parts."""
        spine: dict[int, set[int]] = {i: {i} for i in (*self.inner, *self.final)}
        moved: dict[int, int] = {}  # by the token a merge crossed with: the furthest move so far
        made: dict[int, int] = {}  # last rank at which a token can be made
        longest = 0
        for rank in self.order.values():
            out = self.out_of[rank]
            made[out] = max(rank, made.get(out, -1))
        for (a, b), rank in self.order.items():
            out = self.out_of[rank]
            if max(made.get(a, -1), made.get(b, -1)) > rank or a not in spine or b not in spine:
                return None
            reach = self.length[a] + max(moved.get(t, 0) for t in spine[b])
            moved[a] = max(reach, moved.get(a, 0))
            longest = max(longest, reach)
            spine.setdefault(out, {out}).update(spine[a])
            self.length[out] = self.length[a] + self.length[b]
        return longest

    def encode_symbols(self, ids: list[int]) -> list[int]:
        """All merges in rank order, leftmost first within a rank. ``ids`` is used up."""
        if len(ids) > 128:
            return self._encode_heap(ids)
        rank, out_of, never = self.order, self.out_of, len(self.out_of)
        ranks = [rank.get(pair, never) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            ids[i] = out_of[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), never)
        return ids

    def _encode_heap(self, ids: list[int]) -> list[int]:
        rank, out_of, n = self.order, self.out_of, len(ids)
        token: list[int | None] = list(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(f, i, ids[i], ids[i + 1]) for i in range(n - 1) if (f := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or token[i] != a or token[j] != b:
                continue
            token[i], token[j] = out_of[best], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (f := rank.get((token[k], token[after[k]]))) is not None:
                    heapq.heappush(heap, (f, k, token[k], token[after[k]]))
        return [t for t in token if t is not None]


class WordStream:
    """The transducer: bytes of one word go in, tokens come out once they are stable."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.buffer = bytearray()
        self.most = 0

    def feed(self, data: bytes) -> list[int]:
        look = self.merges.lookahead
        self.buffer += data
        self.most = max(self.most, len(self.buffer))
        if look is None or len(self.buffer) < 2 * (look + SHORT):
            return []
        inner, length = self.merges.inner, self.merges.length
        out, at, stable = [], 0, len(self.buffer) - 1 - look
        # The last byte may turn out to end the word, which is why one more symbol is held back.
        for token in self.merges.encode_symbols([inner[b] for b in self.buffer]):
            if at + length[token] > stable:
                break
            at += length[token]
            out.append(token)
        del self.buffer[:at]
        return out

    def finish(self) -> list[int]:
        if not self.buffer:
            return []
        ids = [self.merges.inner[b] for b in self.buffer]
        ids[-1] = self.merges.final[self.buffer[-1]]
        self.buffer.clear()
        return self.merges.encode_symbols(ids)


#: How the file splits text into words (a fixed value, compared with the file when it is loaded).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Where the tokenizers library follows another version of Unicode than ``regex`` and ``unicodedata``.
#: Letters and numbers assigned after the version (16) that its classes follow; signs to it.
NEWER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7
10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff
18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96
1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead
323b0-33479 3d000-3fc3f
"""
#: Marks assigned after the version (9) that its normal form follows; to it they neither move nor join.
NEWER_MARKS = """
7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50
10f82-10f85 11070 1133b 1145e 11839-1183a 11930 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42
16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef
"""
#: Capitals that only its tables of letter case know, with their small letters.
NEWER_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


def _members(ranges: str) -> str:
    """Ranges of hexadecimal code points as the inside of a character class."""
    return "".join("-".join(f"\\U{int(end, 16):08x}" for end in part.split("-")) for part in ranges.split())


_LETTER = rf"[\p{{L}}--[{_members(NEWER)}]]"
_NUMBER = rf"[\p{{N}}--[{_members(NEWER)}]]"
_SIGN = rf"[^\s{_LETTER}{_NUMBER}]"


def _pinned(pattern: str) -> regex.Pattern:
    """A pattern of the file with the library's letters, numbers and signs."""
    for general, own in ((r"[^\s\p{L}\p{N}]", _SIGN), (r"[\p{L}]", _LETTER), (r"[\p{N}]", _NUMBER)):
        pattern = pattern.replace(general, own)
    return regex.compile(pattern, regex.V1)


class Encoder:
    """Text to packed ids (32-bit, little-endian), in pieces of bounded size."""

    def __init__(self, spec: dict | Merges, window: int = WINDOW):
        if isinstance(spec, dict):
            check_spec(spec)
            spec = Merges(spec)
        self.merges, self.window = spec, window
        self._scan = _pinned(SPLIT)
        self._find = self._scan.findall
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in self.merges.special) + ")")
        self._letter = _pinned(r"[\p{L}]")
        self._words = _Remember(self._word)
        self._parts = _Remember(self._split)
        self._bytes_of: np.ndarray | None = None

    def _word(self, word: str) -> bytes:
        data = word.encode()
        if len(data) > SHORT:
            stream = WordStream(self.merges)
            parts = [stream.feed(data[i : i + SHORT]) for i in range(0, len(data), SHORT)]
            return _packed([t for part in (*parts, stream.finish()) for t in part])
        ids = [self.merges.inner[b] for b in data]
        ids[-1] = self.merges.final[data[-1]]
        return _packed(self.merges.encode_symbols(ids))

    def _split(self, text: str) -> bytes:
        return b"".join(map(self._words.__getitem__, self._find(text)))

    def _plain(self, text: str) -> bytes:
        """A stretch of text that begins and ends at word bounds.

        Blank-separated parts are looked up first. Python's blanks are those of the pattern but
        for four control characters, which the pattern takes for signs.
        """
        text = normal(text)
        if _CONTROL.search(text):
            return self._split(text)
        return b"".join(map(self._parts.__getitem__, text.split()))

    def pieces(self, text: str) -> Iterator[bytes]:
        """Packed ids of a whole text, window by window."""
        for k, part in enumerate(self._special.split(text) if "<|" in text else (text,)):
            if k % 2:
                yield _packed([self.merges.special[part]])
            elif len(part) <= self.window:
                yield self._plain(part)
            else:
                yield from self._long(part)

    def _long(self, text: str) -> Iterator[bytes]:
        """Windows are cut before a blank: no word, and no composed character, goes across one.

        A run of more than a window without any blank goes through the word transducer.
        """
        at, n = 0, len(text)
        while at < n:
            end = min(n, at + self.window)
            if end < n:
                cut = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
                if cut < 0:
                    stop = min((x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0), default=n)
                    yield from self._run(text, at, stop)
                    at = stop
                    continue
                end = cut
            yield self._plain(text[at:end])
            at = end

    def _run(self, text: str, start: int, stop: int) -> Iterator[bytes]:
        """A run too long for a window: words that are complete are encoded, an unfinished one is streamed."""
        stream, kind, rest, at = None, None, "", start
        while at < stop:
            end = at + self.window
            while end < stop and not _starts_afresh(text, end):
                end += 1
            end = min(end, stop)
            rest += normal(text[at:end])
            at = end
            out: list[int] = []
            if stream is not None:
                same = kind.match(rest)
                taken = same.end() if same else 0
                out += stream.feed(rest[:taken].encode())
                rest = rest[taken:]
                if rest or at >= stop:
                    out += stream.finish()
                    stream = None
            done = 0
            for m in self._scan.finditer(rest) if stream is None else ():
                if m.end() + 2 > len(rest) and at < stop:
                    break  # it may go on, or turn out to begin a contraction
                out += np.frombuffer(self._words[m[0]], "<u4").tolist()
                done = m.end()
            rest = rest[done:]
            if stream is None and len(rest) > 16 and at < stop:
                # Longer than any contraction, so its kind is settled.
                stream, kind = WordStream(self.merges), _LETTERS if self._letter.match(rest) else _OTHERS
                if m := kind.match(rest):
                    out += stream.feed(m[0].encode())
                    rest = rest[m.end() :]
                else:
                    stream = None
            yield _packed(out)

    def decoder(self) -> Decoder:
        """A decoder for one text; its table is made once."""
        if self._bytes_of is None:
            self._bytes_of = Decoder(self.merges).bytes_of
        return Decoder(self.merges, table=self._bytes_of)

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.pieces(text)) if text else b""


class _Remember(dict):
    """Results of a function for short keys, in two generations: when the younger is full, the older is
    forgotten and the younger takes its place. What is asked for again is young again."""

    def __init__(self, of):
        self.of, self.older = of, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.of(key)
        if len(key) > SHORT:
            return found
        if len(self) >= REMEMBERED:
            self.older = self.copy()
            self.clear()
        self[key] = found
        return found


_CONTROL = regex.compile("[\x1c-\x1f]")
_LETTERS = _pinned(r"[\p{L}]+")
_OTHERS = _pinned(r"[^\s\p{L}\p{N}]+")
_NEWER_MARKS = regex.compile(f"([{_members(NEWER_MARKS)}])")
_NEWER_CAPITALS = regex.compile("[" + "".join(map(chr, NEWER_CAPITALS)) + "]")


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _starts_afresh(text: str, at: int) -> bool:
    """Whether normal forms of the text before and from ``at`` on can be joined."""
    here, prev = text[at], text[at - 1]
    if here < "\x80" and prev < "\x80":
        return True
    if unicodedata.combining(here) or unicodedata.combining(prev):
        return False
    nfc = unicodedata.normalize
    return nfc("NFC", prev + here) == nfc("NFC", prev) + nfc("NFC", here) and not 0x1100 <= ord(here) <= 0x11FF


def normal(text: str) -> str:
    """NFC, then lower case character by character (no final sigma), as the library's tables have them."""
    if text.isascii():
        return text.lower()
    if _NEWER_MARKS.search(text):
        text = "".join(unicodedata.normalize("NFC", part) for part in _NEWER_MARKS.split(text))
    else:
        text = unicodedata.normalize("NFC", text)
    text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
    return text.translate(NEWER_CAPITALS) if _NEWER_CAPITALS.search(text) else text


def check_spec(spec: dict) -> None:
    """Refuse a tokenizer file that works otherwise than this encoder."""
    model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if (
        model["type"] != "BPE" or model["end_of_word_suffix"] is None or model["byte_fallback"] or model["ignore_merges"]
        or model["dropout"] or kinds != ["NFC", "Replace", "Lowercase"] or steps[0]["pattern"] != {"Regex": SPLIT}
        or [s["type"] for s in steps] != ["Split", "ByteLevel"] or spec["post_processor"] or spec["decoder"]
    ):
        raise ValueError("not a byte-level BPE file with word ends, lower case and removed white space")


class Decoder:
    """Ids to text, incrementally: bytes go through a UTF-8 state machine, so that a character
    whose bytes lie in several tokens comes out when it is complete.

    ``spaced`` gives what the tokenizer file asks for, which names no decoder: the tokens'
    strings with one blank between them. Otherwise tokens are turned back into the bytes they
    stand for, a word end into a blank, and special tokens are left out.
    """

    def __init__(self, merges: Merges, spaced: bool = True, table: np.ndarray | None = None):
        self.first, self.joint = True, b" " if spaced else b""
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        if table is not None:
            self.bytes_of = table
            return
        self.bytes_of = np.empty(max(merges.text_of) + 1, object)
        self.bytes_of[:] = b""
        byte = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        special = set(merges.special.values())
        for i, s in merges.text_of.items():
            if spaced:
                self.bytes_of[i] = s.encode()
            elif i not in special:
                ended = s.endswith(merges.end)
                body = s[: len(s) - len(merges.end)] if ended else s
                self.bytes_of[i] = b"".join(byte[c] for c in body) + b" " * ended

    def feed(self, packed: bytes) -> str:
        if not packed:
            return ""
        data = self.joint.join(self.bytes_of[np.frombuffer(packed, "<u4")].tolist())
        if not self.first:
            data = self.joint + data
        self.first = False
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def read_spec(path: str) -> dict:
    """A tokenizer file, read on the driver; its size does not depend on the data."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def tokenize(docs: DataFrame, spec: dict, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` with ``n_tokens`` and ``ids``, the packed ids as binary, for every row.

    A null or empty text has no tokens. Texts are encoded whole; memory beside the text and its
    ids is bounded by the window, the lookahead and the remembered words.
    """
    return _mapped(docs, spec, keep, text, "n_tokens long, ids binary", _ids_of)


def digests(docs: DataFrame, spec: dict, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Like ``tokenize``, then decoded again; SHA-256 of the ids and of the decoded text instead of both."""
    return _mapped(docs, spec, keep, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests_of)


def decode(tokens: DataFrame, spec: dict, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", spaced: bool = False) -> DataFrame:
    """Columns ``keep`` with ``text``, decoded from packed ids; null ids give an empty text."""
    shipped = SparkSession.active().sparkContext.broadcast(Merges(spec))
    schema = ", ".join(f"`{k}` {tokens.schema[k].dataType.simpleString()}" for k in keep)

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        merges = shipped.value
        step = 4 * WINDOW
        for batch in batches:
            texts = []
            for packed in batch["_ids"]:
                machine = Decoder(merges, spaced)
                packed = packed or b""
                parts = [machine.feed(packed[i : i + step]) for i in range(0, len(packed), step)]
                texts.append("".join(parts) + machine.finish())
            yield {k: batch[k] for k in keep} | {"text": texts}

    return map_rows(tokens.select(*keep, F.col(ids).alias("_ids")), f"{schema}, text string", task)


def _ids_of(encoder: Encoder, text: str | None) -> tuple:
    packed = encoder.encode(text)
    return len(packed) // 4, packed


def _digests_of(encoder: Encoder, text: str | None) -> tuple:
    ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
    machine = encoder.decoder()
    for packed in encoder.pieces(text) if text else ():
        n += len(packed) // 4
        ids.update(packed)
        decoded.update(machine.feed(packed).encode())
    decoded.update(machine.finish().encode())
    return n, ids.hexdigest(), decoded.hexdigest()


def _mapped(docs: DataFrame, spec: dict, keep: tuple[str, ...], text: str, result: str, of) -> DataFrame:
    check_spec(spec)
    shipped = docs.sparkSession.sparkContext.broadcast(Merges(spec))  # made once; tasks hold no second copy of the file
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep) + ", " + result
    names = [part.split()[0] for part in result.split(", ")]

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = Encoder(shipped.value)
        for batch in batches:
            rows = [of(encoder, t) for t in batch["_text"]]
            yield {k: batch[k] for k in keep} | dict(zip(names, map(list, zip(*rows)) if rows else [[]] * len(names)))

    return map_rows(docs.select(*keep, F.col(text).alias("_text")), schema, task)

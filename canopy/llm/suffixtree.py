"""Language-model scoring with a probabilistic suffix tree over words.

The tree's states are contexts of up to ``depth`` words. A context is a candidate if it stands at
``LEAST`` training positions, and next symbols of a context that follow it that often are given a
probability of their own; other symbols share what is left in proportion to their probability in
the next shorter state. A candidate is retained if its distribution diverges enough from that of
the next shorter state. A text is scored word by word in the longest retained suffix of the words
before.

Scale. The floor is a number of occurrences, whatever the size of the corpus, so the tree grows with
it, and nothing of it crosses the driver. Texts are packed into chunks. For each length a chunk sends
its distinct grams (runs of words) with their counts to slices of all hashes, packed as sorted arrays,
and gets the counts over all chunks back in the same order; then it sends what its occurrences
contribute to the tests of their contexts, and gets back which contexts are retained and how they back off.
With these answers it computes every probability itself, so that no gram ever is a row. A gram can be frequent
only if the grams without its first and without its last word are; only those are sent. A gram's part of a test is
sent by one of the chunks that have it. Chunks and answers are tables in buckets by chunk, so a step shuffles neither.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import lower_words, map_rows, release
from canopy.session import materialize, read_dealt, scratch_path, write_observed

DEPTH = 3
#: Occurrences in the training text from which a context or a next symbol of a context counts.
LEAST = 2
#: Nats that a context has to save over the training text, per position at which it stands, and in all.
DIVERGENCE = 0.005
LEAST_GAIN = 12.0
#: Taken off each counted pair for the symbols not seen often enough.
DISCOUNT = 0.5
#: Tokens from which a chunk of texts is full.
CHUNK_TOKENS = 800_000
#: Bytes of texts from which a bucket of chunks is full, unless that gives more than so many buckets for a task.
BUCKET_BYTES = 4 << 20
BUCKETS_PER_TASK = 4
#: Training tokens from which the slices, in which chunks learn which of their grams are frequent, are halved.
SLICE_TOKENS = 8_000_000

#: Stands for the end of a text; no word hashes to it since words go through ``_word_hash``.
END = 1


class _Numbering(dict):
    """Words numbered from 1 as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def _word_hash(word: bytes) -> int:
    found = xxhash.xxh64_intdigest(word)
    return found if found > END else found + 2


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a context extended by a word."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(0x2545F4914F6CDD1D)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        return x


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, sorted, where the first of each stands, and which of them each value is, as ``np.unique`` has them.

    Sorted are plain numbers, hashes with their places for low bits: several times as fast as sorting places by hash.
    """
    low = np.uint64((1 << max(1, len(values)).bit_length()) - 1)
    order = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    order.sort()
    order = (order & low).astype(np.int64)
    found = values[order]
    if (found[1:] < found[:-1]).any():  # some differ in the low bits only
        return np.unique(values, return_index=True, return_inverse=True)
    new = np.ones(len(values), bool)
    new[1:] = found[1:] != found[:-1]
    at = np.empty(len(values), np.int64)
    at[order] = np.cumsum(new) - 1
    return found[new], order[new], at


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: bytes of like size stand together and compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _of_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).view(kind).ravel()


def _squeezed(n: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as one byte each, and those that do not fit as eight."""
    return np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype(np.int64).tobytes()


def _counts_of(small: bytes | None, large: bytes | None, n: int) -> np.ndarray:
    """The counts of ``n`` grams from their squeezed form; none was answered where there was nothing to ask."""
    found = np.frombuffer(small, np.uint8).astype(np.int64) if small else np.zeros(n, np.int64)
    found[found == 255] = np.frombuffer(large or b"", np.int64)
    return found


def _stored(data: bytes, kind: type = np.uint8) -> bytes:
    """Compressed planes, after their length."""
    return len(data).to_bytes(8, "little") + pa.compress(_planes(np.frombuffer(data, kind)), codec="zstd", asbytes=True) if data else b""


def _restored(data: bytes | None, kind: type = np.uint8) -> bytes:
    return _of_planes(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), kind).tobytes() if data else b""


CHUNKS = "chunk long, ids array<long>, held array<boolean>, lengths binary, tokens binary, vocabulary binary"


def chunked(docs: DataFrame, is_held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts packed into chunks: per text the id, its fold and its number of tokens; the tokens as
    positions in the chunk's vocabulary, compressed; the vocabulary as word hashes. The last token of a text is
    its end. Written as a table, so that a chunk is the same in all later steps; in buckets by chunk, as all
    that is told to chunks later."""

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        def done() -> dict:
            return {
                "chunk": [0], "ids": [ids], "held": [held], "lengths": [np.array(lengths, np.int32).tobytes()],
                "tokens": [pa.compress(_planes(np.concatenate(tokens)), codec="zstd", asbytes=True)], "vocabulary": [np.array([END, *map(_word_hash, number)], np.uint64).tobytes()],
            }

        number = _Numbering()
        ids, held, lengths, tokens, size = [], [], [], [], 0
        for batch in batches:
            for i, h, t in zip(batch["id"], batch["held"], batch["_text"]):
                found = lower_words(t)
                at = np.fromiter(map(number.__getitem__, found), np.int32, len(found))
                tokens.append(np.append(at, np.int32(0)))
                ids.append(i)
                held.append(h)
                lengths.append(len(found) + 1)
                size += len(found) + 1
                if size >= CHUNK_TOKENS:
                    yield done()
                    number = _Numbering()
                    ids, held, lengths, tokens, size = [], [], [], [], 0
        if ids:
            yield done()

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), is_held_out.alias("held"), F.col(text).cast("binary").alias("_text"))
    packed = map_rows(rows, CHUNKS, task).withColumn("chunk", F.monotonically_increasing_id())
    path, buckets = scratch_path(docs.sparkSession, "chunks"), _buckets(rows)
    write_observed(packed.withColumn("buckets", F.lit(buckets)), path, dealt=("chunk", buckets), rows=F.count(F.lit(1)))
    return read_dealt(docs.sparkSession, path)


def _buckets(rows: DataFrame) -> int:
    """Buckets for the chunks of these texts: by their size, but one for each task that packs them at least."""
    tasks = max(1, rows.rdd.getNumPartitions())
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(tasks, min(BUCKETS_PER_TASK * tasks, -(-size // BUCKET_BYTES)))


@dataclass
class Chunk:
    """One chunk's tokens as word hashes, with the place of each within its text."""

    vocabulary: np.ndarray
    tokens: np.ndarray
    starts: np.ndarray
    train: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, held: list[bool], lengths: bytes, tokens: bytes, vocabulary: bytes) -> Chunk:
        n = np.frombuffer(lengths, np.int32).astype(np.int64)
        starts = np.cumsum(n) - n
        tokens = pa.decompress(tokens, 4 * int(n.sum()), codec="zstd", asbytes=True)
        return cls(
            np.frombuffer(vocabulary, np.uint64), _of_planes(tokens, np.int32), starts,
            np.repeat(~np.array(held, bool), n), np.arange(n.sum()) - np.repeat(starts, n),
        )

    def grams(self, known: Answers, last: int) -> Iterator[Grams]:
        """The grams of lengths 1 to ``last`` that may be frequent, by the answers to those of shorter ones."""
        words = self.vocabulary[self.tokens]
        shorter = None
        for k in range(1, last + 1):
            if k == 1:
                gram = _mixed(np.zeros(1, np.uint64), self.vocabulary)
                distinct, _, rank = _distinct(gram)
                found = Grams(np.arange(len(words)), gram[self.tokens], distinct, rank[self.tokens], None)
            else:
                n = shorter.spread(shorter.n)
                in_context = (np.append(0, n[:-1]) >= known.least_context) & (self.place >= k - 1)
                where = np.flatnonzero(in_context & (n >= known.least_pair))
                gram = _mixed(np.append(np.uint64(0), shorter.gram[:-1]), words)
                distinct, _, at = _distinct(gram[where])
                found = Grams(where, gram, distinct, at, np.flatnonzero(in_context))
            found.n = known.counts(k, len(found.distinct))
            yield found
            shorter = found


@dataclass
class Grams:
    """Grams of one length in a chunk: positions at which one that may be frequent ends, the hash of the gram at
    every position, the distinct ones of the open positions and which of them each has; the positions that stand
    after a context one word shorter; how often each distinct one occurs in all training text."""

    where: np.ndarray
    gram: np.ndarray
    distinct: np.ndarray
    at: np.ndarray
    in_context: np.ndarray | None
    n: np.ndarray | None = None

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values of the distinct grams at every position, 0 where none is open."""
        if len(self.where) == len(self.gram):
            return values[self.at]
        out = np.zeros(len(self.gram), values.dtype)
        out[self.where] = values[self.at]
        return out


@dataclass
class Answers:
    """What a chunk has been told so far: by step, the small and the large part of an answer, as they are stored.

    Step ``n_k`` has the counts of its grams of ``k`` words, ``b_k`` which of those are retained contexts, one byte
    each, and the backoff of those that are. A context has to occur ``least_context`` times, a gram ``least_pair`` times.
    """

    told: dict[str, tuple[bytes | None, bytes | None]]
    least_context: int
    least_pair: int
    total: int
    types: int

    def counts(self, k: int, n: int) -> np.ndarray | None:
        if f"n_{k}" not in self.told:
            return None
        small, large = self.told[f"n_{k}"]
        return _counts_of(_restored(small), _restored(large, np.int64), n)

    def backoff(self, k: int, n: np.ndarray) -> np.ndarray:
        """The backoff of the grams of ``k`` words, which occur ``n`` times, as contexts; not a number where they are not retained."""
        small, large = self.told[f"b_{k}"]
        out = np.full(len(n), np.nan)
        asked = np.flatnonzero(n >= self.least_context)
        if small:
            out[asked[np.frombuffer(_restored(small), np.uint8) > 0]] = np.frombuffer(_restored(large, np.float64), np.float64)
        return out

    def probabilities(self, chunk: Chunk, last: int) -> Iterator[tuple[Grams | None, Grams, np.ndarray]]:
        """For lengths 1 to ``last``: the grams one word shorter, the grams, and P of every token in its longest
        retained context of fewer words than the length. The last one needs no answer about contexts of its own."""
        shorter = None
        for k, found in enumerate(chunk.grams(self, last), 1):
            if k == 1:
                p = root(found.spread(found.n), self.total, self.types)
            elif f"b_{k - 1}" in self.told:
                p = self._longer(shorter, found, k, p)
            yield shorter, found, p
            shorter = found

    def _longer(self, shorter: Grams, found: Grams, k: int, p: np.ndarray) -> np.ndarray:
        """P in the contexts of ``k - 1`` words where they are retained."""
        at = found.in_context
        context = np.zeros(len(found.gram), np.int64)
        context[shorter.where] = shorter.at
        worth = self.backoff(k - 1, shorter.n)[context[at - 1]]
        kept = ~np.isnan(worth)
        at, of_context = at[kept], context[at[kept] - 1]
        n = found.spread(found.n)[at]
        out = p.copy()
        out[at] = np.where(n >= self.least_pair, (n - DISCOUNT) / shorter.n[of_context], worth[kept] * p[at])
        return out


@dataclass
class Tree:
    """A whole tree in memory, for tables whose tree is small enough.

    Retained contexts by depth and the counted next symbols of each; ``chains`` has all candidate
    contexts of a depth, sorted, and the next shorter part of each.
    """

    total: int = 0
    types: int = 0
    depths: list[dict[str, np.ndarray]] = field(default_factory=list)
    chains: list[dict[str, np.ndarray]] = field(default_factory=list)

    def root(self, counts: np.ndarray) -> np.ndarray:
        return root(counts, self.total, self.types)

    def shorter(self, contexts: np.ndarray, depth: int, words: np.ndarray, root: np.ndarray) -> np.ndarray:
        """P of words in the longest retained state that is shorter than candidate contexts of ``depth``."""
        chain = []
        for d in range(depth, 1, -1):
            level = self.chains[d - 1]
            contexts = level["shorter"][_find(level["hash"], contexts)[0]]
            chain.append(contexts)
        p = root
        for level, context in zip(self.depths, reversed(chain)):
            p = in_state(level, context, words, p)
        return p


def root(counts, total: int, types: int):
    """P of words by their counts, an array or a column."""
    return (counts + 0.5) / (total + 0.5 * (types + 1))


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in a sorted array, and whether it does."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def in_state(level: dict[str, np.ndarray], context: np.ndarray, words: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P of words in those of the contexts that are states of the level; ``p`` as it is elsewhere."""
    at, known = _find(level["context"], context)
    where = np.flatnonzero(known)
    symbol, seen = _find(level["pair"], _mixed(context[where], words[where]))
    out = p.copy()
    own = level["p"][symbol] if len(level["p"]) else 0.0
    out[where] = np.where(seen, own, level["backoff"][at[where]] * p[where])
    return out


def _per_chunk(chunks: DataFrame, schema: str, of) -> DataFrame:
    """What ``of`` gives for each chunk, its number and what it was told in the steps so far, with ``first`` of the last one."""
    steps = [c.removeprefix("small_") for c in chunks.columns if c.startswith("small_")]
    of_steps = [f"{part}_{step}" for step in steps for part in ("small", "large")] + [c for c in chunks.columns if c == "first"]

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for i, number in enumerate(batch["chunk"]):
                told = {step: (batch[f"small_{step}"][i], batch[f"large_{step}"][i]) for step in steps}
                told["first"] = batch["first"][i] if "first" in batch else None
                yield of(Chunk.of(*(batch[c][i] for c in ("held", "lengths", "tokens", "vocabulary"))), number, told, batch["ids"][i])

    return map_rows(chunks.select("chunk", "ids", "held", "lengths", "tokens", "vocabulary", *of_steps), schema, task)


def word_counts(chunks: DataFrame) -> tuple[DataFrame, int, int]:
    """(word, n) of the training tokens, with their number and the number of different ones."""

    def of(chunk: Chunk, number: int, told: dict, ids: list) -> dict:
        n = np.bincount(chunk.tokens[chunk.train], minlength=len(chunk.vocabulary))
        some = n > 0
        return {"word": chunk.vocabulary[some].view(np.int64), "n": n[some]}

    counted, types = materialize(
        _per_chunk(chunks, "word long, n long", of).groupBy("word").agg(F.sum("n").alias("n")), "words"
    )
    release(chunks.sparkSession)
    return counted, int(counted.agg(F.sum("n")).first()[0] or 0), types


def _numpy(rows: DataFrame, order: list[str]) -> dict[str, np.ndarray]:
    table = rows.select(*order).toArrow()
    return {name: table[name].to_numpy() for name in order}


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64).view(np.uint64)


SENT = "slice long, chunk long, keys binary, small binary, large binary, tested binary, sums binary"
ANSWERED = "chunk long, slice long, small binary, large binary, first binary, occurrences long, fresh long"


def _sent(number: int, bits: int, keys: np.ndarray, n: np.ndarray, tested: np.ndarray | None = None, sums: np.ndarray | None = None) -> dict:
    """Sorted hashes, as what each is more than the one before, with their counts, cut into slices of all hashes.

    With ``tested``, counts are rows for those hashes only, and so are the sums.
    """
    slices = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, slices[1:] != slices[:-1])) if len(keys) else np.zeros(0, np.int64)
    parts = [slice(i, j) for i, j in zip(starts, np.append(starts[1:], len(keys)))]
    if tested is None:
        of_parts, marks, more = parts, [b""] * len(parts), [b""] * len(parts)
    else:
        before = np.append(0, np.cumsum(tested))
        of_parts = [slice(before[part.start], before[part.stop]) for part in parts]
        marks = [np.packbits(tested[part]).tobytes() for part in parts]
        more = [_planes(sums[:, part].ravel()) for part in of_parts]
    squeezed = [_squeezed(n[..., part].ravel()) for part in of_parts]
    return {
        "slice": slices[starts], "chunk": np.full(len(parts), number), "keys": [_planes(np.diff(keys[part], prepend=np.uint64(0))) for part in parts],
        "small": [small for small, _ in squeezed], "large": [large for _, large in squeezed], "tested": marks, "sums": more,
    }


def _received(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of a slice; where the first of each stands among all rows' hashes, one after the other, and
    which of them each of those is; where rows end."""
    rows = [np.cumsum(_of_planes(keys, np.uint64), dtype=np.uint64) for keys in table["keys"].to_pylist()]
    return *_distinct(np.concatenate(rows)), np.cumsum([len(own) for own in rows])


def _replies(table: pa.Table, small: list[bytes], large: list[bytes], first: list[bytes], occurrences: int = 0, fresh: int = 0) -> pa.Table:
    once = [0] * (table.num_rows - 1)
    binary = pa.binary()
    return pa.table({
        "chunk": table["chunk"], "slice": table["slice"], "small": pa.array(small, binary), "large": pa.array(large, binary), "first": pa.array(first, binary),
        "occurrences": pa.array([occurrences, *once], pa.int64()), "fresh": pa.array([fresh, *once], pa.int64()),
    })


def _bits(marks: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(marks, np.uint8), count=n).astype(bool)


def _told(chunks: DataFrame, step: str, sent: DataFrame, answer, large_kind: type, buckets: int) -> tuple[DataFrame, int, int]:
    """The chunks with the answers of a step; the occurrences counted and the hashes that have some."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("slice")
        small, large, first = (table[c].to_pylist() for c in ("small", "large", "first"))
        marks = [_bits(own, np.count_nonzero(np.frombuffer(of, np.uint8))) for own, of in zip(first, small) if own]
        whole = {
            "small": _stored(b"".join(small)), "large": _stored(b"".join(large), large_kind),
            "first": np.packbits(np.concatenate(marks)).tobytes() if marks else b"",
        }
        sums = {c: pa.array([sum(table[c].to_pylist())], pa.int64()) for c in ("occurrences", "fresh")}
        return pa.table({"chunk": table["chunk"][:1], **{c: pa.array([v], pa.binary()) for c, v in whole.items()}, **sums})

    replies = sent.groupBy("slice").applyInArrow(lambda table: answer(table.sort_by("chunk")), ANSWERED)
    packed = replies.groupBy("chunk").applyInArrow(pack, "chunk long, small binary, large binary, first binary, occurrences long, fresh long")
    path = scratch_path(chunks.sparkSession, "told")
    seen = write_observed(
        packed, path, dealt=("chunk", buckets), rows=F.count(F.lit(1)), occurrences=F.sum("occurrences"), fresh=F.sum("fresh")
    )
    told = read_dealt(chunks.sparkSession, path)
    release(chunks.sparkSession)
    told = told.select("chunk", F.col("small").alias(f"small_{step}"), F.col("large").alias(f"large_{step}"), "first")
    return chunks.drop("first").join(told.hint("shuffle_hash"), "chunk", "left"), seen["occurrences"] or 0, seen["fresh"] or 0


def _with_counts(chunks: DataFrame, k: int, bits: int, least: tuple[int, int], buckets: int) -> tuple[DataFrame, int, int]:
    """The chunks, told how often their grams of ``k`` words occur in all training text: 0 for less than the floor, but
    for single words; and of which of those that reach it they are the first to have them."""

    def of(chunk: Chunk, number: int, told: dict, ids: list) -> dict:
        for found in chunk.grams(Answers(told, *least, 0, 0), k):
            pass
        return _sent(number, bits, found.distinct, np.bincount(found.at[chunk.train[found.where]], minlength=len(found.distinct)))

    def answer(table: pa.Table) -> pa.Table:
        keys, first, at, ends = _received(table)
        lengths = np.diff(ends, prepend=0)
        n = [_counts_of(small, large, own) for small, large, own in zip(table["small"].to_pylist(), table["large"].to_pylist(), lengths)]
        all_n = np.bincount(at, np.concatenate(n), len(keys)).astype(np.int64)
        told = np.where(all_n >= least[1], all_n, 0) if k > 1 else all_n
        is_first = np.zeros(len(at), bool)
        is_first[first] = True
        of_rows = np.split(told[at], ends[:-1])
        marks = [np.packbits(own[n > 0]).tobytes() for own, n in zip(np.split(is_first, ends[:-1]), of_rows)]
        return _replies(table, *map(list, zip(*map(_squeezed, of_rows))), marks, int(all_n.sum()), int(np.count_nonzero(all_n)))

    return _told(chunks, f"n_{k}", _per_chunk(chunks, SENT, of), answer, np.int64, buckets)


def _with_contexts(
    chunks: DataFrame, k: int, bits: int, least: tuple[int, int], total: int, types: int, divergence: float, least_gain: float, buckets: int
) -> DataFrame:
    """The chunks, told which of their grams of ``k`` words are retained as contexts, and how these back off.

    The first chunk that has a gram of one more word contributes the gram's probabilities for all of its occurrences.
    """

    def of(chunk: Chunk, number: int, told: dict, ids: list) -> dict:
        for contexts, found, p in Answers(told, *least, total, types).probabilities(chunk, k + 1):  # noqa: B007
            pass
        context = np.zeros(len(found.gram), np.int64)
        context[contexts.where] = contexts.at
        asked = contexts.n >= least[0]
        some = np.flatnonzero(found.n >= least[1])
        some = some[_bits(told["first"], len(some))] if told["first"] else some[:0]
        one = np.zeros(len(found.distinct), np.int64)
        one[found.at] = found.where
        n, at = found.n[some], one[some]
        of_context, shorter = context[at - 1], p[at]
        own = (n - DISCOUNT) / contexts.n[of_context]
        summed = [np.bincount(of_context, part, len(asked))[asked] for part in (n, np.ones(len(n)), shorter, n * np.log(own / shorter))]
        tested = summed[0] > 0
        seen, symbols, *sums = (part[tested] for part in summed)
        counts = np.array([contexts.n[asked][tested], seen, symbols], np.int64)
        return _sent(number, bits, contexts.distinct[asked], counts, tested, np.array(sums))

    def answer(table: pa.Table) -> pa.Table:
        keys, _, at, ends = _received(table)
        tested = [_bits(marks, own) for marks, own in zip(table["tested"].to_pylist(), np.diff(ends, prepend=0))]
        squeezed = zip(table["small"].to_pylist(), table["large"].to_pylist(), tested)
        counts = np.concatenate([_counts_of(small, large, 3 * own.sum()).reshape(3, -1) for small, large, own in squeezed], axis=1)
        sums = np.concatenate([_of_planes(own, np.float64).reshape(2, -1) for own in table["sums"].to_pylist()], axis=1)
        at_tested = at[np.concatenate(tested)]
        all_n = np.zeros(len(keys), np.int64)
        all_n[at_tested] = counts[0]
        seen, symbols, others, gain = (np.bincount(at_tested, part, len(keys)) for part in (*counts[1:], *sums))
        own = (seen - DISCOUNT * symbols) / np.maximum(all_n, 1)
        back = np.maximum(1 - own, 1e-12) / np.maximum(1 - others, 1e-12)
        gain = gain + (all_n - seen) * np.log(back)
        kept = (seen > 0) & (gain >= divergence * all_n) & (gain >= least_gain)
        replies = [(kept[i].astype(np.uint8).tobytes(), back[i][kept[i]].tobytes()) for i in np.split(at, ends[:-1])]
        return _replies(table, *map(list, zip(*replies)), [b""] * table.num_rows)

    return _told(chunks, f"b_{k}", _per_chunk(chunks, SENT, of), answer, np.float64, buckets)[0]


def fitted(
    chunks: DataFrame, depth: int, context_share: float, symbol_share: float, divergence: float, least_gain: float
) -> tuple[DataFrame, tuple[int, int], int, int]:
    """The chunks, told all about their grams of up to ``depth + 1`` words; the floors; the numbers of training tokens and of different ones."""
    n, buckets = chunks.agg(F.count(F.lit(1)), F.coalesce(F.max("buckets"), F.lit(1))).first()
    bits = min(32, (n * CHUNK_TOKENS // SLICE_TOKENS).bit_length() + 3)
    chunks, total, types = _with_counts(chunks, 1, bits, (LEAST, LEAST), buckets)
    least_context, least_pair = (max(LEAST, int(np.ceil(share * total))) for share in (context_share, symbol_share))
    least = max(least_context, least_pair), least_pair
    for k in range(1, depth + 1):
        chunks = _with_counts(chunks, k + 1, bits, least, buckets)[0]
        chunks = _with_contexts(chunks, k, bits, least, total, types, divergence, least_gain, buckets)
    return chunks, least, total, types


def fit(
    chunks: DataFrame, counted: DataFrame, total: int, types: int, depth: int,
    context_share: float, symbol_share: float, divergence: float, least_gain: float,
) -> Tree:
    """The tree in memory; for looking at the tree of a small table, scoring does not use it."""
    chunks, least, total, types = fitted(chunks, depth, context_share, symbol_share, divergence, least_gain)

    def of(chunk: Chunk, number: int, told: dict, ids: list) -> dict:
        out: dict[str, list] = {c: [] for c in ("k", "gram", "context", "suffix", "q", "b")}
        known = Answers(told, *least, total, types)
        for k, (shorter, found, p) in enumerate(known.probabilities(chunk, depth + 1), 1):
            one = np.zeros(len(found.distinct), np.int64)
            one[found.at] = found.where
            some = np.flatnonzero(found.n >= (least[1] if k > 1 else 1))
            place = one[some]
            b = known.backoff(k, found.n) if k <= depth else np.full(len(found.distinct), np.nan)
            none = np.zeros(len(some), np.uint64)
            own = (
                np.full(len(some), k), found.distinct[some].view(np.int64), (none if k == 1 else shorter.gram[place - 1]).view(np.int64),
                (none if k == 1 else shorter.gram[place]).view(np.int64), p[place], b[some],
            )
            for column, values in zip(out.values(), own):
                column.append(values)
        return {c: np.concatenate(values) for c, values in out.items()}

    rows = _per_chunk(chunks, "k int, gram long, context long, suffix long, q double, b double", of)
    rows = rows.groupBy("k", "gram").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.max("q").alias("q"), F.min("b").alias("b"))
    rows, _ = materialize(rows.withColumn("b", F.expr("CASE WHEN NOT isnan(b) THEN b END")), "tree")
    tree = Tree(total, types)
    for d in range(1, depth + 1):
        level = rows.where(F.col("k") == d)
        kept = level.where("b IS NOT NULL")
        found = _numpy(kept, ["gram", "b"])
        order = np.argsort(_unsigned(found["gram"]))
        own = _numpy(rows.where(F.col("k") == d + 1).join(kept.select(F.col("gram").alias("context")), "context"), ["gram", "q"])
        by_pair = np.argsort(_unsigned(own["gram"]))
        tree.depths.append({
            "context": _unsigned(found["gram"])[order], "backoff": found["b"][order],
            "pair": _unsigned(own["gram"])[by_pair], "p": own["q"][by_pair],
        })
        chain = _numpy(level, ["gram", "suffix"] if d > 1 else ["gram"])
        order = np.argsort(_unsigned(chain["gram"]))
        tree.chains.append({name: _unsigned(chain[c])[order] for name, c in zip(("hash", "shorter"), ("gram", "suffix")) if c in chain})
    return tree


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(
    docs: DataFrame,
    is_held_out: Column,
    depth: int = DEPTH,
    context_share: float = 0.0,
    symbol_share: float = 0.0,
    divergence: float = DIVERGENCE,
    least_gain: float = LEAST_GAIN,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10) of every text.

    Texts that are not held out train the tree. The shares raise the floors of contexts and of their
    next symbols to that part of the training positions; by default they do not. A null text is empty and has one token, its end.
    Without training texts every token is unknown and has probability 1.
    """
    chunks, least, total, types = fitted(chunked(docs, is_held_out), depth, context_share, symbol_share, divergence, least_gain)

    def of(chunk: Chunk, number: int, told: dict, ids: list) -> dict:
        for k, (_, found, p) in enumerate(Answers(told, *least, total, types).probabilities(chunk, depth + 1), 1):
            if k == 1:
                counts = found.spread(found.n)
        sums = lambda x: np.add.reduceat(x, chunk.starts)
        n = sums(np.ones(len(counts), np.int64))
        values = (
            ids, ~chunk.train[chunk.starts], n, sums((counts > 0).astype(np.int64)), np.full(len(n), total),
            sums(np.log10(root(counts, total, types))), sums(np.log10(p)),
        )
        return dict(zip((part.split()[0] for part in SCORES.split(", ")), values))

    return _per_chunk(chunks, SCORES, of)

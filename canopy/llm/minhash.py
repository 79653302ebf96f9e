"""Near-duplicates by fast similarity sketching.

A document is the set of its distinct five-word shingles. Sketching throws the set into ``t``
bins, round after round: in the first t rounds every element picks a bin by a hash of its own,
in the next t rounds all elements go to one bin after the other, so that every bin is filled,
in a few rounds if the set is large. Equal bins of two sketches estimate the Jaccard similarity
with the concentration of independent samples. Bands of bins make candidates, and candidates
are confirmed on the whole sets.

Large groups of copies. Equal sets are one class from the start. Within a bucket members are
compared with one pivot, and a bucket whose members are then connected needs no more. Where
several components are left in a bucket, its members are compared by sketch, in blocks; families of
agreeing sketches that still have several components are compared on their whole sets, in blocks,
by products of membership matrices. Pairs are never written, only forests of the links found. So no link between different texts
is lost to a cap, and a group of n near copies that are linked costs about n comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import lower_words, map_rows, release
from canopy.llm.components import Forest, components, in_blocks, own_ids, same_owner
from canopy.session import materialize

SHINGLE = 5
ROWS = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Probability at most that a pair at the threshold shares no band.
MISS = 5e-7
#: Sketches that agree in fewer bins than so many standard deviations below the threshold are not compared further.
DEVIATIONS = 6.25
PIVOT_ROUNDS = 2
BLOCK = 512
#: Shingles that one task compares with one pivot.
SLICE = 400_000


def bands_for(percent: int) -> int:
    """Bands that a threshold needs: 25 at 85 %, 37 at 80 %."""
    return math.ceil(math.log(MISS) / math.log1p(-((min(percent, 99) / 100) ** ROWS)))


def least_agreeing(percent: int, bins: int) -> float:
    """Bins in which the sketches of a pair at the threshold agree all but surely."""
    share = min(percent, 99) / 100
    return bins * share - DEVIATIONS * math.sqrt(bins * share * (1 - share))


BINS = ROWS * bands_for(PERCENT)

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; forgotten all at once when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: bytes | None, known: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text; fewer words than a shingle make one."""
    found = lower_words(text)
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, n)
    k = min(n, width)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j])
    return np.unique(out)


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Sketches of non-empty sets, one row each: in every bin the first round that filled it and the least hash then."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    table = np.full(len(sets) * bins, _EMPTY)
    t = np.uint64(bins)
    for turn in range(2 * bins):
        with np.errstate(over="ignore"):
            h = mix64(x + np.uint64(turn + 1) * np.uint64(0xD1B54A32D192ED03))
        if turn < bins:
            place = of * bins + (((h >> np.uint64(32)) * t) >> np.uint64(32)).astype(np.int64)
        else:
            place = of * bins + (turn - bins)
        value = (np.uint64(turn) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        free = table[place] == _EMPTY
        np.minimum.at(table, place[free], value[free])
        left = (table.reshape(-1, bins) == _EMPTY).any(1)
        if not left.any():
            break
        stay = left[of]
        x, of = x[stay], of[stay]
    return table.reshape(-1, bins)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One signed 64-bit key per band; the band's number is part of it."""
    n, bins = sketch.shape
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(1, bins // rows + 1, dtype=np.uint64), (n, 1))
        for r in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sketch[:, r::rows])
    return key.view(np.int64)


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, sketch) of every row; the last three null without words."""
    bins = ROWS * bands_for(percent)

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        known = WordHashes()
        for batch in batches:
            ids, texts, at = batch["doc_id"], batch["_text"], 0
            while at < len(ids):
                sets, size, start = [], 0, at
                while at < len(ids) and size < 1_000_000:
                    sets.append(shingles(texts[at], known))
                    size += len(sets[-1])
                    at += 1
                some = [i for i, s in enumerate(sets) if len(s)]
                sketch = sketches([sets[i] for i in some], bins)
                short = mix64(sketch).astype(np.uint16)
                keys = band_keys(sketch)
                digest, bands, packed = ([None] * len(sets) for _ in range(3))
                for row, i in enumerate(some):
                    digest[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    bands[i] = keys[row].tolist()
                    packed[i] = short[row].tobytes()
                yield {
                    "doc_id": ids[start:at], "n_shingles": [len(s) for s in sets],
                    "digest": digest, "bands": bands, "sketch": packed,
                }

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text"))
    return map_rows(rows, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary", task)


def set_table(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, n, sketch, shingles) of the wanted (id, doc, digest, sketch), their whole sets packed.

    ``doc`` is a document whose text has the set of that digest.
    """

    def task(batches: Iterator[dict]) -> Iterator[dict]:
        known = WordHashes()
        for batch in batches:
            keep: list[tuple] = []
            for i, t, d, s in zip(batch["id"], batch["_text"], batch["digest"], batch["sketch"]):
                found = shingles(t, known)
                if xxhash.xxh3_128_digest(found.tobytes()) == d:
                    keep.append((i, len(found), s, found.tobytes()))
            yield dict(zip(("id", "n", "sketch", "shingles"), map(list, zip(*keep)) if keep else ([], [], [], [])))

    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("_text"))
    found = map_rows(texts.join(wanted, "doc"), "id long, n long, sketch binary, shingles binary", task)
    return materialize(found.dropDuplicates(["id"]), "sets")[0]


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the distinct pairs (a, b) whose whole sets are similar enough.

    The partners of one ``a`` are cut into slices by their shingles; the set of ``a`` goes to
    each slice once, not to each pair.
    """
    lean = sets.select(F.col("id").alias("b"), F.col("n").alias("_n"))
    sized = pairs.join(lean, "b")
    slices = sized.groupBy("a").agg((F.floor(F.sum("_n") / SLICE) + 1).cast("int").alias("_slices"))
    part = F.pmod(F.xxhash64("b"), F.col("_slices")).cast("int")
    sliced = pairs.join(slices, "a").select("a", "b", part.alias("_part"))
    theirs = sliced.join(sets.select(F.col("id").alias("b"), "sketch", "shingles"), "b")
    own = slices.join(sets.select(F.col("id").alias("a"), "sketch", "shingles"), "a")
    every = F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))
    own = own.select(F.col("a").alias("_pivot"), every.alias("_slice"), "sketch", "shingles")

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, kept = key[0].as_py(), []
        if right.num_rows:
            mine = np.frombuffer(right["shingles"][0].as_py(), np.uint64)
            look = np.frombuffer(right["sketch"][0].as_py(), np.uint16)
            for b, sketch, packed in zip(left["b"].to_pylist(), left["sketch"].to_pylist(), left["shingles"].to_pylist()):
                if np.count_nonzero(np.frombuffer(sketch, np.uint16) == look) < least_agreeing(percent, len(look)):
                    continue
                other = np.frombuffer(packed, np.uint64)
                few, many = sorted((mine, other), key=len)
                if 100 * len(few) < percent * len(many):
                    continue
                at = np.searchsorted(many, few)
                both = int(np.count_nonzero(many[np.minimum(at, len(many) - 1)] == few))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    kept.append(b)
        return pa.table({"a": pa.array([a] * len(kept), pa.int64()), "b": pa.array(kept, pa.int64())})

    grouped = theirs.groupBy("a", "_part").cogroup(own.groupBy("_pivot", "_slice"))
    return grouped.applyInArrow(compare, "a long, b long")


def _pivot_pairs(buckets: DataFrame, turn: int) -> DataFrame:
    """(a, b): the pivot of each bucket with its members of other components."""
    pivots = buckets.groupBy("key").agg(
        F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("a"),
        F.min("component").alias("_low"),
        F.max("component").alias("_high"),
        F.min_by("component", F.xxhash64("id", F.lit(turn))).alias("_own"),
    )
    open_ones = pivots.where(F.col("_low") < F.col("_high")).select("key", "a", "_own")
    met = buckets.join(open_ones, "key").where(F.col("component") != F.col("_own"))
    return met.select("a", F.col("id").alias("b")).distinct()


def _grouped(cells: DataFrame, group: str, size: str, n: int) -> DataFrame:
    """Cells with a ``_group``: cells of small groups share one, cells of large groups have their own."""
    shared = F.pmod(F.xxhash64(group), F.lit(max(1, n // BLOCK)))
    own = F.xxhash64(group, "_i", "_j")
    return cells.withColumn("_group", F.when(F.col(size) <= BLOCK, shared).otherwise(own))


def _each_cell(table: pa.Table, group: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, bool]]:
    """The cells of a group of cells: rows, the places of both sides, and whether they are one block."""
    table = table.sort_by([(c, "ascending") for c in (group, "_i", "_j", "id")])
    keys = np.stack([table[c].to_numpy() for c in (group, "_i", "_j")])
    cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), table.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        cell = table.slice(lo, hi - lo)
        own, inside = cell["_own"].to_numpy(), keys[1, lo] == keys[2, lo]
        left = np.flatnonzero(own == keys[1, lo])
        yield cell, left, left if inside else np.flatnonzero(own != keys[1, lo]), inside


def _agreeing(sketch: np.ndarray, left: np.ndarray, right: np.ndarray, inside: bool, percent: int) -> np.ndarray:
    """Which sketches of the two sides agree in enough bins; one block is compared with itself once."""
    least = least_agreeing(percent, sketch.shape[1])
    out = np.stack([np.count_nonzero(sketch[right] == sketch[x], axis=1) >= least for x in left])
    return np.triu(out, 1) if inside else out


def _sketches_of(cell: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(cell["sketch"].to_pylist()), np.uint16).reshape(cell.num_rows, -1)


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, by products of membership matrices."""
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    out = np.zeros((len(left), len(right)))
    for lo in range(0, len(every), width):
        a, b = np.searchsorted(at, (lo, lo + width))
        member = np.zeros((len(sets), width), np.float32)
        member[of[a:b], at[a:b] - lo] = 1
        out += member[left] @ member[right].T
    return out


def _families(buckets: DataFrame, sketch_of: DataFrame, percent: int) -> DataFrame | None:
    """(id, component, family): members of buckets with several components, joined where sketches agree.

    Only a forest of the agreeing pairs is written: at most one row per member and cell.
    """
    shape = buckets.groupBy("key").agg(
        F.count(F.lit(1)).alias("_size"),
        F.min("component").alias("_low"),
        F.max("component").alias("_high"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("_of"),
    )
    # Buckets of several bands with the same members are looked at once.
    once = shape.where(F.col("_low") < F.col("_high")).groupBy("_size", "_of").agg(F.min("key").alias("key"))
    members, n = materialize(buckets.join(once.select("key", "_size"), "key").join(sketch_of, "id"), "crowded")
    if not n:
        return None
    cells = _grouped(in_blocks(members, "key", F.col("_size"), "id", BLOCK), "key", "_size", n)

    def compare(table: pa.Table) -> pa.Table:
        forest = Forest()
        for cell, left, right, inside in _each_cell(table, "key"):
            ids = cell["id"].to_numpy()
            for x, y in zip(*np.nonzero(_agreeing(_sketches_of(cell), left, right, inside, percent))):
                forest.union(int(ids[left[x]]), int(ids[right[y]]))
        a, b = forest.links()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    family = components(cells.groupBy("_group").applyInArrow(compare, "a long, b long"))
    named = members.select("id", "component").distinct()
    found = family.join(named, "id").withColumnRenamed("component_id", "family")
    several = found.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("_low"), F.max("component").alias("_high"))
    open_ones = several.where(F.col("_low") < F.col("_high")).select("family", "size")
    return materialize(found.join(open_ones, "family"), "families")[0]


def _cross_links(families: DataFrame, n: int, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) that connect what the whole sets of different components of a family link."""
    cells = in_blocks(families.join(sets.select("id", "sketch", "shingles"), "id"), "family", F.col("size"), "id", BLOCK)

    def compare(table: pa.Table) -> pa.Table:
        forest = Forest()
        for cell, left, right, inside in _each_cell(table, "family"):
            label = cell["component"].to_numpy()
            open_pairs = _agreeing(_sketches_of(cell), left, right, inside, percent) & (label[left][:, None] != label[right][None, :])
            some, other = np.flatnonzero(open_pairs.any(1)), np.flatnonzero(open_pairs.any(0))
            if not len(some):
                continue
            ids = cell["id"].to_numpy()
            packed = cell["shingles"].to_pylist()
            places = np.unique(np.concatenate([left[some], right[other]]))
            sets_here = [np.frombuffer(packed[k], np.uint64) for k in places]
            size = np.array([len(s) for s in sets_here])
            x, y = np.searchsorted(places, left[some]), np.searchsorted(places, right[other])
            both = intersections(sets_here, x, y)
            linked = 100 * both >= percent * (size[x][:, None] + size[y][None, :] - both)
            for p, q in zip(*np.nonzero(linked & open_pairs[np.ix_(some, other)])):
                forest.union(int(ids[left[some[p]]]), int(ids[right[other[q]]]))
        a, b = forest.links()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _grouped(cells, "family", "size", n).groupBy("_group").applyInArrow(compare, "a long, b long")


def _labelled(buckets: DataFrame, label: DataFrame | None) -> DataFrame:
    """Buckets (key, id) with the component that each member is known to be in."""
    if label is None:
        return buckets.withColumn("component", F.col("id"))
    return buckets.join(label, "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    component_id is the smallest doc_id reachable over links, kept marks the row that bears it.
    Texts without words are linked with nothing. A row without doc_id links with nothing, has no
    component and is kept. Each different text is a class of its own in the search; an id that comes
    with several texts is one document that has the links of all of them.
    """
    rows, _ = materialize(sketched(docs, doc_id, text, percent), "sketches")
    usable = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    first, _ = materialize(
        usable.join(classes, "digest").where(F.col("doc_id") == F.col("rep"))
        .select(F.col("rep").alias("id"), F.col("rep").alias("doc"), "digest", "bands", "sketch").dropDuplicates(["id", "digest"]),
        "classes",
    )
    several = usable.groupBy("doc_id").agg(F.min("digest").alias("_low"), F.max("digest").alias("_high")).where("_low < _high")
    several, n_several = materialize(several.select("doc_id"), "several-texts")
    links = None
    if n_several:
        first = own_ids(first, "digest")
        classes = first.select("digest", F.col("id").alias("rep"))
        named = usable.join(several, "doc_id").select("doc_id", "digest").join(classes, "digest")
        links, _ = materialize(same_owner(named.select("doc_id", F.col("rep").alias("id")), "doc_id"), "same-id")
    exploded = first.select("id", F.explode("bands").alias("key"))
    crowded = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    buckets, n = materialize(exploded.join(crowded, "key").select("key", "id"), "buckets")
    release(docs.sparkSession)
    label = None if links is None else components(links)
    if n:
        sets = set_table(docs, first.select("id", "doc", "digest", "sketch").join(buckets.select("id").distinct(), "id"), doc_id, text)
        release(docs.sparkSession)
        for turn in range(PIVOT_ROUNDS):
            pairs, n_pairs = materialize(_pivot_pairs(_labelled(buckets, label), turn), "pairs")
            if not n_pairs:
                break
            new, n_new = materialize(confirmed(pairs, sets, percent), "confirmed")
            links = new if links is None else links.unionByName(new)
            label = components(links) if n_new else label
            release(docs.sparkSession)
        families = _families(_labelled(buckets, label), first.select("id", "sketch"), percent)
        if families is not None:
            new, n_new = materialize(_cross_links(families, families.count(), sets, percent), "confirmed")
            label = components(new if links is None else links.unionByName(new)) if n_new else label
    result = rows.join(classes, "digest", "left")
    own = F.coalesce("rep", "doc_id")
    if label is not None:
        result = result.join(label, result["rep"] == label["id"], "left")
        own = F.coalesce("component_id", "rep", "doc_id")
    result = result.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, components.

A document's set holds the 64-bit hashes of its distinct shingles of ``shingle`` words (A-Z lower-cased). Documents with
the same set are one class from the start. Each class gets a SuperMinHash signature: every element brings a random
permutation of the positions whose ranks rise by one a step, so a document is done once its largest value is below the
next step. Bands of the signature are bucket keys. In every bucket each class is compared with one pivot. Where a
bucket then still holds several components, the class linked with most pivots is compared with the others, and what
that leaves meets by its rarest elements (a prefix filter, which is exact). Every comparison is confirmed on the full sets, and links are joined into components.

With 32 bands of 4 values a pair at the threshold of 0.8 shares no band once in 20 million. Pairs whose signatures agree
in less than 0.6 of 128 positions are not confirmed: at a likeness of 0.8 that happens less than once in a million.

Sizes: an oversize bucket is never gathered; it costs one row a member (the pivot) and, only where components remain,
the rarest fifth of its members' elements. Nothing is capped or sampled.

Defined cases: null and empty texts have no shingles and are linked with nothing; fewer words than a shingle make one
shingle of the whole sequence; repeated rows are one class and each gets its row; a row without id is linked with nothing;
of equally good pivots the one with the least set hash is taken, which changes no result; other columns of the input are
not read, or kept as they are by ``keep_one`` under any name that does not start with ``__``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import bounded_batches, cut, cut_counted, mix, slices, windows_hash, word_hashes, words_of
from .components import components

POSITIONS, BANDS, SHINGLE, PERCENT = 128, 32, 4, 80
ROWS = POSITIONS // BANDS
LANES, AGREE = POSITIONS // 8, int(0.6 * POSITIONS)
#: Elements whose permutations are held at a time.
ELEMENTS = 100_000
SLICE = 700_000
#: Counters that order elements by rarity.
SLOTS = 1 << 20
#: Bits of a set's map of its elements.
MAP_BITS = 512


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after the other, row offsets)."""
    codes, offsets, distinct = words_of(texts, lower=True)
    words = word_hashes(distinct)[codes] if len(codes) else np.empty(0, np.uint64)
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    hashes, rows = [], []
    if len(words) >= width:
        runs = windows_hash(words, width)
        inside = row[: len(runs)] == row[width - 1 :]
        hashes.append(runs[inside])
        rows.append(row[: len(runs)][inside])
    short = np.flatnonzero((n > 0) & (n < width))
    for k in range(1, width):  # whole sequences of k words
        those = short[n[short] == k]
        if len(those):
            at = offsets[those]
            value = np.full(len(those), np.uint64(k))
            for j in range(k):
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + words[at + j])
            hashes.append(value)
            rows.append(those)
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(len(n) + 1))


_TO_UNIT, _ALL = 2.0**-32, (1 << 64) - 1


def super_minhash(elements: np.ndarray, offsets: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """Signatures (rows x positions) of the sets between ``offsets``; empty sets keep infinity."""
    n = len(offsets) - 1
    least = np.full(n * positions, np.inf)
    h, row = elements, np.repeat(np.arange(n), np.diff(offsets))
    order = np.tile(np.arange(positions, dtype=np.uint8), (len(h), 1))
    for step in range(positions):
        if not len(h):
            break
        drawn = mix(h + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & _ALL))
        rank = step + (drawn >> np.uint64(32)).astype(np.float64) * _TO_UNIT
        other = step + ((drawn & np.uint64(0xFFFFFFFF)).astype(np.float64) * _TO_UNIT * (positions - step)).astype(np.int64)
        mine = np.arange(len(h))
        here = order[mine, other]
        order[mine, other] = order[:, step]
        np.minimum.at(least, row * positions + here, rank)
        full = least.reshape(n, positions).max(axis=1) < step + 1
        stay = ~full[row]
        if not stay.all():
            h, row, order = h[stay], row[stay], order[stay]
    return least.reshape(n, positions)


def features(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, lanes, bands) of every document; the last three null without shingles or id."""
    schema = "doc_id long, text_hash long, n_shingles long, set_key long, lanes array<long>, bands array<long>"

    def lists(values: np.ndarray, present: np.ndarray) -> pa.Array:
        width = values.shape[1]
        flat = pa.array(np.ascontiguousarray(values[present]).view(np.int64).ravel())
        ends = np.concatenate([[0], np.cumsum(np.where(present, width, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(~present))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(2), SLICE):
                ids, hashes, texts = (batch.column(i).slice(start, stop - start) for i in range(3))
                elements, offsets = shingle_sets(texts, shingle)
                n = np.diff(offsets)
                signed = []
                first = 0
                while first < len(n):  # as many rows as keep the permutations in bounds, one at least
                    last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + ELEMENTS, side="right")) - 1)
                    signed.append(_signature(elements[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]))
                    first = last
                sig = np.concatenate(signed)
                present = (n > 0) & ~np.asarray(ids.is_null())
                bits = mix(sig.view(np.uint64))
                lanes = np.ascontiguousarray((bits & np.uint64(255)).astype(np.uint8)).view(np.uint64)
                band = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
                keys = np.repeat(band, len(n), axis=0)
                for k in range(ROWS):
                    keys = mix(keys + bits[:, k::ROWS])
                yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(n.astype(np.int64)), pa.array(_set_keys(elements, offsets), mask=~present), lists(lanes, present), lists(keys, present)], names=["doc_id", "text_hash", "n_shingles", "set_key", "lanes", "bands"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _set_keys(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements ^ np.uint64(0xA0761D6478BD642F)))])
    return mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def _signature(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SuperMinHash, a part of a very large set at a time (the least of the parts' values is the set's)."""
    if len(elements) <= ELEMENTS:
        return super_minhash(elements, offsets)
    parts = [super_minhash(elements[i : i + ELEMENTS], np.array([0, min(ELEMENTS, len(elements) - i)])) for i in range(0, len(elements), ELEMENTS)]
    return np.minimum.reduce(parts)


def agreeing(a: Column, b: Column) -> Column:
    """Positions in which two signatures agree, from their packed eight-bit lanes."""
    differ = F.lit(0)
    for k in range(LANES):
        x = F.get(a, k).bitwiseXOR(F.get(b, k))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(POSITIONS) - differ


def _alike(a: str, b: str, percent: int) -> Column:
    """Sizes and signatures that leave a likeness of ``percent`` possible."""
    small, large = F.least(f"{a}_n", f"{b}_n"), F.greatest(f"{a}_n", f"{b}_n")
    return (small * 100 >= large * percent) & (agreeing(F.col(f"{a}_lanes"), F.col(f"{b}_lanes")) >= AGREE * percent // PERCENT)


def class_sets(keys: DataFrame, classes: DataFrame, documents: DataFrame, shingle: int) -> DataFrame:
    """(set_key, elements) of the classes in ``keys``, read again from one text of each."""
    wanted, n = cut_counted(keys.select("set_key").join(classes.select("set_key", "doc_id"), "set_key").select("doc_id").distinct())
    texts, _ = bloom.split(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", wanted, n)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(0), SLICE):
                elements, offsets = shingle_sets(batch.column(0).slice(start, stop - start), shingle)
                raw = elements.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(_set_keys(elements, offsets)), pa.array([raw[8 * i : 8 * j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["set_key", "elements"])

    return texts.select("text").mapInArrow(sets, "set_key long, elements binary").dropDuplicates(["set_key"])


def confirm(pairs: DataFrame, classes: DataFrame, documents: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set keys whose full sets have 100 * intersection >= percent * union.

    Only texts of classes in a pair are read again; a pair carries one set to the other.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    keys = pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key"))).distinct()
    found = class_sets(keys, classes, documents, shingle)
    one = pairs.join(found.select(F.col("set_key").alias("b"), F.col("elements").alias("eb")), "b")
    two = one.join(found.select(F.col("set_key").alias("a"), F.col("elements").alias("ea")), "a")
    return two.select("a", "b", "ea", "eb").mapInArrow(check, "a long, b long")


def open_pairs(rest: DataFrame, classes: DataFrame, documents: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``rest`` (set_key, root) with unlike roots that may be linked, by their rarest elements.

    Two sets of that likeness share one of the first n - ceil(percent n / 100) + 1 elements of each, in any one order of
    all elements, and what stands before a shared element counts against their overlap. So does every bit that is set
    in one's map of elements only, as it stands for an element that the other lacks. The order is by how many sets
    of ``rest`` have an element of the same hash slot (at most SLOTS numbers go to the driver and back), then by the
    element. Under each element, classes of its most frequent root are only compared with the others, never with one another.
    """
    known = rest.join(classes.select("set_key", "n"), "set_key")
    each = cut(class_sets(rest, classes, documents, shingle).join(known, "set_key").select("set_key", "root", "n", "elements"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                slot, times = np.unique(np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(SLOTS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(times)], names=["slot", "times"])

    counts = each.select("elements").mapInArrow(slots, "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    often_ = np.zeros(SLOTS, dtype=np.int32)
    often_[np.asarray(counts.column("slot"))] = np.minimum(np.asarray(counts.column("times")), np.iinfo(np.int32).max)
    shared = documents.sparkSession.sparkContext.broadcast(often_)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(batch.column("elements")):
                elements = np.frombuffer(x.as_buffer(), np.uint64)
                times = shared.value[(elements % np.uint64(SLOTS)).astype(np.int64)]
                order = np.lexsort((elements, times))[: len(elements) - -(-len(elements) * percent // 100) + 1]
                before = np.flatnonzero(times[order] > 1)  # what one set alone has meets no other
                own = batch.slice(i, 1).take(pa.array(np.zeros(len(before), np.int64)))
                bits = np.zeros(MAP_BITS, np.uint8)
                bits[(elements >> np.uint64(40)) % np.uint64(MAP_BITS)] = 1
                held = np.tile(np.packbits(bits).view(np.int64), (len(before), 1))
                maps = [pa.array(np.ascontiguousarray(held[:, k])) for k in range(MAP_BITS // 64)]
                yield pa.RecordBatch.from_arrays([pa.array(elements[order[before]].view(np.int64)), own.column("set_key"), own.column("root"), own.column("n"), pa.array(before), *maps], names=["element", "set_key", "root", "n", "before", *bit_names])

    bit_names = [f"m{k}" for k in range(MAP_BITS // 64)]
    prefix = cut(each.mapInArrow(first, "element long, set_key long, root long, n long, before long, " + ", ".join(f"{m} long" for m in bit_names)))
    often = prefix.groupBy("element", "root").agg(F.count("*").alias("c")).groupBy("element").agg(F.max_by("root", F.struct("c", "root")).alias("often"), F.count("*").alias("roots")).filter("roots > 1")
    held = prefix.join(often.select("element", "often"), "element")
    side = lambda name: held.select("element", "often", *[F.col(c).alias(f"{name}_{c}") for c in ("set_key", "root", "n", "before", *bit_names)])
    x, y = side("x").filter("x_root <> often").drop("often"), side("y").drop("often")
    room = F.least(F.col("x_n") - F.col("x_before"), F.col("y_n") - F.col("y_before"))  # overlap from the shared element on
    least = F.ceil((F.col("x_n") + F.col("y_n")) * percent / (100 + percent))
    small, large = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
    lacks = lambda a, b: sum((F.bit_count(F.col(f"{a}_{m}").bitwiseAND(F.bitwise_not(F.col(f"{b}_{m}")))) for m in bit_names), F.lit(0))
    alike = (F.col("x_n") - lacks("x", "y") >= least) & (F.col("y_n") - lacks("y", "x") >= least)
    met = x.join(y, "element").filter((F.col("x_root") != F.col("y_root")) & (small * 100 >= large * percent) & (room >= least) & alike)
    return met.select(F.least("x_set_key", "y_set_key").alias("a"), F.greatest("x_set_key", "y_set_key").alias("b")).distinct()


def _open_members(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """(band, set_key, root) of the buckets of three or more that hold several components, and the number of rows."""
    rooted = members.filter("members > 2").join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select("band", "set_key", F.coalesce("root", "set_key").alias("root"))
    several = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band")
    return cut_counted(rooted.join(several, "band", "left_semi"))


def _absorb(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further links (a, b) between any set keys."""
    for c in ("a", "b"):
        named = roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        links = links.join(named, c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    above = cut(components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
    alone = above.join(roots.select("node"), "node", "left_anti")
    higher = above.select(F.col("node").alias("root"), F.col("root").alias("__top"))
    return roots.join(higher, "root", "left").select("node", F.coalesce("__top", "root").alias("root")).unionByName(alone.select("node", "root"))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``documents``."""
    return judged(documents, shingle, percent).drop("text_hash")


def judged(documents: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``near_duplicates`` with a hash of each row's text."""
    bounded_batches(documents.sparkSession)
    held = cut(features(documents, shingle))
    linked = held.filter("set_key IS NOT NULL")
    classes = cut(linked.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("lanes").alias("lanes"), F.first("bands").alias("bands")))
    buckets = classes.select("set_key", F.explode("bands").alias("band"))
    pivots = cut(buckets.groupBy("band").agg(F.min("set_key").alias("pivot"), F.count("*").alias("members")).filter("members > 1"))
    members = cut(buckets.join(pivots, "band"))
    side = lambda name: classes.select(F.col("set_key").alias(name), F.col("n").alias(f"{name}_n"), F.col("lanes").alias(f"{name}_lanes"))
    first = members.filter("set_key <> pivot").select(F.col("pivot").alias("a"), F.col("set_key").alias("b")).distinct()
    first = first.join(side("b"), "b").join(side("a"), "a").filter(_alike("a", "b", percent)).select("a", "b")
    links = cut(confirm(cut(first), classes, documents, shingle, percent))
    roots = cut(components(links))
    # buckets of three or more in which the pivot left several components: first the member linked with most pivots is
    # compared with the others, then what is left by rarest elements
    degrees = links.groupBy(F.col("b").alias("set_key")).agg(F.count("*").alias("degree"))  # pivots that it is linked with
    left, n_left = _open_members(members, roots)
    if n_left:
        known = left.join(degrees, "set_key", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        hubs = known.groupBy("band").agg(F.max_by(F.struct("set_key", "root"), F.struct("degree", "set_key")).alias("hub"))
        met = known.join(hubs, "band").filter("root <> hub.root").select(F.least("set_key", "hub.set_key").alias("a"), F.greatest("set_key", "hub.set_key").alias("b")).distinct()
        alike = met.join(side("b"), "b").join(side("a"), "a").filter(_alike("a", "b", percent)).select("a", "b")
        roots = cut(_absorb(roots, confirm(cut(alike), classes, documents, shingle, percent)))
        left, n_left = _open_members(members, roots)
    if n_left:
        rest = cut(left.select("set_key", "root").distinct())
        more = open_pairs(rest, classes, documents, shingle, percent)
        alike = more.join(side("b"), "b").join(side("a"), "a").filter(_alike("a", "b", percent)).select("a", "b")
        roots = cut(_absorb(roots, confirm(cut(alike), classes, documents, shingle, percent)))
    joined = classes.select("set_key", "doc_id").join(roots.withColumnRenamed("node", "set_key"), "set_key")
    least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = joined.join(least, "root").select("set_key", "component_id")
    named = classes.select("set_key", "doc_id").join(of_class, "set_key", "left").select("set_key", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = held.select("doc_id", "text_hash", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(documents: DataFrame, shingle: int, percent: int = PERCENT) -> DataFrame:
    """``documents`` without the rows that belong to a component of a smaller id, and without repeated rows.

    Every row is judged by its own text, also where rows repeat an id. Only rows that a bounded filter marks are shuffled
    with their texts.
    """
    rows = cut(judged(documents, shingle, percent).select("doc_id", "text_hash", "kept"))
    marked, n = cut_counted(rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("kept").alias("kept")).filter("n > 1 OR NOT kept").select("doc_id"))
    hits, rest = bloom.split(documents, "doc_id", marked, n)
    good = rows.filter("kept").join(marked, "doc_id", "left_semi").select("doc_id", F.col("text_hash").alias("__hash")).distinct()
    again = hits.withColumn("__hash", _text_hash()).join(good, ["doc_id", "__hash"], "left_semi").dropDuplicates(["doc_id", "__hash"])
    return rest.unionByName(again.select(*documents.columns)).select(*documents.columns)

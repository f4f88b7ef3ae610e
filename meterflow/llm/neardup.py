"""MinHash near-dedup by a multi-index Hamming join.

A document's signature is the lowest 16 bits of 32 MinHash values of its word shingles, in 8 chunks of 4 values; the
distance of two signatures is the number of values that differ. By the pigeonhole principle two signatures that differ in at
most 15 values have a chunk that differs in at most one. So each chunk is indexed 4 times, with one value masked each time: all pairs
within the distance share an index entry, without exception. Links are confirmed on the full shingle sets.

An entry may hold a third of all documents, so pairs inside an entry are never listed:

* equal sets are one node from the start;
* in crowded entries, shingles that no other document of a crowded entry has bound what a document can share; those that
  cannot reach the threshold with anyone leave the entry;
* each remaining member is compared with one centre, and linked documents become one component;
* only entries that still hold several components are looked at again, and only for pairs across components that pass the
  bounds of distance, size and shared shingles, which the join itself tests. In crowded entries it tests the similarity
  itself: members of one entry differ from its centre in few shingles each, and these differences give the exact
  intersection of any two members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.llm import words as W
from meterflow.llm.common import added_in_arrow, text_or_empty, unused, written
from meterflow.session import ship_package

SHINGLE = 5
#: Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 85
CHUNKS, VALUES = 8, 4
#: Largest distance that the index guarantees: one error per chunk is allowed for.
DISTANCE = 2 * CHUNKS - 1
#: Members from which an entry counts as crowded. Only the order of work depends on it.
CROWDED = 32
#: Shingles in which a member of a crowded entry may differ from the centre for its differences to be kept. Others are
#: confirmed on their texts.
DIFFERENCES = 256

_MULTIPLIERS = np.random.default_rng(77).integers(1, 2**63, CHUNKS * VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNATURE = [f"c{i}" for i in range(CHUNKS)]
SKETCH = [T.StructField("n_shingles", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("set1", "set2", *SIGNATURE)]]


def _sketches(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Set size, two digests of the set, and the signature chunks of every row; zeros for empty sets."""
    sets, firsts = W.shingle_sets(data, offsets, W.NOT_SPACE, shingle)
    sizes = np.diff(firsts)
    full = np.flatnonzero(sizes)
    out = np.zeros((3 + CHUNKS, len(sizes)), dtype=np.uint64)
    out[0] = sizes.astype(np.uint64)
    if len(full):
        at = firsts[:-1][full]
        out[1, full] = np.add.reduceat(W.mix(sets ^ np.uint64(0xA5A5)), at)
        out[2, full] = np.add.reduceat(W.mix(sets ^ np.uint64(0x5A5A5A)), at)
        for k, factor in enumerate(_MULTIPLIERS):
            lowest = W.mix(np.minimum.reduceat((sets ^ (sets >> np.uint64(32))) * factor, at))
            out[3 + k // VALUES, full] |= (lowest & np.uint64(0xFFFF)) << np.uint64(16 * (k % VALUES))
    return list(out.view(np.int64))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id``, ``check`` (hash of the text), ``n_shingles``, set digests and signature of every document, from its whole text."""

    def compute(column: pa.Array) -> list[pa.Array]:
        data, offsets = W.text_bytes(column)
        parts = [_sketches(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle) for i, j in W.groups_of(offsets)]
        return [pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64)) for k in range(len(SKETCH))]

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("check"), text.alias("text"))
    return added_in_arrow(rows, ["text"], SKETCH, compute, ["id", "check"])


def index_keys() -> Column:
    """The 32 index entries of a signature, by slot: every chunk with each of its values masked."""
    masks = [(0xFFFF << 16 * j) ^ (2**64 - 1) for j in range(VALUES)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    return F.array(*[F.xxhash64(F.lit(i * VALUES + j), F.col(f"c{i}").bitwiseAND(F.lit(m))) for i in range(CHUNKS) for j, m in enumerate(signed)])


def chunk_errors(left: str, right: str) -> list[Column]:
    """Values in which two signatures differ, per chunk: the lowest bit of each 16-bit field becomes whether any of its bits differs."""
    errors = []
    for c in SIGNATURE:
        x = F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))
        for step in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        errors.append(F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001))))
    return errors


def distance(left: str, right: str) -> Column:
    return sum(chunk_errors(left, right)[1:], chunk_errors(left, right)[0])


def first_shared_entry(left: str, right: str) -> Column:
    """Whether the entry at hand, ``slot``, is the first that two signatures share, so that a pair is looked at once.

    They share an entry of every chunk with one error at most: the one of the wrong value, or all four if there is none.
    """
    slot = F.col(f"{left}.slot")
    chunk = F.floor(slot / VALUES)
    alone = F.lit(True)
    for i, errors in enumerate(chunk_errors(left, right)):
        alone = alone & ((chunk <= i) | (errors > 1)) & ((chunk != i) | (slot % VALUES == 0) | (errors == 1))
    return alone


def can_link(left: str, right: str, similarity: int, crowded: Column) -> Column:
    """Whether signature distance, set sizes and, for a pair of a crowded entry, shareable shingles leave a link possible.

    ``shareable`` bounds only what two documents of crowded entries share: others may have the shingles that count as own.
    """
    bound = lambda side: F.when(crowded, F.col(f"{side}.shareable")).otherwise(F.col(f"{side}.n_shingles"))
    shared = F.least(bound(left), bound(right))
    union = F.col(f"{left}.n_shingles") + F.col(f"{right}.n_shingles") - shared
    return (distance(left, right) <= DISTANCE) & (shared * 100 >= union * similarity)


def confirm(pairs: DataFrame, texts: DataFrame, similarity: int, shingle: int) -> DataFrame:
    """The pairs ``a``, ``b``, with ``similar``: whether their full shingle sets are similar enough.

    Pairs marked ``crowded`` also get ``n_a``, the size of the set of ``a``, and the differences ``lost`` (only in ``a``) and
    ``gained`` (only in ``b``) if there are at most ``DIFFERENCES`` of each.
    """
    limit = DIFFERENCES

    def compare(batches):
        for batch in batches:
            sets = []
            for ids, text in ((batch.column(0), batch.column(1)), (batch.column(2), batch.column(3))):
                keys = np.array(ids)
                _, first, which = np.unique(keys, return_index=True, return_inverse=True)
                data, offsets = W.text_bytes(text.take(pa.array(first)))
                found: list[np.ndarray] = []
                for i, j in W.groups_of(offsets):
                    part, at = W.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], W.NOT_SPACE, shingle)
                    found += [part[at[k] : at[k + 1]] for k in range(j - i)]
                sets.append((found, which))
            (left, at_left), (right, at_right) = sets
            crowded = batch.column(4).to_pylist()
            good, sizes, lost, gained = [], [], [], []
            for row in range(batch.num_rows):
                x, y = left[at_left[row]], right[at_right[row]]
                both = np.intersect1d(x, y, assume_unique=True)
                shared = len(both)
                good.append(shared > 0 and 100 * shared >= similarity * (len(x) + len(y) - shared))
                sizes.append(len(x))
                near = crowded[row] and max(len(x), len(y)) - shared <= limit
                lost.append(np.setdiff1d(x, both, assume_unique=True).view(np.int64) if near else None)
                gained.append(np.setdiff1d(y, both, assume_unique=True).view(np.int64) if near else None)
            longs = pa.list_(pa.int64())
            made = [pa.array(good, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(lost, longs), pa.array(gained, longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], names=["a", "b", "similar", "n_a", "lost", "gained"])

    kind = pairs.schema["a"].dataType
    if "crowded" not in pairs.columns:
        pairs = pairs.withColumn("crowded", F.lit(False))
    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    ship_package(pairs.sparkSession)
    longs = T.ArrayType(T.LongType())
    made = [("similar", T.BooleanType()), ("n_a", T.LongType()), ("lost", longs), ("gained", longs)]
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), *[T.StructField(*m) for m in made]])
    return rows.select("a", "text_a", "b", "text_b", "crowded").mapInArrow(compare, schema)


def similar_by_differences(left: str, right: str, similarity: int) -> Column:
    """Whether two members of an entry are similar, from what each has lost and gained against the same centre; null if unknown."""
    gone = F.size(F.array_union(F.col(f"{left}.lost"), F.col(f"{right}.lost")))
    again = F.size(F.array_intersect(F.col(f"{left}.gained"), F.col(f"{right}.gained")))
    centre, total = F.col(f"{left}.n_centre"), F.col(f"{left}.n_shingles") + F.col(f"{right}.n_shingles")
    enough = lambda shared: shared * 100 >= (total - shared) * similarity
    most = centre - F.greatest(*[F.size(f"{side}.lost") for side in (left, right)]) + F.least(*[F.size(f"{side}.gained") for side in (left, right)])
    known = F.col(f"{left}.lost").isNotNull() & F.col(f"{right}.lost").isNotNull()
    return F.when(known & ~enough(most), False).when(known, enough(centre - gone + again))


def own_shingles(texts: DataFrame, shingle: int) -> DataFrame:
    """``id`` and ``own``: how many shingles of a document none of the other given documents has; batches are summed up first."""

    def count(batches):
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            hashes, rows = [], []
            for i, j in W.groups_of(offsets):
                sets, at = W.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], W.NOT_SPACE, shingle)
                hashes.append(sets)
                rows.append(np.repeat(np.arange(i, j), np.diff(at)))
            if hashes:
                values, first, times = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
                ids = batch.column(0).take(pa.array(np.concatenate(rows)[first]))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), ids, pa.array(times)], names=["hash", "id", "times"])

    ship_package(texts.sparkSession)
    schema = T.StructType([T.StructField("hash", T.LongType()), texts.schema["id"], T.StructField("times", T.LongType())])
    seen = texts.select("id", "text").mapInArrow(count, schema).groupBy("hash").agg(F.sum("times").alias("times"), F.min("id").alias("id"))
    return seen.where(F.col("times") == 1).groupBy("id").agg(F.count("*").alias("own"))


def components(links: DataFrame) -> DataFrame:
    """``id``, ``component`` (smallest identifier reachable) of all linked identifiers but the smallest themselves.

    Alternating large-star and small-star steps: edges move to ever smaller neighbours until each component is one star. Each step is written:
    a plan that holds a step several times would double with every step inside it, and the driver plans it anew every round.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    last = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last or not state[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        last = state
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = turned.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-stars")
        moved = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = moved.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where(F.col("u") != F.col("v"))
        edges = written(small.distinct(), "edges")


def link_documents(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, similarity: int, shingle: int) -> DataFrame:
    """``id``, ``component`` of all linked nodes but the smallest of each component.

    A node is a shingle set: ``id`` its number, ``of`` and ``check`` name the document, and of this the text, that has it.
    """
    keyed = nodes.select("id", F.posexplode(index_keys()).alias("slot", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    entries = written(keyed.join(shared, "key").select("key", "slot", "id", (F.col("members") > CROWDED).alias("crowded")), "entries")

    wanted = entries.groupBy("id").agg(F.max("crowded").alias("crowded"))
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("of"), F.xxhash64(text).alias("check"), text.alias("text"))
    places = wanted.join(nodes.select("id", "of", "check"), "id")
    # the list grows with the corpus: a sort-merge join whatever its size
    texts = written(rows.join(places.hint("merge"), ["of", "check"]).select("id", "text", "crowded"), "texts")

    # a text that stands there several times has fewer shingles of its own: a looser bound, but a bound
    own = own_shingles(texts.where("crowded"), shingle)
    bounded = nodes.drop("of", "check").join(own, "id", "left").withColumn("shareable", F.col("n_shingles") - F.coalesce("own", F.lit(0).cast("long"))).drop("own")
    bounded = written(bounded.join(wanted.select("id"), "id"), "bounded")

    hopeful = F.col("shareable") * 100 >= F.col("n_shingles") * similarity
    sizes = bounded.select("id", "n_shingles", "shareable")
    entries = entries.join(sizes, "id").where(~F.col("crowded") | hopeful)
    entries = entries.select("key", "slot", "id", "crowded", (F.col("n_shingles") - F.col("shareable")).alias("own"))
    entries = written(entries, "hopeful")
    centres = entries.groupBy("key").agg(F.min(F.struct("own", "id"))["id"].alias("centre"), F.count("*").alias("members")).where(F.col("members") > 1)
    entries = written(entries.join(centres.select("key", "centre"), "key"), "centred")
    star = entries.where(F.col("id") != F.col("centre")).groupBy(F.col("centre").alias("a"), F.col("id").alias("b")).agg(F.max("crowded").alias("crowded"))
    star = star.alias("p").join(bounded.alias("x"), F.col("p.a") == F.col("x.id")).join(bounded.alias("y"), F.col("p.b") == F.col("y.id"))
    star = star.where(can_link("x", "y", similarity, F.col("p.crowded"))).select("p.a", "p.b", "p.crowded")
    compared = written(confirm(star, texts, similarity, shingle), "compared")
    found = components(compared.where("similar"))

    # entries that still hold several components
    placed = entries.join(found, "id", "left").select("key", "slot", "id", "centre", "crowded", F.coalesce("component", "id").alias("component"))
    placed = written(placed, "placed")
    open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") != F.col("high"))
    left = placed.join(open_.select("key"), "key").join(bounded, "id")
    apart = compared.where(F.col("lost").isNotNull()).select(F.col("a").alias("_centre"), F.col("b").alias("_id"), F.col("n_a").alias("n_centre"), "lost", "gained")
    known = left.join(apart, F.col("crowded") & (F.col("centre") == F.col("_centre")) & (F.col("id") == F.col("_id")), "left")
    itself = F.col("crowded") & (F.col("id") == F.col("centre"))
    none = F.array().cast("array<bigint>")
    left = known.withColumns(
        {
            "n_centre": F.when(itself, F.col("n_shingles")).otherwise(F.col("n_centre")),
            "lost": F.when(itself, none).otherwise(F.col("lost")),
            "gained": F.when(itself, none).otherwise(F.col("gained")),
        }
    ).drop("_centre", "_id", "centre")
    left = written(left, "open")
    across = left.alias("x").join(
        left.alias("y"),
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.id") < F.col("y.id"))
        & (F.col("x.component") != F.col("y.component"))
        & first_shared_entry("x", "y")
        & can_link("x", "y", similarity, F.col("x.crowded"))
        & F.coalesce(similar_by_differences("x", "y", similarity), F.lit(True)),
    )
    across = across.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    done = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = written(confirm(across.join(done, ["a", "b"], "left_anti"), texts, similarity, shingle), "compared").where("similar")
    if more.isEmpty():
        return found
    return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")))


def links_of_one_document(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b``: the sets that texts of one identifier have, each linked with the first of them."""
    ends = [f(c).alias(f"{name}_{c}") for c in ("set1", "set2") for name, f in (("low", F.min), ("high", F.max))]
    several = rows.groupBy("id").agg(*ends).where((F.col("low_set1") != F.col("high_set1")) | (F.col("low_set2") != F.col("high_set2"))).select("id")
    held = rows.select("id", "set1", "set2").join(several, "id").distinct().withColumnRenamed("id", "doc").join(sets.select("set1", "set2", "id"), ["set1", "set2"])
    held = written(held.select("doc", "id"), "several-texts")
    first = held.groupBy("doc").agg(F.min("id").alias("b"))
    return held.join(first, "doc").where(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents whose sets of ``shingle``-word shingles have a Jaccard similarity of at least ``similarity`` per cent are
    linked; ``component_id`` is the smallest identifier reachable. Null and empty texts, and texts without words, have no shingles and are
    linked with nothing; a text with fewer words is its own single shingle. Rows that share an identifier are one document: links of
    one of its texts are links of all its texts with words. A row without identifier stays alone: its ``component_id`` is null. An empty table gives an empty result.
    Of pairs at the threshold itself the signatures let one in fifty million pass by; all pairs within ``DISTANCE`` are found.
    """
    rows = written(sketches(docs, id_col, text_col, shingle), "sketches")
    first = [F.first(c).alias(c) for c in ("n_shingles", *SIGNATURE)]
    real = rows.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    sets = real.groupBy("set1", "set2").agg(F.min("id").alias("of"), F.min_by("check", "id").alias("check"), *first)
    sets = written(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    linked = link_documents(docs, sets.drop("set1", "set2"), id_col, text_col, similarity, shingle)
    own = links_of_one_document(real, sets)
    if not own.isEmpty():
        linked = components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).union(own))
    linked = written(linked, "linked")
    members = linked.union(linked.select("component", "component").distinct()).toDF("id", "component")
    smallest = members.join(sets.select("id", "of"), "id").groupBy("component").agg(F.min("of").alias("smallest"))
    named = sets.select("set1", "set2", "id", "of").join(members.join(smallest, "component"), "id", "left").select("set1", "set2", F.coalesce("smallest", "of").alias("component"))
    known = rows.where(F.col("id").isNotNull()).join(named, ["set1", "set2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    out = known.select("id", "n_shingles", own.alias("component_id"))
    nameless = rows.where(F.col("id").isNull()).select("id", "n_shingles", F.col("id").alias("component_id"))
    return out.union(nameless).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The documents without those that are linked, directly or over others, with one of a smaller identifier."""
    (name,) = unused(docs.columns, "near_copy")
    gone = near_duplicates(docs, id_col, text_col, similarity, shingle).where(~F.col("kept")).select(F.col("id").alias(name)).distinct()
    return docs.join(written(gone, "near-copies").hint("merge"), F.col(id_col) == F.col(name), "left_anti")

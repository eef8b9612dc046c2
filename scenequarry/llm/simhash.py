"""SimHash fingerprints and their components under a small Hamming distance.

Segment-popcount embedding: a 64-bit fingerprint becomes the bit counts of its
16 four-bit segments. Flipping a bit moves one count by one, so the Manhattan
distance of two such vectors never exceeds the Hamming distance of the
fingerprints. The range join on that grid works by meeting points: vectors
within distance 2 either are equal, or neighbours, or share a neighbour. Each
distinct fingerprint is therefore sent to its own cell and to the cells beside
it, and fingerprints that meet are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut_lineage, held, remove, slices, written

SHINGLE, SEED, MAX_BITS = 3, 42, 2
SEGMENTS, SEGMENT_BITS = 16, 4
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of a whole text; 0 for one without words.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space,
    and each shingle counts as often as it occurs.
    """
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    stops = ends[shingle - 1 :] or ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts, stops)], dtype="<u8")
    columns = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BITS for i in range(8)])
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (signed 64 bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash", dict)  # keeps nothing, but lets go of what another operator kept
        for batch in slices(batches):
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """The bit counts (0 to 4) of the segments, each in four bits of one long."""
    counts = [F.shiftleft(F.bit_count(_segment(fp, i, 15)).cast("long"), SEGMENT_BITS * i) for i in range(SEGMENTS)]
    return reduce(Column.bitwiseOR, counts)


def _segment(value: Column, i: int, mask: int) -> Column:
    return F.shiftrightunsigned(value, SEGMENT_BITS * i).bitwiseAND(F.lit(mask))


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints that differ in 1 to ``max_bits`` (at most 2) bits.

    Each pair comes out of one cell alone: the home of both if they share it,
    the home of a if the homes are neighbours, else the lesser of the one or
    two cells between the homes (whose sum is that of the homes).
    """
    if not 1 <= max_bits <= 2:
        raise ValueError("meeting points hold for a distance of 1 or 2")
    home = distinct.select("fp", segment_counts(F.col("fp")).alias("home"))
    unit = [F.lit(1 << (SEGMENT_BITS * i)) for i in range(SEGMENTS)]
    count = [_segment(F.col("home"), i, 7) for i in range(SEGMENTS)]
    beside = [F.when(c < SEGMENT_BITS, F.col("home") + u) for c, u in zip(count, unit)]
    beside += [F.when(c > 0, F.col("home") - u) for c, u in zip(count, unit)]
    met = home.select("fp", "home", F.explode(F.array_compact(F.array(F.col("home"), *beside))).alias("cell"))
    crowd = Window.partitionBy("cell")
    met = met.withColumn("n", F.count(F.lit(1)).over(crowd)).where("n > 1").drop("n")
    met = cut_lineage(met)
    a, b = (met.select("cell", F.col("fp").alias(x), F.col("home").alias(f"home_{x}")) for x in "ab")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    at_a, at_b = F.col("cell") == F.col("home_a"), F.col("cell") == F.col("home_b")
    between = ~at_b & (F.col("home_a") != F.col("home_b")) & (F.col("cell") - F.col("home_a") <= F.col("home_b") - F.col("cell"))
    return a.join(b, "cell").where((F.col("a") < F.col("b")) & (at_a | between) & near).select("a", "b")


#: Links of a node from which on its label is dealt to several tasks; nodes of so many links that are broadcast.
HUB, HUBS_SENT = 256, 500_000


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge: ``root`` is the component's least ``rank``.

    ``nodes`` has node and rank (its starting label, unlike any other's). Each
    round takes the least label among neighbours and then jumps through the
    label's own label, so rounds grow with the logarithm of a component's
    diameter. Everything stays distributed; each round is a table in the shared
    folder. A node with many links is salted: its links are dealt by their
    other end, and its label is sent to each of their tasks.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    both, place_both = written(both)
    linked, place_linked = written(both.groupBy("node").agg(F.count(F.lit(1)).alias("degree")))  # summed before it is dealt
    hubs = linked.where(F.col("degree") > HUB).select("node", F.ceil(F.col("degree") / HUB).cast("int").alias("salts"))
    if 0 < hubs.count() <= HUBS_SENT:  # one row in HUB links at most; checked, and joined by shuffle beyond
        hubs = F.broadcast(hubs)
    salts = F.coalesce("salts", F.lit(1))
    dealt = both.join(hubs.withColumnRenamed("node", "other"), "other", "left")
    dealt, place_dealt = written(dealt.select("node", "other", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt")))
    remove(both.sparkSession, place_both)
    label, first = written(nodes.join(linked, "node").select("node", F.col("rank").alias("root")))
    last = None
    owner = label.select(F.col("root").alias("at"), F.col("node").alias("owner"))
    while True:
        told = label.join(hubs, "node", "left").select(F.col("node").alias("other"), "root", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        heard = dealt.join(told, ["other", "salt"]).groupBy("node").agg(F.min("root").alias("heard"))
        least = label.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "heard").alias("root"))
        # A label's owner is asked for its own label: once for each label, not once for each node that holds it.
        jump = owner.join(least.select(F.col("node").alias("owner"), F.col("root").alias("onward")), "owner").select("at", "onward").where("onward < at")
        new, place = written(least.join(jump, F.col("root") == F.col("at"), "left").select("node", "was", F.least("root", F.coalesce("onward", "root")).alias("root")))
        if last:
            remove(new.sparkSession, last)
        label, last = new.select("node", "root"), place
        if new.where("root < was").isEmpty():
            for place in (place_linked, place_dealt, first):
                remove(new.sparkSession, place)
            return label


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Fingerprints link at ``max_bits`` or fewer differing bits, equal ones
    included; component_id is the least doc_id that can be reached. Null,
    empty and wordless texts share fingerprint zero and link like any other.
    Whole texts count, however long. Rows that repeat a doc_id repeat, each
    with its own text's component. A row with a null doc_id links too; where
    a component has no other rows, its component_id is null. An empty table
    gives no rows, other columns are ignored.
    """
    marked = cut_lineage(fingerprints(docs))
    rank = F.struct(F.isnull(F.min("doc_id")).alias("last"), F.coalesce(F.min("doc_id"), F.lit(0)).alias("doc_id"), F.col("fp").alias("fp"))
    classes = cut_lineage(marked.groupBy("fp").agg(rank.alias("rank")))
    found = components(links(classes.select("fp"), max_bits), classes.withColumnRenamed("fp", "node"))
    root = F.coalesce("root", "rank")
    rooted = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.when(~root["last"], root["doc_id"]).alias("component_id"))
    return marked.join(cut_lineage(rooted), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

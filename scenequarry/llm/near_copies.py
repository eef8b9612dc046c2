"""Near copies by the Jaccard similarity of five-word shingles, found exactly.

SimHash links come first: sets whose fingerprints differ in at most two bits,
confirmed on whole sets. Few pairs of a similarity of 0.8 lie that close, so
prefix filtering finds the rest, between sets that are not yet connected.

Prefix filtering: under one order of all shingles, two sets with a similarity
of at least 4/5 share a shingle among the first n - ceil(4n/5) + 1 of each.
Sets that meet in such a shingle are candidates if what follows it in both is
enough (their first shared shingle leaves no more to share), and candidates are
verified on whole sets (of 64-bit hashes), so no pair is missed. The order puts shingles
that a sample of documents shows to be common last, and then those that the prefixes of
all sets show to be crowded, where these were taken for rarer: it decides on the cost
only, never on the result.

A shingle with more than ``CROWD`` sets would make pairs with the square of
its crowd. There all sets are held against ``PIVOTS`` of them, first those of least hash
and then those that linked most often, and the links are closed to components. Only sets outside the crowd's main component
are then held against all sets of other components: within a component
nothing is left to find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .shared import held, remove, slices, written

SHINGLE, SEED, CROWD, PIVOTS = 5, 42, 16, 8
#: Documents that are looked at for common shingles, and how many of these are told apart.
SAMPLE, COMMON = 20_000, 200_000
#: Times that crowded shingles are put further back in the order, and how many at a time.
MOVES, MOVED = 2, 500_000
_NONE = (np.empty(0, "<i8"), np.empty(0, "<i8"))


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; words as in ``simhash``, a shorter text is one shingle."""
    words = (text or "").encode().translate(simhash._LOWER).split()
    if not words:
        return np.empty(0, "<i8")
    h = xxhash.xxh64_intdigest
    hashes = {h(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(max(len(words) - SHINGLE + 1, 1))}
    return np.sort(np.fromiter(hashes, "<u8", len(hashes)).view("<i8"))


def _prefix(hashes: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set; ``common`` is sorted and ``times`` says in how many sets each is thought to be."""
    n = len(hashes)
    seen = np.zeros(n, "<i8")
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        seen = np.where(common[at] == hashes, times[at], 0)
    return hashes[np.lexsort((hashes, seen))[: n - (4 * n + 4) // 5 + 1]] if n else hashes


def _arrays(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([_NONE[0], *found])))


def _sets(docs: DataFrame, key: str) -> DataFrame:
    """``key`` and the shingles of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near_copies", dict)
        for batch in slices(batches):
            found = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _arrays(found)], names=[key, "shingles"])

    return docs.select(key, "text").mapInArrow(run, f"{key} long, shingles array<long>")


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sampled documents have, sorted, and in about how many of all documents they are."""
    step = max(1, docs.count() // SAMPLE)
    sample = docs.withColumn("_row", F.xxhash64(F.lit(SEED), "text")).where(F.pmod("_row", F.lit(step)) == 0).dropDuplicates(["_row"])
    seen = _sets(sample, "_row").select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    common, times = _most(seen, COMMON)
    return common, times * step


def _most(seen: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` shingles of largest n, sorted by their hash, and their n."""
    top = seen.orderBy(F.desc("n"), "shingle").limit(most).toArrow()
    if not top.num_rows:
        return _NONE
    common, times = (top.column(c).to_numpy() for c in ("shingle", "n"))
    order = np.argsort(common)
    return common[order], times[order]


def _marked(docs: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Of every row: _row, doc_id, its set's key (node), size (n) and prefix, and its fingerprint (fp)."""
    known = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near_copies", dict)
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            found = [shingles(t) for t in texts]
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], "<u8").view("<i8")
            sizes = pa.array([len(s) for s in found], pa.int64())
            prefix = _arrays([_prefix(s, *known.value) for s in found])
            fps = pa.array([simhash.fingerprint(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), sizes, prefix, fps], names=["_row", "doc_id", "node", "n", "prefix", "fp"])

    return docs.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "_row long, doc_id long, node long, n long, prefix array<long>, fp long")


def _moved(order: tuple[np.ndarray, np.ndarray], crowds: tuple[np.ndarray, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The order in which no crowded shingle counts less than it was met, and the shingles that this puts further back."""
    both, at = np.unique(np.concatenate([order[0], crowds[0]]), return_inverse=True)
    times, was = np.zeros(len(both), "<i8"), np.zeros(len(both), "<i8")
    was[at[: len(order[0])]] = order[1]
    np.maximum.at(times, at, np.concatenate([order[1], crowds[1]]))
    return (both, times), both[times > was]


def _rows_with(classes: DataFrame, shingles: np.ndarray) -> DataFrame:
    """node and _row of the sets that have any of ``shingles`` (sorted, not empty) in their prefix."""
    sent = classes.sparkSession.sparkContext.broadcast(shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near_copies", dict)
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy()
            at = np.minimum(np.searchsorted(sent.value, flat), len(sent.value) - 1)
            rows = np.unique(pc.list_parent_indices(batch.column(2)).to_numpy()[sent.value[at] == flat])
            yield batch.select([0, 1]).take(pa.array(rows, pa.int64()))

    return classes.select("node", "rank._row", "prefix").mapInArrow(run, "node long, _row long")


def _reordered(classes: DataFrame, docs: DataFrame, order: tuple[np.ndarray, np.ndarray], tables: _Tables) -> DataFrame:
    """``classes`` with the prefixes of an order that knows crowded shingles, which the sample alone takes for rarer.

    Sets that share a passage only would meet in its shingles. Shingles are only ever put further back,
    so a prefix without any of them is the same in both orders, and only the others are made again.
    """
    for _ in range(MOVES):
        crowds = classes.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
        order, back = _moved(order, _most(crowds, MOVED))
        if not len(back):
            break
        known = classes.sparkSession.sparkContext.broadcast(order)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held("near_copies", dict)
            for batch in slices(batches):
                found = [_prefix(shingles(t), *known.value) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), _arrays(found)], names=["node", "again"])

        texts = docs.select("_row", "text").join(_rows_with(classes, back), "_row").dropDuplicates(["node"])
        again = texts.select("node", "text").mapInArrow(run, "node long, again array<long>")
        made = classes.join(again, "node", "left").select("node", "rank", "n", F.coalesce("again", "prefix").alias("prefix"), "fp")
        classes, was = tables.keep(made), classes
        tables.drop(was)
    return classes


class _Tables:
    """Tables of one run in the shared folder, deleted once no later step reads them."""

    def __init__(self) -> None:
        self.places: dict[DataFrame, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        out, place = written(df)
        self.places[out] = place
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if place := self.places.pop(df, None):
                remove(df.sparkSession, place)


def _fit(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column) -> Column:
    """Whether sets of these sizes can be alike if the first shingle they share is at these places in the order."""
    return 9 * F.least(n_a - pos_a, n_b - pos_b) >= 4 * (n_a + n_b)


def _side(met: DataFrame, name: str, *more: str) -> DataFrame:
    return met.select("shingle", F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "pos", *more)))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, tables: _Tables) -> DataFrame:
    """The pairs (a, b) whose whole sets have a similarity of at least 4/5; ``pairs`` is a table."""
    if pairs.isEmpty():
        return pairs.sparkSession.createDataFrame([], "a long, b long")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    needed = classes.join(ends, "node").select("node", F.col("rank._row").alias("_row"))
    texts = docs.select("_row", "text").join(needed, "_row").dropDuplicates(["node"])
    sets = tables.keep(_sets(texts, "node"))
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    same = 9 * shared >= 4 * (F.size("s_a") + F.size("s_b"))
    found = tables.keep(pairs.join(a, "a").join(b, "b").where(same).select("a", "b"))
    tables.drop(sets)
    return found


def _by_fingerprint(classes: DataFrame, tables: _Tables) -> DataFrame:
    """Pairs (a < b) by SimHash, one or two for each set that has any.

    A set goes with the first of its own fingerprint, and that one with the
    first set of the least fingerprint within ``simhash.MAX_BITS`` bits.
    """
    heads = tables.keep(classes.groupBy("fp").agg(F.min("node").alias("head")))
    own = classes.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    hooks = simhash.links(heads.select("fp")).groupBy("b").agg(F.min("a").alias("a"))
    ends = [heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}")) for x in "ab"]
    near = hooks.join(ends[0], "a").join(ends[1], "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    pairs = tables.keep(_ordered(own.unionByName(near)))
    tables.drop(heads)
    return pairs


def links(classes: DataFrame, docs: DataFrame, tables: _Tables) -> DataFrame:
    """Pairs (a < b) of sets that connect all that are alike: links, and stars of components of links."""
    # SimHash comes first: what it links (and the exact check confirms) need not be compared again.
    tried = _by_fingerprint(classes, tables)
    found = _verified(tried, classes, docs, tables)
    parts = _parts(found, tables)
    tables.drop(tried, found)
    place = F.shiftleft("n", 32) + F.col("pos")  # in one column, as these rows are the bulk of what is dealt
    tokens = classes.select("node", "n", F.posexplode("prefix").alias("pos", "shingle")).select("shingle", "node", place.alias("place"))
    crowds = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = tokens.join(crowds, "shingle")
    met = tables.keep(met.select("shingle", "node", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), "m"))
    full = met.where(F.col("m") > CROWD)
    # Pairs of sets share at most so many shingles: those met below, crowded ones, and what follows the prefixes.
    crowded = full.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    few = met.where(F.col("m") <= CROWD)
    fit = _fit(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"))
    pairs = _side(few, "a").join(_side(few, "b"), "shingle").where((F.col("a") < F.col("b")) & (9 * F.least("n_a", "n_b") >= 4 * (F.col("n_a") + F.col("n_b"))))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.bool_or(fit).alias("fit")).where("fit")
    for x in "ab":
        pairs = pairs.join(crowded.select(F.col("node").alias(x), F.col("k").alias(f"k_{x}")), x, "left")
        pairs = pairs.join(parts.select(F.col("node").alias(x), F.col("root").alias(f"part_{x}")), x, "left")
    most = F.col("c") + F.least(F.coalesce("k_a", F.lit(0)), F.coalesce("k_b", F.lit(0))) + F.floor((4 * F.greatest("n_a", "n_b") + 4) / 5) - 1
    apart = F.coalesce("part_a", "a") != F.coalesce("part_b", "b")
    pairs = tables.keep(pairs.where(apart & (9 * most >= 4 * (F.col("n_a") + F.col("n_b")))).select("a", "b"))
    if full.isEmpty():
        tables.drop(met)
        return tables.keep(_star(parts).unionByName(_verified(pairs, classes, docs, tables)))
    full = tables.keep(_with_parts(full.drop("m"), parts))
    tables.drop(met)
    # The first pivots: some in each crowd, by one order for all, so that a set meets few however many shingles it shares.
    early = (9 * F.col("pos") > F.col("n")).alias("late")
    turn = F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("turn")
    by_hash = F.min(F.struct(early, F.xxhash64("node"), "node", "n", "pos", "part"))
    first = full.groupBy("shingle", turn).agg(by_hash.alias("pivot"))
    tried = tables.keep(pairs.unionByName(_to_pivots(full, first)).distinct())
    tables.drop(pairs)
    found = _verified(tried, classes, docs, tables)
    # Then the sets whose tries linked most often: where all are copies of one, that one links to more pivots than others do.
    ends = lambda pairs, linked: pairs.select(F.explode(F.array("a", "b")).alias("node"), F.lit(linked).alias("linked"))
    tries = ends(tried, 0).unionByName(ends(found, 1)).groupBy("node").agg((F.sum("linked") / (F.count_if(F.col("linked") == 0) + 2)).alias("links"))
    parts, was = _parts(_star(parts).unionByName(found), tables), parts
    full, old = tables.keep(_with_parts(full.drop("part"), parts).join(tries, "node", "left").na.fill(0.0, ["links"])), full
    tables.drop(found, was, old)
    by_links = F.max(F.struct("links", "node", "n", "pos", "part"))
    pivots = tables.keep(full.groupBy("shingle", turn).agg(by_links.alias("pivot")))
    again = tables.keep(_to_pivots(full, pivots).join(tried, ["a", "b"], "left_anti"))
    found = _verified(again, classes, docs, tables)
    # What is left lies across components: those outside the pivot's against all of the crowd.
    parts, was = _parts(_star(parts).unionByName(found), tables), parts
    full, old = tables.keep(_with_parts(full.drop("links", "part"), parts)), full
    tables.drop(found, was, old)
    main = pivots.groupBy("shingle").agg(F.max("pivot").alias("pivot")).select("shingle", F.col("pivot.node").alias("node")).join(full, ["shingle", "node"]).select("shingle", F.col("part").alias("main"))
    spread = full.join(main, "shingle").withColumn("outside", F.col("part") != F.col("main"))
    rest = spread.where("outside")
    # Two sets that are both outside meet from either side.
    across = (F.col("part_a") != F.col("part_b")) & (~F.col("outside_b") | (F.col("a") < F.col("b"))) & fit
    last = _ordered(_side(rest, "a", "part").join(_side(spread, "b", "part", "outside"), "shingle").where(across).select("a", "b"))
    last = tables.keep(last.join(tried, ["a", "b"], "left_anti").join(again, ["a", "b"], "left_anti"))
    tables.drop(full, pivots, tried, again)
    return tables.keep(_star(parts).unionByName(_verified(last, classes, docs, tables)))


def _to_pivots(full: DataFrame, pivots: DataFrame) -> DataFrame:
    """Pairs (a < b) of each set of a crowd with those of the crowd's pivots that lie in other components, where sizes fit.

    A crowd's pivots come as one list, so a set meets it once for each shingle, and lists are joined before pairs are made.
    """
    lists = pivots.groupBy("shingle").agg(F.collect_list("pivot").alias("pivots"))
    near = lambda p: (F.col("part") != p["part"]) & _fit(F.col("n"), F.col("pos"), p["n"], p["pos"])
    met = full.join(lists, "shingle").select("node", F.transform(F.filter("pivots", near), lambda p: p["node"]).alias("near")).where(F.size("near") > 0)
    met = met.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    return _ordered(met.select(F.col("node").alias("a"), F.explode("near").alias("b")))


def _parts(found: DataFrame, tables: _Tables) -> DataFrame:
    """(node, root) of all sets with a link: the component's least set."""
    nodes = found.select(F.col("a").alias("node")).union(found.select("b")).distinct().withColumn("rank", F.col("node"))
    return tables.keep(simhash.components(found, nodes))


def _star(parts: DataFrame) -> DataFrame:
    """One pair for each set but the least of a component: they connect what all links found connect."""
    return parts.where("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b"))


def _with_parts(full: DataFrame, parts: DataFrame) -> DataFrame:
    """``full`` with the component (``part``) of each set."""
    return full.join(parts, "node", "left").select(*full.columns, F.coalesce("root", "node").alias("part"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies: that of least doc_id (null ones last), then of least seeded row hash.

    Rows remove one another as members of one component only, so rows that
    share a doc_id but differ in text both stay. Texts without words are alike.
    """
    columns = docs.columns
    docs = docs.withColumn("_row", F.xxhash64(F.lit(SEED), *(c for name in columns for c in (F.isnull(name), F.col(name)))))
    rank = F.struct(F.isnull("doc_id").alias("last"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "_row")
    order = common_shingles(docs)
    marked = _marked(docs, order).withColumn("rank", rank)
    tables = _Tables()
    classes = tables.keep(marked.groupBy("node").agg(F.min("rank").alias("rank"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("fp").alias("fp")))
    classes = _reordered(classes, docs, order, tables)
    nodes, edges = classes.select("node", "rank"), links(classes, docs, tables)
    if not edges.isEmpty():
        found = simhash.components(edges, nodes)
        nodes = nodes.join(found, "node", "left").where("root is null or root = rank")
    leaders, _ = written(nodes.select("rank._row"))
    tables.drop(*tables.places)
    return docs.join(leaders, "_row", "left_semi").dropDuplicates(["_row"]).select(*columns)

"""N-gram Jaccard join by a count-vector R-tree.

A document's set is its distinct ``n``-word shingles (64-bit hashes).  Documents with the same set
form a class; one row stands for all.  The shingles are hashed into ``GROUPS`` groups and a class is
the point of its group counts: two sets share at most the sum of coordinate minima.

Points are dealt into cells by the shingles of each set's prefix: as many as any partner with enough
overlap must meet, in one global order, so that a link is never lost.  The order puts shingles of
rarely hit counters first; the counters are a table of fixed size over all texts, so that passages
which many documents share seldom make cells.  Within a cell a packed R-tree holds the points by size
and coordinates; a node keeps its largest coordinates and smallest size, and a pair of nodes is left
out when even these cannot reach the similarity.  Cells beyond ``CELL`` points are dealt into pairs
of parts, each a task of its own.

Pairs are found in three passes, each over the components of the links verified so far.  First each
point goes to a few of its cells, where it proposes the first leader that its count vector can reach.
Then it proposes, in a few cells again, the best partner of another component that the tree leaves.  Last,
every pair of a cell that lies across components and survives the tree is verified, first by finer count
vectors and then by the whole sets.  Pairs inside a component need no check, so large groups of copies
stay linear; the first two passes only save work of the third.

Cases: a null text or one without words has the empty set, links with nothing and is its own
component; fewer than ``n`` words make one shingle.  Every row is a document: rows that repeat a
doc_id are judged by their own texts, and a component's id is its smallest doc_id (null if all are
null).  doc_id may have any type with an order.  An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.base import materialise
from tidemark.llm.components import components
from tidemark.llm.counters import counter_of, frequent, hit_table
from tidemark.llm.shingling import chunks, shingle_hashes, shingle_sets

N, PERCENT, GROUPS = 4, 85, 256
#: Coordinates of the tree's nodes and of a pair's first test: sums of GROUPS / NODE groups.
NODE = 32
#: Points of a cell before it is dealt into parts; points of a leaf; cells up to SMALL are joined without a tree.
CELL, LEAF, SMALL = 1 << 13, 64, 24
#: Cells of a point in the first two passes, and leaders of a cell in the first.
PICKS, LEADERS = (3, 6), 16
#: Ids that are sent to every executor (some 40 bytes each there) before the texts are shuffled instead.
BROADCAST_IDS = 500_000


def vector(hashes: np.ndarray) -> bytes:
    counts = np.bincount((hashes % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    return (counts.astype(np.uint8) if counts.max(initial=0) < 255 else np.minimum(counts, 65535).astype(np.uint16)).tobytes()


def set_keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two 64-bit sums over each set's hashes, which tell sets apart."""
    one = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
    two = [int(((s ^ (s >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
    return [pa.array(one, pa.int64()), pa.array(two, pa.int64())]


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n, key1, key2, vec, prefix) of every document; the lowest bit of a prefix shingle tells frequent ones."""
    hits = hit_table(docs, lambda texts: shingle_hashes(texts, n)[0])
    level = np.frexp(hits.astype(float))[1].astype(np.uint8)
    often = frequent(hits)
    sent = docs.sparkSession.sparkContext.broadcast((level, often))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, often = sent.value
        for batch, texts in chunks(batches):
            sets = shingle_sets(texts, n)
            prefix = []
            for s in sets:
                counter = counter_of(s)
                first = np.argsort(level[counter], kind="stable")[: len(s) - -(-percent * len(s) // 100) + 1]
                prefix.append((s[first] & ~np.uint64(1) | often[counter[first]]).view(np.int64))
            ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *set_keys(sets), pa.array([vector(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(ends, np.concatenate(prefix))],
                ["doc_id", "n", "key1", "key2", "vec", "prefix"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, n bigint, key1 bigint, key2 bigint, vec binary, prefix array<bigint>")


class Points:
    """Rows of some cells: owner, set size, component and count vector."""

    def __init__(self, table: pa.Table, percent: int):
        self.percent = percent
        self.ids, self.n, self.parts, self.comps = (table[c].to_numpy() for c in ("rep", "n", "side", "comp"))
        token, unit = table["token"].to_numpy(), table["unit"].to_numpy()
        #: The number of each row's cell, ascending.
        self.cell = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]) | (unit[1:] != unit[:-1])]))
        vectors = table["vec"].to_pylist()
        wide = any(len(v) != GROUPS for v in vectors)
        if wide:
            self.vec = np.stack([np.frombuffer(v, np.uint8 if len(v) == GROUPS else np.uint16).astype(np.uint16) for v in vectors])
        else:
            self.vec = np.frombuffer(b"".join(vectors), np.uint8).reshape(-1, GROUPS)
        self.low = self.vec.reshape(len(self.vec), -1, NODE).sum(axis=1, dtype=np.int64)
        self.full = (self.vec == 65535).any(axis=1) if wide else np.zeros(len(self.vec), bool)

    def survive(self, a: np.ndarray, b: np.ndarray, across: bool = False) -> np.ndarray:
        """Which of the pairs (a, b) sizes, components and count vectors leave; a full coordinate counts as unbounded."""
        good = (100 * np.minimum(self.n[a], self.n[b]) >= self.percent * np.maximum(self.n[a], self.n[b])) & (self.ids[a] != self.ids[b])
        if across:
            good &= self.comps[a] != self.comps[b]
        for table, size in ((self.low, 1 << 16), (self.vec, 1 << 14)):
            at = np.flatnonzero(good)
            for i in range(0, len(at), size):
                x, y = a[at[i : i + size]], b[at[i : i + size]]
                bound = np.minimum(table[x], table[y]).sum(axis=1, dtype=np.int64)
                good[at[i : i + size]] = (bound * (100 + self.percent) >= self.percent * (self.n[x] + self.n[y])) | self.full[x] & self.full[y]
        return good


def leader_pairs(p: Points) -> tuple[np.ndarray, np.ndarray]:
    """(leader, row): in each cell the first row leads, those that cannot reach it have the next leader; linear in the rows."""
    left, found = np.arange(len(p.cell)), []
    for _ in range(LEADERS):
        if not len(left):
            break
        cell = p.cell[left]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        lead = np.repeat(left[first], np.diff(np.append(first, len(left))))
        good = p.survive(lead, left)
        found.append((lead[good], left[good]))
        left = left[~good & (lead != left)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (left, left)


def tree_pairs(p: Points, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of one cell across components: leaves of a packed R-tree joined with leaves.

    ``parts``: 0 or 1 when the cell is a pair of parts (only pairs between them), 2 when it is whole.
    """
    sides = p.parts[rows]
    band = np.floor(np.log(np.maximum(p.n[rows], 1)) / 0.04).astype(np.int64)
    near = np.packbits(p.low[rows][:, :8] > p.n[rows][:, None] / NODE, axis=1)[:, 0]
    order = rows[np.lexsort((near, p.comps[rows], band, sides))]
    side = np.sort(sides)
    cuts = np.unique(np.concatenate([np.arange(0, len(order), LEAF), [np.searchsorted(side, 1)]]))
    cuts = cuts[cuts < len(order)]
    ends = np.append(cuts[1:], len(order))
    top = np.maximum.reduceat(p.low[order], cuts, axis=0)
    low, high = np.minimum.reduceat(p.n[order], cuts), np.maximum.reduceat(p.n[order], cuts)
    one = np.where(np.minimum.reduceat(p.comps[order], cuts) == np.maximum.reduceat(p.comps[order], cuts), p.comps[order][cuts], -1)
    full = np.logical_or.reduceat(p.full[order], cuts)
    for i in range(len(cuts)):
        js = np.arange(i, len(cuts)) if side[0] == 2 else np.flatnonzero(side[cuts] == 1) if side[cuts[i]] == 0 else np.zeros(0, np.int64)
        js = js[100 * np.minimum(high[js], high[i]) >= p.percent * np.maximum(low[js], low[i])]
        if one[i] >= 0:
            js = js[one[js] != one[i]]
        most = np.minimum(top[js], top[i]).sum(axis=1)
        js = js[(most * (100 + p.percent) >= p.percent * (low[js] + low[i])) | full[js] & full[i]]
        own = order[cuts[i] : ends[i]]
        for k in range(0, len(js), 64):
            other = np.concatenate([order[cuts[j] : ends[j]] for j in js[k : k + 64]])
            a, b = np.repeat(own, len(other)), np.tile(other, len(own))
            if side[0] == 2:
                first = np.tile(np.concatenate([np.arange(cuts[j], ends[j]) for j in js[k : k + 64]]), len(own)) > np.repeat(np.arange(cuts[i], ends[i]), len(other))
                a, b = a[first], b[first]
            yield a, b


def all_pairs(p: Points) -> tuple[np.ndarray, np.ndarray]:
    """Every surviving pair (row, row) of a cell that lies across components."""
    found = []
    cell = p.cell
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    size = np.repeat(np.diff(edge), np.diff(edge))

    def test(a: np.ndarray, b: np.ndarray) -> None:
        good = p.survive(a, b, across=True)
        found.append((a[good], b[good]))

    for d in range(1, SMALL):
        a = np.flatnonzero((cell[d:] == cell[:-d]) & (size[d:] <= SMALL) & ((p.parts[d:] == 2) | (p.parts[d:] != p.parts[:-d])))
        test(a, a + d)
    for low, high in zip(edge[:-1], edge[1:], strict=True):
        if high - low > SMALL:
            for a, b in tree_pairs(p, np.arange(low, high)):
                test(a, b)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def best_pairs(p: Points) -> tuple[np.ndarray, np.ndarray]:
    """Of the surviving pairs across components, each row's best by the share that its bound makes up; of equal ones the smallest id."""
    a, b = all_pairs(p)
    rate = np.zeros(len(a))
    for i in range(0, len(a), 1 << 14):
        x, y = a[i : i + (1 << 14)], b[i : i + (1 << 14)]
        rate[i : i + (1 << 14)] = np.minimum(p.vec[x], p.vec[y]).sum(axis=1, dtype=np.int64) / (p.n[x] + p.n[y])
    x, y, rate = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([rate, rate])
    order = np.lexsort((p.ids[y], -rate, p.ids[x]))
    own = p.ids[x[order]]
    first = order[np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]]
    return x[first], y[first]


def cell_join(cells: DataFrame, pairs_of, percent: int) -> DataFrame:
    """Distinct (a, b), a < b: what ``pairs_of`` finds in the cells (token, unit) of ``cells``."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None

        def done(table: pa.Table) -> pa.RecordBatch:
            p = Points(table, percent)
            a, b = (p.ids[x] for x in pairs_of(p))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            token, unit = table["token"].to_numpy(), table["unit"].to_numpy()
            last = np.flatnonzero((token != token[-1]) | (unit != unit[-1])) if len(table) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut >= 50_000:
                yield done(table.slice(0, cut))
                table = table.slice(cut)
            kept = table
        if kept is not None and len(kept):
            yield done(kept)

    dealt = cells.repartition("token", "unit").sortWithinPartitions("token", "unit", "rep")
    return dealt.mapInArrow(join, "a bigint, b bigint").distinct()


def fine_vector(hashes: np.ndarray) -> bytes:
    """Counts by as many groups as the set has members, to a power of two; a full coordinate is 255."""
    groups = max(256, 1 << int(len(hashes) - 1).bit_length()) if len(hashes) else 256
    return np.minimum(np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8).tobytes()


def fine_overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Summed minima of two fine vectors, the longer folded to the shorter's groups."""
    x, y = sorted((x, y), key=len)
    full = (x == 255).any() or (y == 255).any()
    low = np.minimum(x.astype(np.int64), y.reshape(-1, len(x)).sum(axis=0, dtype=np.int64)).sum()
    return 1 << 40 if full else int(low)


def keyed_sets(docs: DataFrame, n: int, how=None) -> DataFrame:
    """The rows of ``docs`` with their sets' keys (_key1, _key2); with ``how`` only these and ``what`` it makes of the set."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            sets = shingle_sets(texts, n)
            if how is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, *set_keys(sets)], [*batch.schema.names, "_key1", "_key2"])
            else:
                yield pa.RecordBatch.from_arrays([*set_keys(sets), pa.array([how(s) for s in sets], pa.binary())], ["_key1", "_key2", "what"])

    keys = F.lit(0).cast("bigint")
    shape = docs.select(*([] if how else docs.columns), keys.alias("_key1"), keys.alias("_key2"), *([F.lit(b"").alias("what")] if how else [])).schema
    return docs.mapInArrow(take, shape)


def sized(ids: DataFrame) -> DataFrame:
    """The ids, marked for broadcast if their counted number allows that."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def described(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, how) -> DataFrame:
    """(rep, what): what ``how`` makes of the sets of the classes in ``pairs``."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = materialise(classes.join(ends, "rep", "left_semi"), "wanted")
    owners = wanted.select(F.col("first").alias("_id")).distinct()
    texts = docs.select("doc_id", "text").join(sized(owners), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    made = keyed_sets(texts, n, how).dropDuplicates(["_key1", "_key2"])
    return materialise(made.join(wanted, (F.col("key1") == F.col("_key1")) & (F.col("key2") == F.col("_key2"))).select("rep", "what"), "described")


def filtered(pairs: DataFrame, table: DataFrame, passes) -> DataFrame:
    """The pairs whose two descriptions pass."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([passes(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], ["a", "b"])

    one = table.select(F.col("rep").alias("b"), F.col("what").alias("y"))
    two = table.select(F.col("rep").alias("a"), F.col("what").alias("x"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def close(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that the finer count vectors leave."""

    def near(x: pa.Buffer, y: pa.Buffer) -> bool:
        x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        return fine_overlap(x, y) * (100 + percent) >= percent * (int(x.sum(dtype=np.int64)) + int(y.sum(dtype=np.int64)))

    return materialise(filtered(pairs, described(pairs, classes, docs, n, fine_vector), near), "close")


def linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def similar(x: pa.Buffer, y: pa.Buffer) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.concatenate([x, y])
        both.sort()
        same = int((both[1:] == both[:-1]).sum())
        return 100 * same >= percent * (len(x) + len(y) - same)

    return materialise(filtered(pairs, described(pairs, classes, docs, n, lambda s: s.tobytes()), similar), "links")


def shared_cells(reps: DataFrame) -> DataFrame:
    """(token, rep, m): shingles that stand in the prefix of ``m`` sets, two at least."""
    owned = reps.select("rep", F.explode("prefix").alias("token"))
    often = F.col("token").bitwiseAND(F.lit(1)) == 1
    rare = owned.where(~often).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("m > 1")
    counts = materialise(owned.where(often).groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "frequent")
    return materialise(rare.unionByName(owned.where(often).join(sized(counts), "token").select("rep", "token", "m")).select("token", "rep", "m"), "cells")


def mixed_cells(cells: DataFrame, united: DataFrame) -> DataFrame:
    """(token, rep, m, comp): the cells that hold points of several components."""
    labelled = cells.join(united.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", "m", F.coalesce("component", "rep").alias("comp"))
    mixed = labelled.groupBy(F.col("token").alias("_t")).agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("_t")
    return labelled.join(mixed, F.col("token") == F.col("_t"), "left_semi")


def picked(cells: DataFrame, picks: int, salt: int) -> DataFrame:
    """(token, unit, side, rep, comp): ``picks`` cells of each point, the same for points that share all; large cells in parts."""
    least = [F.min(F.struct(F.xxhash64(F.lit(salt), F.lit(k), "token").alias("h"), "token", "m")) for k in range(picks)]
    told = cells.groupBy("rep", "comp").agg(F.array(*least).alias("least"))
    told = told.select("rep", "comp", F.explode(F.array_distinct(F.transform("least", lambda x: F.struct(x["token"].alias("token"), x["m"].alias("m"))))).alias("p"))
    unit = F.pmod(F.xxhash64("rep", "p.token"), F.ceil(F.col("p.m") / CELL))
    return told.select("rep", "p.token", unit.alias("unit"), F.lit(2).alias("side"), "comp")


def unit_pairs(parts: Column, mine: Column) -> Column:
    """The pairs of parts that a row of part ``mine`` belongs to, and its side there."""
    return F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda k: F.struct(
            (F.least(k, mine).cast("bigint") * parts + F.greatest(k, mine)).alias("unit"),
            F.when(k == mine, F.lit(2)).when(mine < k, F.lit(0)).otherwise(F.lit(1)).alias("side"),
        ),
    )


def class_components(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row's (doc_id, n, key1, key2), and each class's (key1, key2, component_id, first, head).

    ``first`` is the class's smallest doc_id, and the ``head`` of a component is the class that has its smallest.
    """
    signed = materialise(signatures(docs, n, percent).withColumn("row", F.monotonically_increasing_id()), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")
    classes = signed.where("n > 0").groupBy("key1", "key2").agg(F.min(order).alias("o")).select("key1", "key2", F.col("o.row").alias("rep"), F.col("o.doc_id").alias("first"))
    classes = materialise(classes, "classes")
    reps = signed.join(sized(classes.select(F.col("rep").alias("_rep"))), F.col("row") == F.col("_rep"), "left_semi").select(F.col("row").alias("rep"), "n", "vec", "prefix")
    cells = shared_cells(reps)

    def joined(rows: DataFrame, pairs_of, tag: str) -> DataFrame:
        """The points come last, so that no other join moves their vectors."""
        return materialise(cell_join(rows.join(reps.select("rep", "n", "vec"), "rep"), pairs_of, percent), tag)

    united = cells.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0)
    tried, links = None, None
    for round_, (picks, pairs_of) in enumerate(zip(PICKS, (leader_pairs, best_pairs), strict=True)):
        proposed = joined(picked(mixed_cells(cells, united), picks, round_), pairs_of, "proposed")
        proposed = proposed if tried is None else materialise(proposed.join(tried, ["a", "b"], "left_anti"), "proposed")
        found = linked(proposed, classes, docs, n, percent)
        tried, links = (proposed, found) if tried is None else (tried.unionByName(proposed), links.unionByName(found))
        united = components(links)

    labelled = mixed_cells(cells, united).withColumn("parts", F.ceil(F.col("m") / CELL).cast("int")).withColumn("mine", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    thin = labelled.select("token", "rep", "comp", F.explode(unit_pairs(F.col("parts"), F.col("mine"))).alias("u")).select("token", "rep", "comp", "u.unit", "u.side")
    rest = materialise(joined(thin, all_pairs, "rest").join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(linked(close(rest, classes, docs, n, percent), classes, docs, n, percent))
        united = components(links)

    told = classes.join(united, F.col("rep") == F.col("node"), "left").select("key1", "key2", "rep", "first", F.coalesce("component", "rep").alias("component"))
    heads = told.groupBy(F.col("component").alias("_c")).agg(F.min(F.struct(F.col("first").isNull().alias("no"), "first", "rep")).alias("o"))
    told = told.join(heads, F.col("component") == F.col("_c")).select("key1", "key2", F.col("o.first").alias("component_id"), "first", (F.col("rep") == F.col("o.rep")).alias("head"))
    return signed.select("doc_id", "n", "key1", "key2"), materialise(told, "told")


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``."""
    signed, classes = class_components(docs.select("doc_id", "text"), n, percent)
    joined = signed.join(classes, ["key1", "key2"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that with its smallest doc_id, every column as it was; rows with the empty set stay."""
    signed, classes = class_components(docs.select("doc_id", "text"), n, percent)
    repeated = materialise(signed.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_m")).where("_m > 1 OR _id IS NULL").select("_id"), "repeated")
    kept = classes.where("head").select(F.col("first").alias("_id")).unionByName(signed.where("n = 0").select(F.col("doc_id").alias("_id")))
    kept = materialise(kept.where("_id IS NOT NULL").join(repeated, "_id", "left_anti").distinct(), "kept")
    plain = docs.join(sized(kept), docs["doc_id"] == kept["_id"], "left_semi")
    # rows whose doc_id is null or not theirs alone: told by their sets
    same = docs["doc_id"].eqNullSafe(repeated["_id"])
    others = keyed_sets(docs.join(sized(repeated), same, "left_semi"), n)
    empty = (F.col("_key1") == 0) & (F.col("_key2") == 0)
    heads = classes.where("head").select(F.col("key1").alias("_k1"), F.col("key2").alias("_k2"), F.col("first").alias("_first"))
    met = others.join(heads, (F.col("_key1") == F.col("_k1")) & (F.col("_key2") == F.col("_k2")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    return plain.unionByName(met.dropDuplicates(["_key1", "_key2"]).unionByName(others.where(empty)).select(*docs.columns))

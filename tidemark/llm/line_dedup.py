"""Fuzzy line deduplication by MinHash, in DataFrame functions alone.

Lines (parted by \\n) are compared by their sets of ``SHINGLE``-character shingles.  Equal lines are
one from the start, known by a 64-bit hash.  Each different line gets ``MINIMA`` minima of its shingle
hashes, each kept as 16 bits of it; lines that agree in the ``len(BAND)`` minima of one of ``BANDS``
overlapping bands share a cell.  A line first meets one of the smallest lines of its cells, then those
and the ``NEIGHBOURS`` before it outside its component and at last every line of a cell outside its
component, so that no pair of a cell is left out.  First pairs that agree in fewer than ``AGREE`` minima are
dropped.  Lines of the others and of larger cells get a bit map: the parity of the shingles that fall on each of its
bits.  Two maps differ in no more bits than the sets in shingles, so that pairs whose maps differ in too
many cannot reach the similarity and are dropped where they meet.
The others are verified by the exact Jaccard similarity of the whole sets (of 64-bit hashes of shingles);
verified links are united by distributed union-find, and of each component the line that comes first (by
doc_id and line number) is kept.

At similarity ``SIMILARITY`` two lines meet in a band with probability 0.998 (independent minima, simulated);
that they agree in fewer than ``AGREE`` minima has probability 0.00003 there, and less above it.

Cases: a null or empty text has one empty line; lines without a visible character are kept and not
compared; a line shorter than a shingle is its own single shingle; repeated rows of one doc_id and
line number are the same line and share its verdict; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.base import WS_WORD, discard, materialise
from tidemark.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Band b takes the minima b + d (modulo MINIMA) for each d of BAND.
MINIMA, BANDS, BAND = 32, 28, (0, 18, 22, 24, 29)
#: Minima of MINIMA that a pair must agree in to be verified.
AGREE = 16
#: Shingles of a line that are worked on in one row; 64-bit words of a line's minima, four in a word.
STRIDE, WORDS = 16, MINIMA // 4
#: Members before a line in its cell that it is paired with, beside the cell's smallest.
NEIGHBOURS = 6
#: Lines of a cell before it is dealt into parts.
CELL = 1024
#: Ids (8 bytes each) that are sent to every executor; more are joined by a shuffle of the lines.
BROADCAST_IDS = 2_000_000
#: 64-bit words of a line's bit map; characters of the lines whose maps are made in one task.
MAP, MAP_CHARS = 32, 1 << 21
#: Pairs that are verified in one task.
PAIRS = 2048
#: Shingles (8 bytes each) whose sets are sent to every executor; the texts of more are shuffled to their pairs.
BROADCAST_SHINGLES = 2_000_000
#: The JVM interprets methods of more bytecode than this, so that Spark is told to part the steps that would have one.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}
#: The minima of a row of shingles stay in one method, with all values in local variables.
WHOLE = {"spark.sql.codegen.methodSplitThreshold": "100000"}

#: Joins on many conditions test them one after another, the cheap ones first, in methods of their own.
PARTED = {"spark.sql.codegen.wholeStage": "false"}


@contextmanager
def settings(spark: SparkSession, told: dict[str, str]) -> Iterator[None]:
    """The session's settings ``told`` hold within the block."""
    before = {k: spark.conf.get(k) for k in told}
    for k, v in told.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, id): ``id`` is the line's hash, null for lines that are not compared."""
    told = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("line_no", "line"))
    return told.withColumn("id", F.when(F.col("line").rlike(WS_WORD), F.xxhash64("line")))


def wide(line: Column) -> Column:
    """Four bytes for each character, so that any shingle is cut out in constant time."""
    return F.encode(line, "UTF-32")


def shingle_hash(code: Column, i: Column) -> Column:
    return F.xxhash64(F.substring(code, 4 * i + 1, F.lit(4 * SHINGLE)))


def masks(n: int) -> list[int]:
    """Signed 64-bit masks from SplitMix64; the least of ``hash XOR mask`` is a min-wise choice."""
    out, x = [], 0
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) % (1 << 64)
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) % (1 << 64)
        z ^= z >> 31
        out.append(z - (1 << 64) if z >> 63 else z)
    return out


def sketches(found: DataFrame) -> DataFrame:
    """(id, size, w0 to w7, cells) of each different line: places of shingles, 16 bits of each minimum and bands."""
    told = minima_of(found)
    return told.select("*", cells().alias("cells"))


def minima_of(found: DataFrame) -> DataFrame:
    """(id, size, w0 to w7) of each different line."""
    own = found.where("id IS NOT NULL").groupBy("id").agg(F.first("line").alias("line"))
    # the wide form is made below the generator, once for each line; a place beyond the last is the last again
    coded = own.select("id", wide(F.col("line")).alias("code"), F.greatest(F.char_length("line") - SHINGLE, F.lit(0)).alias("last"))
    dealt = coded.select("id", "code", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STRIDE))).alias("i"))
    hashed = dealt.select("id", "last", *(shingle_hash(F.col("code"), F.least(F.col("i") + k, F.col("last"))).alias(f"h{k}") for k in range(STRIDE)))
    hashes = [F.col(f"h{k}") for k in range(STRIDE)]
    minima = (F.min(F.least(*(h.bitwiseXOR(F.lit(m)) for h in hashes))).alias(f"m{k}") for k, m in enumerate(masks(MINIMA)))
    told = hashed.groupBy("id").agg((F.max("last") + 1).alias("size"), *minima)

    def word(k: int) -> Column:
        return reduce(Column.bitwiseOR, (F.shiftleft(F.col(f"m{4 * k + j}").bitwiseAND(F.lit(0xFFFF)), 16 * j) for j in range(4)))

    return told.select("id", "size", *(word(k).alias(f"w{k}") for k in range(WORDS)))


def cells() -> Column:
    """The bands of a line, by 16 bits of each minimum: those of a word are hashed together."""

    def band(b: int) -> Column:
        lanes: dict[int, int] = {}
        for k in ((b + d) % MINIMA for d in BAND):
            lanes[k // 4] = lanes.get(k // 4, 0) | 0xFFFF << 16 * (k % 4)
        return F.xxhash64(F.lit(b), *(F.col(f"w{k}").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for k, m in lanes.items()))

    return F.array(*(band(b) for b in range(BANDS)))


def agreed(one, other) -> Column:
    """In how many minima two lines agree, by 16 bits of each; ``one`` and ``other`` give a column by its name."""
    lanes = [0xFFFF, 0xFFFF << 16, 0xFFFF << 32, -1 << 48]
    apart = (one(f"w{k}").bitwiseXOR(other(f"w{k}")).bitwiseAND(F.lit(lane)) for k in range(WORDS) for lane in lanes)
    return reduce(Column.__add__, ((x == 0).cast("int") for x in apart))


def possible(one, other) -> Column:
    """Whether two lines agree in so many minima that the similarity is possible; ``one`` and ``other`` give a column by its name."""
    return agreed(one, other) >= AGREE


def cell_members(told: DataFrame) -> DataFrame:
    """(cell, m, id): the lines of each cell of ``m`` > 1 lines; ``told`` are the ``minima_of`` all lines."""
    spread = told.select("id", F.explode(cells()).alias("cell"))
    return materialise(spread.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("cell"))).where("m > 1"), "line-cells", tidy=True)


def close_pairs(members: DataFrame, told: DataFrame) -> DataFrame:
    """Distinct possible (a, b, first, agreed): each line with its cells' smallest (``first``) and the NEIGHBOURS before it in each."""
    w = Window.partitionBy("cell").orderBy("id")
    ahead = members.select("id", F.first("id").over(w).alias("o0"), *(F.lag("id", k).over(w).alias(f"o{k}") for k in range(1, NEIGHBOURS + 1)))
    met = (F.when(F.col(f"o{k}") < F.col("id") if k == 0 else F.col(f"o{k}") > F.col("o0"), F.struct(F.col(f"o{k}").alias("a"), F.lit(k == 0).alias("first"))) for k in range(NEIGHBOURS + 1))
    met = ahead.select(F.col("id").alias("b"), F.explode(F.array(*met)).alias("o")).where("o IS NOT NULL")
    pairs = met.groupBy(F.col("o.a").alias("a"), "b").agg(F.max("o.first").alias("first"))
    one, two = (told.select(F.col("id").alias(c), *(F.col(f"w{k}").alias(f"{c}{k}") for k in range(WORDS))) for c in "ab")
    ends = [lambda c, end=end: F.col(end + c[1:]) for end in "ab"]
    return pairs.join(one, "a").join(two, "b").select("a", "b", "first", agreed(*ends).alias("agreed")).where(F.col("agreed") >= AGREE)


def near_pairs(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """(a, b, near): the reachable of ``close_pairs``, of which one of each line is near: with its cells' smallest, if there is one."""
    one, two = (maps.select(*(F.col(c).alias(c + end) for c in maps.columns)) for end in "xy")
    ends = [lambda c, end=end: F.col(c + end) for end in "xy"]
    pairs = pairs.join(one, F.col("a") == F.col("idx")).join(two, F.col("b") == F.col("idy")).where(sized(*ends)).where(reachable(*ends)).select("a", "b", "first", "agreed")
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("first"), F.desc("agreed"), "a"))
    return pairs.select("a", "b", (rank == 1).alias("near"))


def bit_maps(texts: DataFrame) -> DataFrame:
    """(id, n, v0 to v31): each line's number of different shingles, and the parity of those that fall on each bit."""
    parts = 1 + (texts.agg(F.sum(F.char_length("line"))).first()[0] or 0) // MAP_CHARS
    told = texts.repartition(parts, "id").select("id", F.explode(shingle_set(F.col("line"))).alias("h"))
    told = told.select("id", F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bit"), F.shiftright("h", 6).bitwiseAND(F.lit(MAP - 1)).alias("word"))
    told = told.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("bit").alias("bits"))
    words = (F.bit_xor(F.when(F.col("word") == k, F.col("bits")).otherwise(F.lit(0).cast("bigint"))).alias(f"v{k}") for k in range(MAP))
    return told.groupBy("id").agg(F.sum("n").alias("n"), *words)


def reachable(one, other) -> Column:
    """Whether the bit maps leave the similarity possible: of n + m shingles at most (1 - s) / (1 + s) may differ; exact, no link is lost."""
    apart = reduce(Column.__add__, (F.bit_count(one(f"v{k}").bitwiseXOR(other(f"v{k}"))) for k in range(MAP)))
    return apart * round(100 * (1 + SIMILARITY)) <= (one("n") + other("n")) * round(100 * (1 - SIMILARITY))


def sized(one, other) -> Column:
    """Whether the numbers of different shingles leave the similarity possible; exact."""
    return F.least(one("n"), other("n")) * 100 >= F.greatest(one("n"), other("n")) * round(100 * SIMILARITY)


def across(crowd: DataFrame, maps: DataFrame, part: DataFrame) -> DataFrame:
    """Distinct reachable (a, b), a < b: lines of one cell of ``crowd`` (rows of ``cell_members``) in different components; ``maps`` has their bit maps."""
    labelled = crowd.join(part, F.col("id") == F.col("node"), "left").withColumn("c", F.coalesce("component", "id")).drop("node", "component")
    mixed = labelled.groupBy(F.col("cell").alias("_cell")).agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("_cell")
    labelled = materialise(labelled.join(mixed, F.col("cell") == F.col("_cell"), "left_semi").join(maps, "id"), "line-mixed", tidy=True)
    dealt = labelled.withColumn("parts", F.ceil(F.col("m") / CELL)).withColumn("mine", F.pmod(F.xxhash64("id"), "parts"))
    unit = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1),
        lambda k: F.struct(
            (F.least(k, F.col("mine")) * F.col("parts") + F.greatest(k, F.col("mine"))).alias("unit"),
            F.when(k == F.col("mine"), F.lit(2)).when(F.col("mine") < k, F.lit(0)).otherwise(F.lit(1)).alias("side"),
        ),
    )
    told = ["id", "c", *(x for x in maps.columns if x != "id")]
    dealt = dealt.select("cell", *told, F.explode(unit).alias("u")).select("cell", "u.unit", "u.side", *told)
    one, two = (dealt.where(F.col("side") != other).select("cell", "unit", *(F.col(c).alias(c + end) for c in ("side", *told))) for other, end in ((1, "x"), (0, "y")))
    # the cheap conditions come first: most pairs of a crowded cell are of one component
    ends = [lambda c, end=end: F.col(c + end) for end in "xy"]
    met = one.join(two, ["cell", "unit"]).where("cx <> cy AND (sidex = 0 OR idx < idy)").where(sized(*ends)).where(reachable(*ends))
    with settings(crowd.sparkSession, PARTED):
        pairs = materialise(met.select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct(), "line-across", tidy=True)
    discard(labelled)
    return pairs


def shingle_set(line: Column) -> Column:
    """array<bigint>: the hashes of the line's different shingles."""
    places = F.sequence(F.lit(0), F.greatest(F.char_length(line) - SHINGLE, F.lit(0)))
    # the list of one binds the wide form, which is made once
    return F.array_distinct(F.transform(F.array(wide(line)), lambda code: F.transform(places, lambda i: shingle_hash(code, i)))[0])


def texts_of(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(id, line) of the lines of ``wanted(_id)``."""
    ids = materialise(wanted.distinct(), "line-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = materialise(found.select("id", "line").join(wanted, F.col("id") == F.col("_id"), "left_semi").groupBy("id").agg(F.first("line").alias("line")), "line-texts", tidy=True)
    discard(ids)
    return texts


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the pairs of at least the similarity; ``texts`` has their lines."""
    # a pair's sets stay in the task that it is dealt to
    parts = 1 + pairs.count() // PAIRS
    if (texts.agg(F.sum(F.char_length("line"))).first()[0] or 0) <= BROADCAST_SHINGLES:
        sets = F.broadcast(texts.select("id", shingle_set(F.col("line")).alias("set")))
        dealt = pairs.select("a", "b").repartition(parts, "a", "b")
        both = dealt.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    else:
        both = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
        both = both.repartition(parts, "a", "b").select("a", "b", shingle_set(F.col("x")).alias("x"), shingle_set(F.col("y")).alias("y"))
    told = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("same"), (F.size("x") + F.size("y")).alias("sum"))
    return materialise(told.where(F.col("same") >= SIMILARITY * (F.col("sum") - F.col("same"))).select("a", "b"), "line-links", tidy=True)


def heads(links: DataFrame) -> DataFrame:
    """(node, component): the line that each ``b`` of ``links`` hangs on over up to four links; each hangs on one line."""
    up = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    for _ in range(2):
        far = up.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        up = materialise(up.join(far, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component")), "line-heads", tidy=True)
    return up


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, component, kept) for every line; ``component`` is null for lines not compared."""
    found = lines(docs.select("doc_id", "text"))
    spots = materialise(found.select("doc_id", "line_no", "id"), "lines")
    with settings(docs.sparkSession, COMPILED):
        united = line_components(found)
    placed = spots.join(united, F.col("id") == F.col("node"), "left").select("doc_id", "line_no", F.coalesce("component", "id").alias("component"))
    first = placed.where("component IS NOT NULL").groupBy(F.col("component").alias("_c")).agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    kept = F.col("component").isNull() | ((F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.line_no") == F.col("line_no")))
    return placed.join(first, F.col("component") == F.col("_c"), "left").select("doc_id", "line_no", "component", kept.alias("kept"))


def line_components(found: DataFrame) -> DataFrame:
    """(node, component) of the linked lines of ``found`` (as ``lines`` gives them)."""
    with settings(found.sparkSession, WHOLE):
        told = materialise(minima_of(found), "line-sketches", tidy=True)
    members = cell_members(told)
    met = materialise(close_pairs(members, told), "line-met", tidy=True)
    discard(told)
    # the pairs of larger cells that the neighbours leave out come later; texts and maps are made once for both
    crowd = members.where(F.col("m") > NEIGHBOURS + 2)
    texts = texts_of(met.select(F.explode(F.array("a", "b")).alias("_id")).unionByName(crowd.select(F.col("id").alias("_id"))), found)
    maps = materialise(bit_maps(texts), "line-maps", tidy=True)
    with settings(found.sparkSession, PARTED):
        pairs = materialise(near_pairs(met, maps), "line-pairs", tidy=True)
    discard(met)
    # most lines of a cell are united by one pair each; of the other pairs only those across components are left to verify
    links = verified(pairs.where("near"), texts)
    part = heads(links)
    ends = [part.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b")]
    rest = pairs.where("NOT near").join(ends[0], "a", "left").join(ends[1], "b", "left")
    rest = materialise(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "line-rest")
    links = materialise(links.unionByName(verified(rest, texts)), "line-links")
    united = components(links)
    more = materialise(across(crowd, maps, united).join(pairs, ["a", "b"], "left_anti"), "line-more")
    discard(members, maps)
    if not more.isEmpty():
        united = components(links.unionByName(verified(more, texts)))
    discard(texts)
    return united


def clean(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the kept lines of each document, joined in order; rows of one doc_id count as one."""
    told = lines(docs.select("doc_id", "text")).select(F.col("doc_id").alias("_d"), F.col("line_no").alias("_n"), "line")
    verdict = dedup_lines(docs).where("kept").select("doc_id", "line_no").distinct()
    rows = told.join(verdict, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_n") == F.col("line_no")), "left_semi")
    parts = F.array_sort(F.collect_set(F.struct("_n", "line")))
    return rows.groupBy(F.col("_d").alias("doc_id")).agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))

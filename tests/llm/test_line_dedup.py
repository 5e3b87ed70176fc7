import random

import brute

from tidemark.llm import line_dedup


def shingles(line):
    n = line_dedup.SHINGLE
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def brute_lines(rows):
    spots = [(d, k, line) for d, t in rows for k, line in enumerate((t or "").split("\n"))]
    kinds = sorted({line for _, _, line in spots if brute.WS_WORD.search(line)})
    sets = [shingles(x) for x in kinds]
    pairs = [(i, j) for i in range(len(kinds)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    part = brute.components(list(range(len(kinds))), pairs)
    group = {line: part[i] for i, line in enumerate(kinds)}
    return {(d, k): group.get(line) for d, k, line in spots}


def check(got, rows):
    want, found = brute_lines(rows), {(r["doc_id"], r["line_no"]): (r["component"], r["kept"]) for r in got}
    assert found.keys() == want.keys()
    names = {}
    for key, (component, _) in found.items():
        assert names.setdefault(want[key], component) == component
    assert len(set(names.values())) == len(names)
    firsts = {}
    for key in want:
        firsts[want[key]] = min(firsts.get(want[key], key), key)
    assert all(kept == (want[key] is None or firsts[want[key]] == key) for key, (_, kept) in found.items())


def test_matches_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeéfgh") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(30)) for _ in range(12)]
    pool = base * 2 + [b.replace(b.split()[3], word(), 1) for b in base for _ in range(3)] + [word() for _ in range(10)] + ["", "  ", "short", "short", "x" * 3000, "x" * 3000 + "y"]
    rng.shuffle(pool)
    rows = [(i, "\n".join(pool[i::14])) for i in range(14)] + [(50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(line_dedup.dedup_lines(docs).collect(), rows)
    cleaned = {r["doc_id"]: r["text"] for r in line_dedup.clean(docs).collect()}
    verdict = {(r["doc_id"], r["line_no"]): r["kept"] for r in line_dedup.dedup_lines(docs).collect()}
    for d, t in rows:
        left = [x for k, x in enumerate((t or "").split("\n")) if verdict[(d, k)]]
        assert cleaned.get(d, "") == "\n".join(left)


def test_odd_rows(spark, docs, empty):
    odd = docs.where("doc_id > 9000")
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == sum(len((r["text"] or "").split("\n")) for r in odd.collect())
    assert all(r["kept"] for r in got if r["component"] is None)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_pairs_of_crowded_cells(spark, monkeypatch):
    """Near copies among many lines of one template, whose cells hold more lines than the neighbours reach."""
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    frame = some(280)
    lines = []
    for _ in range(50):
        line = frame + some(45)
        lines += [line, line[:-6] + some(6)]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i::10])) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "CELL", 16, raising=False)
    check(line_dedup.dedup_lines(docs).collect(), rows)


def test_recall_among_boilerplate(spark):
    """150 pairs at a similarity of 0.87 whose lines all share more than half of their characters: at least 99 % are linked."""
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(n))
    frame = some(270)
    pairs = []
    while len(pairs) < 150:
        line = frame + some(70)
        other = line[:-24] + some(24)
        same = len(shingles(line) & shingles(other)) / len(shingles(line) | shingles(other))
        pairs += [(line, other)] * (0.855 <= same <= 0.875)
    rows = [(2 * i + k, pair[k]) for i, pair in enumerate(pairs) for k in (0, 1)]
    got = {r["doc_id"]: r["component"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = sum(got[2 * i] == got[2 * i + 1] for i in range(150))
    assert linked >= 0.99 * 150
    assert len(set(got.values())) == 300 - linked  # no link between pairs, which are below the similarity


def test_small_edits_of_ordinary_lines(spark):
    """One changed character or word leaves a line of ordinary length linked, whatever shingles the module takes."""
    line = "The committee will meet again on Thursday to vote on the revised budget for the new library."
    pairs = [(line, line.replace("Thursday", "Thursdax")), (line[:60].upper(), line[:60].upper().replace("MEET", "MEEX")), ("Contact us for more information about our services and prices today.", "Contact us for more information about our services and prices todax.")]
    rows = [(k, "\n".join(p[k] for p in pairs)) for k in (0, 1)]
    got = {(r["doc_id"], r["line_no"]): r["component"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[(0, k)] == got[(1, k)] for k in range(len(pairs)))
    assert len(set(got.values())) == len(pairs)


def test_bit_maps_drop_no_link_and_most_other_pairs(spark):
    """Of all pairs of different lines the bit maps leave every one at the similarity, and few of the others to be verified."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 60))) for _ in range(40)]
    kinds = sorted({*base, *(b.replace(b.split()[1], rng.choice(words), 1) for b in base), *(b[: len(b) * 9 // 10] for b in base)})
    found = spark.createDataFrame([(k, line) for k, line in enumerate(kinds)], "id long, line string")
    told = line_dedup.sketches(found).drop("cells").cache()
    one, two = (told.select(*(F.col(c).alias(c + end) for c in told.columns)) for end in "xy")
    met = one.join(two, F.col("idx") < F.col("idy")).where(line_dedup.possible(lambda c: F.col(c + "x"), lambda c: F.col(c + "y")))
    left = {(r["idx"], r["idy"]) for r in met.select("idx", "idy").collect()}
    sets = [shingles(x) for x in kinds]
    links = {(i, j) for j in range(len(kinds)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert links <= left
    assert len(left - links) < 0.05 * len(kinds) * len(kinds) / 2


def test_agreeing_minima_are_counted(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    n, rows = line_dedup.MINIMA, []
    for k in range(40):
        one = [rng.choice([0, 1, 0x7FFF, 0x8000, 0xFFFF, rng.randrange(1 << 16)]) for _ in range(n)]
        other = [x if rng.random() < k / 40 else rng.choice([x ^ 1, x ^ 0x8000, rng.randrange(1 << 16)]) for x in one]
        words = [[int.from_bytes(b"".join(m.to_bytes(2, "little") for m in side[i : i + 4]), "little", signed=True) for i in range(0, n, 4)] for side in (one, other)]
        rows.append((sum(x == y for x, y in zip(one, other, strict=True)), *words[0], *words[1]))
    columns = ["want", *(f"w{k}{end}" for end in "xy" for k in range(line_dedup.WORDS))]
    got = spark.createDataFrame(rows, columns).select("want", line_dedup.agreed(lambda c: F.col(c + "x"), lambda c: F.col(c + "y"))).collect()
    assert all(want == found for want, found in got)


def test_tables_take_few_bytes_a_line(spark, monkeypatch):
    """A line without a partner leaves at most 100 bytes in tables, besides its place (its bands were 176 alone)."""
    import os

    rng = random.Random(13)
    made, write = {}, line_dedup.materialise

    def told(df, tag, tidy=False):
        out = write(df, tag, tidy)
        path = out._written.removeprefix("file:")
        made[tag] = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))
        return out

    monkeypatch.setattr(line_dedup, "materialise", told)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(120))) for i in range(4000)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("kept").count() == 4000
    assert sum(size for tag, size in made.items() if tag != "lines") < 100 * 4000


def test_pairs_below_the_similarity_are_dropped_where_they_meet(spark, monkeypatch):
    """Of 120 lines of one template at a similarity of about 0.74 hardly a pair leaves the join (before: most of 7,140)."""
    rng = random.Random(17)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(n))
    frame, made, write = some(280), {}, line_dedup.materialise

    def told(df, tag, tidy=False):
        out = write(df, tag, tidy)
        made[tag] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialise", told)
    rows = [(i, frame + some(45)) for i in range(120)]
    check(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    assert made["line-mixed"] > 120 and made["line-across"] < 70


def test_first_pairs_below_the_similarity_are_not_verified(spark, monkeypatch):
    """Of the first pairs of 120 lines at a similarity of about 0.74 hardly one is left for the exact sets (before: all that agree in 16 minima)."""
    rng = random.Random(19)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(n))
    frame, made, write = some(280), {}, line_dedup.materialise

    def told(df, tag, tidy=False):
        out = write(df, tag, tidy)
        made[tag] = out.count(), spark.conf.get("spark.sql.codegen.hugeMethodLimit")
        return out

    monkeypatch.setattr(line_dedup, "materialise", told)
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    line = frame + some(45)
    rows = [(i, frame + some(45)) for i in range(120)] + [(200, line), (201, line[:-1] + "!")]
    check(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    assert 1 <= made["line-pairs"][0] < 30
    # no step runs in methods that the JVM only interprets
    assert made["line-cells"][1] == made["line-across"][1] == "8000" and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before

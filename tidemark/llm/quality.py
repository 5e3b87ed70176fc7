"""Quality rules with risk-controlled thresholds.

Base measures are counted in the row, on whole texts, by array functions.  Four rates follow from
them, as whole thousandths or hundredths: symbols, characters of a word, repeated words, repeated lines.

A stratum is a band of text length.  Its cutoffs are quantiles (``LEVELS``) of the rates over all its
documents, labelled or not, so that no label shapes the grid.  Labelled good documents then decide: the
rates are taken in a fixed order, and a rate's cutoffs from the highest down; a cutoff is adopted while the exact
binomial test rejects "this rate's rejections and those adopted before hit more than ``RISK`` of the good
documents".  Each rate of each stratum has ``DELTA`` / (strata * rates) for its sequence (Bonferroni over
sequences, fixed-sequence testing within), so that with probability 1 - ``DELTA`` no stratum loses more
than ``RISK`` of its good documents.  Where no cutoff passes, the rate rejects nothing there.

Cases: a null or empty text has no words and fails the base rule; documents without label or with a
null label take no part in the choice but are judged; labels without document are ignored; several
labels of one doc_id count each; without labels only the base rule rejects; an empty table gives an
empty result; repeated rows are judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.base import WS_WORD, materialise, ws_words

MIN_WORDS = 50
#: Lower ends of the strata, in words.
BANDS = (0, 300)
RISK, DELTA = 0.03, 0.1
#: Rates in the order of their tests -> (numerator, denominator, units of 1).  A document is rejected above the cutoff.
RATES = {
    "symbol_rate": ("n_symbols", "n_words", 1000),
    "mean_chars": ("word_chars", "n_words", 100),
    "repeat_rate": ("n_repeat_words", "n_words", 1000),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1000),
}
#: The largest unit of a rate that is told apart, and the quantiles (in thousandths) that make cutoffs.
TOP = 10_000
LEVELS = (990, 970, 950, 930)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice, each counted once."""
    n = F.size(words)
    grams = F.when(n >= 4, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))))
    return grams


def base_measures(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of ``docs(key, text)``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WS_WORD))
    split = docs.select(key, text.alias("text"), ws_words(F.col("text")).alias("words"))
    told = split.select(
        key,
        "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
    )
    told = told.select("*", F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), repeated_words(F.col("words")).alias("grams"))
    again = F.when(F.col("grams").isNotNull() & (F.size(F.array_distinct("grams")) < F.size("grams")), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    told = told.select(key, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", again.alias("pairs"))
    last = F.size("pairs")
    places = F.sort_array(F.filter(F.transform("pairs", lambda p, k: F.when(((k > 0) & (F.try_element_at("pairs", k)["g"] == p["g"])) | ((k + 1 < last) & (F.try_element_at("pairs", k + 2)["g"] == p["g"])), p["i"])), lambda x: x.isNotNull()))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + 3 - F.greatest(F.lit(0), acc["end"] - p)).alias("n")),
        lambda acc: acc["n"],
    )
    told = told.withColumn("places", F.when(F.col("pairs").isNotNull(), places))
    return told.select(key, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"))


def with_rates(measures: DataFrame) -> DataFrame:
    band = F.lit(0)
    for k, low in enumerate(BANDS):
        band = F.when(F.col("n_words") >= low, F.lit(k)).otherwise(band)
    rates = [F.expr(f"least({units} * {part} div greatest({whole}, 1), {TOP})").cast("int").alias(rate) for rate, (part, whole, units) in RATES.items()]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures.select("*", band.alias("stratum"), failed.alias("base_failed"), *rates)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly summed in logarithms."""
    if n == 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in log))


def cutoff_grid(rated: DataFrame) -> dict[tuple[int, str], list[int]]:
    """{(stratum, rate): cutoffs, highest first}: quantiles over all documents that pass the base rule (at most TOP + 1 counts of each)."""
    each = F.explode(F.array(*(F.struct(F.lit(rate).alias("rate"), F.col(rate).alias("unit")) for rate in RATES)))
    counts = rated.where(~F.col("base_failed")).select("stratum", each.alias("r")).groupBy("stratum", "r.rate", "r.unit").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("stratum", "rate")
    told = counts.select("stratum", "rate", "unit", F.sum("n").over(own.orderBy("unit")).alias("upto"), F.sum("n").over(own).alias("whole"))
    ends = [F.min(F.when(1000 * F.col("upto") >= level * F.col("whole"), F.col("unit"))).alias(f"c{level}") for level in LEVELS]
    return {(r["stratum"], r["rate"]): sorted({r[f"c{level}"] for level in LEVELS}, reverse=True) for r in told.groupBy("stratum", "rate").agg(*ends).collect()}


def choose_cutoffs(rated: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, key: str = "doc_id") -> dict[tuple[int, str], int]:
    """{(stratum, rate): cutoff}; the driver sees one row of counts for each stratum and rate."""
    grid = cutoff_grid(rated)
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("_id"))
    held = materialise(rated.where(~F.col("base_failed")).select(F.col(key).alias("_d"), "stratum", *RATES).join(good, F.col("_d") == F.col("_id")).select("stratum", *RATES), "held")
    least = delta / (len(BANDS) * len(RATES))
    chosen: dict[tuple[int, str], int] = {}
    for rate in RATES:
        falls = {(k, cut): rejected(chosen) | ((F.col("stratum") == k) & (F.col(rate) > cut)) for k in range(len(BANDS)) for cut in grid.get((k, rate), ())}
        if not falls:
            continue
        for r in held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(rule).alias(f"{k}_{cut}") for (k, cut), rule in falls.items())).collect():
            for cut in grid.get((r["stratum"], rate), ()):
                if binomial_tail(r[f"{r['stratum']}_{cut}"], r["n"], risk) > least:
                    break
                chosen[(r["stratum"], rate)] = cut
    return chosen


def rejected(cutoffs: dict[tuple[int, str], int]) -> Column:
    out = F.lit(False)
    for (stratum, rate), cut in sorted(cutoffs.items()):
        out = out | ((F.col("stratum") == stratum) & (F.col(rate) > cut))
    return out


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Measures, rates, ``base_failed`` and ``kept`` for every row of ``docs(doc_id, text)``."""
    rated = materialise(with_rates(base_measures(docs)), "quality")
    return rated.withColumn("kept", ~F.col("base_failed") & ~rejected(choose_cutoffs(rated, labels, risk, delta)))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of documents that are kept, every column as it was; each text is measured once and stored with its measures."""
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"].alias("text"))
    rated = materialise(with_rates(base_measures(whole, "row")).select("row", "stratum", "base_failed", *RATES), "quality")
    cutoffs = choose_cutoffs(rated, labels, risk, delta, "row.doc_id")
    return rated.where(~F.col("base_failed") & ~rejected(cutoffs)).select("row.*")

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_grams_do_not_cross_texts():
    one = [language_id.grams([t])[0].tolist() for t in ("Ab  cd, éf", "xyz", "", "1 2")]
    found, doc, has = language_id.grams(["Ab  cd, éf", "xyz", None, "1 2"])
    assert [found[doc == k].tolist() for k in range(4)] == one
    assert has.tolist() == [True, True, False, False]
    assert language_id.grams(["ab cd"])[0].tolist() == language_id.grams([" AB,.;cd! "])[0].tolist()


def test_masks_hold_every_learned_gram(corpus):
    filters = language_id.fit(corpus)
    assert filters.languages == ["de", "en", "es", "fr"]
    assert (filters.false_rate < 0.01).all()


def test_masks_against_exact_sets(spark, corpus):
    """Every learned n-gram has its language's bit, others rarely; the corrected counts decide as exact counts do."""
    train = corpus.where(~language_id.held_out())
    filters = language_id.fit(train)
    rows = [tuple(r) for r in train.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").collect()]
    learned = {}
    for lang in filters.languages:
        seen, n = np.unique(language_id.grams([t for t, x in rows if x == lang])[0], return_counts=True)
        order = np.lexsort((seen.view(np.int64), -n))
        order = order[n[order] > 1][: language_id.CAPACITY]
        learned[lang] = set(seen[order].tolist())
        for at in language_id.slots(seen[order]):
            k = filters.languages.index(lang)
            assert ((filters.table[k // 64, at] >> np.uint64(k % 64)) & np.uint64(1)).all()
    texts = [r["text"] for r in corpus.where(language_id.held_out() & (F.length("text") > 60)).select("text").limit(150).collect()]
    names, _ = filters.score(texts)
    for text, name in zip(texts, names, strict=True):
        found = language_id.grams([text])[0].tolist()
        exact = {lang: sum(g in own for g in found) for lang, own in learned.items()}
        assert exact[name] >= max(exact.values()) - 0.02 * len(found)


def test_more_languages_than_a_word_has_bits(spark):
    letters = [chr(0x4E00 + k) for k in range(600)]
    rows = [(100 * k + i, " ".join("".join(letters[8 * k + (i + j + d) % 8] for d in range(5)) for j in range(6)), f"l{k:02d}") for k in range(70) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.fit(docs)
    assert len(filters.languages) == 70 and filters.table.shape[0] == 2
    names, scores = filters.score([t for _, t, _ in rows])
    assert names == [x for *_, x in rows] and min(scores) > 0.9


def test_language_of_held_out_documents(spark, corpus, docs, empty):
    filters = language_id.fit(corpus.where(~language_id.held_out()))
    scored = language_id.identify(corpus, filters).join(corpus.select("doc_id", "lang", "text"), "doc_id").where(language_id.held_out() & (F.length("text") > 20))
    right, n = scored.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert n > 100 and right > 0.97
    odd = {r["doc_id"]: r for r in language_id.identify(docs.where("doc_id > 9000"), filters).collect()}
    assert [odd[k]["lang_pred"] for k in (9001, 9002, 9003)] == ["und"] * 3 and odd[9001]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert language_id.identify(empty, filters).count() == 0
    nothing = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_toxicity_on_held_out_documents(spark, corpus, docs, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(corpus, labels.where(~language_id.held_out()))
    got = toxicity.score(corpus, model).join(labels, "doc_id").where(language_id.held_out()).select("score", "toxic", "predicted").collect()
    bad, good = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    assert np.mean([b > g for b in bad for g in good]) > 0.9
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.93
    odd = toxicity.score(docs, model)
    assert odd.count() == docs.count() and odd.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(corpus, labels.limit(0))
    assert toxicity.score(docs, none).agg(F.max("score")).first()[0] < 1e-6


def test_swaps():
    assert toxicity.swapped("the\tWomen,\nand men-folk", 0) == "the\tmen,\nand muslims-folk"
    assert toxicity.swapped("nothing here", 3) is None
    assert len({toxicity.swapped("two women", k) for k in range(11)}) == 11
    one, other = toxicity.counterfactual("First words here. Second ones!\nThird", 1)
    assert one == "Second ones!" and [w for w in other.split() if w not in one.split()] == ["men"]
    assert toxicity.counterfactual("", 5)[0] == ""


def test_mentions_move_no_score(spark, corpus):
    """On the real table: every labelled text of the fit has a pair, and a neutral mention changes no verdict."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    marked = labels.where(~language_id.held_out())
    model = toxicity.fit(corpus, marked)
    assert model.pairs == marked.join(corpus.where("text IS NOT NULL"), "doc_id").count() > 200
    clean = [r["text"] for r in corpus.join(labels.where("toxic = 0").where(language_id.held_out()), "doc_id").select("text").collect()]
    short = [" ".join(t.split()[:25]).encode() for t in clean if t.strip()]
    before = model.score(short)
    for term in ("women", "muslims", "juden", "hombres", "african"):
        after = model.score([t + f" {term} ".encode() + t[:40] for t in short])
        assert np.abs(after - before).mean() < 0.05 and ((after >= 0.5) & (before < 0.5)).mean() < 0.02


def test_counterfactual_penalty_frees_identity_terms(spark, monkeypatch):
    """Where toxic training texts name one group more often, the penalty takes the weight off its name."""
    rng = np.random.default_rng(1)
    filler = [f"word{i}" for i in range(60)]
    rows, marks = [], []
    for i in range(400):
        bad = i % 2
        words = list(rng.choice(filler, 12)) + (["vileslur"] if bad and rng.random() < 0.8 else []) + (["muslims"] if rng.random() < (0.7 if bad else 0.1) else [])
        rows.append((i, " ".join(words)))
        marks.append((i, 1, bad))
    texts, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    neutral, other, plain = (f"word1 word2 word3 {w} word4 word5".encode() for w in ("muslims", "christians", "word6"))
    gaps = {}
    for penalty in (0.0, 20.0):
        monkeypatch.setattr(toxicity, "PENALTY", penalty)
        a, b, c = toxicity.fit(texts, labels).score([neutral, other, plain])
        gaps[penalty] = a - b, a - c
    assert gaps[0.0][0] > 0.3
    assert abs(gaps[20.0][0]) < 0.1 * gaps[0.0][0]
    assert gaps[20.0][1] < 0.7 * gaps[0.0][1]


def test_feature_counts_do_not_depend_on_partitions(spark):
    """A word as frequent in clean texts as in toxic ones is no feature, however the rows are dealt out."""
    rows = [(i, f"{'vile ' if i % 20 == 0 else 'plain '}{'common' if i // 20 % 2 == i % 2 else 'rare'} word{i}") for i in range(160)]
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(160)], "doc_id long, toxic int")
    few, many = (toxicity.fit(spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "doc_id long, text string"), labels).wanted for n in (1, 16))
    assert few[toxicity.term_features("vile")].any() and not few[toxicity.term_features("common")].any()
    assert (few == many).all()

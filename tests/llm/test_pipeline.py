"""The stages of the pipeline against plain versions."""

import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagewright.llm import jaccard, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return Fraction(len(a & b), len(a | b)) if a | b else Fraction(1)


def plain_groups(texts, least=Fraction(4, 5)):
    """For each text the least position that similarities connect with it."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= least and root[i] != root[j]:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return root


def near_texts(seed=5):
    """Texts and copies with a few words replaced, at similarities about 0.8, and odd ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        own = [rng.choice(words) for _ in range(rng.choice([9, 40, 150]))]
        texts.append(" ".join(own))
        for share in (0.005, 0.02, 0.025, 0.03, 0.04, 0.06):
            texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in own) + rng.choice(["", " end", " the end"]))
    texts += [texts[0], texts[1].upper(), "a b c d e f g h", "a b c d e f g h i", "one two", "One  two", "", "  ", "x y z x y z " * 40, "x y z x y z " * 4]
    return texts


def test_near_duplicates_are_decided_by_exact_similarity(spark):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    root = plain_groups(texts)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == set(root)
    # as many shingles a task as make blocks of most groups
    columns = [jaccard.near_duplicates(docs, 5, 0.8, 71, 4, block=n) for n in (jaccard.BLOCK, 100)]
    one, many = ({r["key"]: r["component"] for r in c.collect()} for c in columns)
    assert one == many and len(set(one.values())) == len(set(root))


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (None, a), (None, a + " end"), (None, b), (None, b), (7, c), (7, c), (9, c + " end"), (7, a + " end")]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(got, key=str) == sorted([(5, a), (None, b), (7, c)], key=str)


def test_similar_equals_all_pairs():
    rng = np.random.default_rng(6)
    sets = [rng.choice(14, rng.integers(0, 14), replace=False) for _ in range(120)]
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    got = jaccard.similar(np.concatenate(sets), offsets, Fraction(4, 5)).root
    root = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if similarity(set(sets[i].tolist()), set(sets[j].tolist())) >= Fraction(4, 5):
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    assert (got == root).all()


@pytest.mark.parametrize("languages", [["en"], ["en", "fr"], ["de", "en", "es", "fr"]])
def test_language_stage_rejects_gibberish_alone(spark, languages):
    rng = random.Random(7)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("lang").isin(languages))
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(n)) for n in (5, 50, 500) * 20]
    junk += ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "Все люди рождаются свободными и равными"]
    rows = [(1_000_000 + i, t, "en" if i % 20 == 0 else None, "x", len(t)) for i, t in enumerate(junk)]
    planted = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, planted, "").select("doc_id").collect()}
    assert not {i for i in kept if i >= 1_000_000}
    gone = docs.filter(~F.col("doc_id").isin(sorted(kept))).collect()
    assert not gone, gone


def test_run_equals_plain_stages(spark, tmp_path):
    rng = random.Random(11)
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en' and n_chars between 800 and 3000").orderBy("doc_id").limit(60).collect()]
    pages = [f"Welcome to the site\n{t}" for t in real[:25]]
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(60)) for _ in range(3)]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(pages)]
    rows += [(100 + i, t, "en", f"s{i}", 0) for i, t in enumerate(real[25:])]
    rows += [(200 + i, t, None, f"j{i}", 0) for i, t in enumerate(junk)]
    rows += [(300, real[30], "en", "b", 0), (301, real[31] + " and more", "en", "b", 0), (None, real[32], "en", "b", 0), (None, real[33] + " this stays out", "en", "b", 0), (302, None, "en", "b", 0)]
    schema = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").schema
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    # plain: gibberish and null go by number; the header goes from host a alone, as do its lines of more than a tenth of 25 pages
    left = [(i, t, h) for i, t, _, h, _ in rows if t is not None and not (i or 0) in range(200, 203)]
    own = [t for _, t, h in left if h == "a"]
    often = {x.strip() for t in own for x in t.split("\n") if x.strip() and sum(x.strip() in {y.strip() for y in u.split("\n")} for u in set(own)) > 0.1 * len(set(own))}
    assert "Welcome to the site" in often
    cleaned = [(i, "\n".join(x for x in t.split("\n") if h != "a" or x.strip() not in often)) for i, t, h in left]
    root = plain_groups([t for _, t in cleaned])
    want = {}
    for r in set(root):
        i, t = min((c for c, x in zip(cleaned, root, strict=True) if x == r), key=lambda c: (c[0] is None, c[0] or 0))
        want[i] = t
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == sizes


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, __key long, __id string, n_lines int, host string"


def test_stages_keep_further_columns(spark):
    rng = random.Random(12)
    words = {"en": [f"the{i} and{i} of" for i in range(60)], "de": [f"der{i} und{i} von" for i in range(60)]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, "Head\n" + text(lang, 40), lang, "a", 0, 1.5, "x", 7, "k", 3, "h") for i, lang in enumerate(["en", "de"] * 20)]
    rows += [(100, text("en", 40_000), "en", "b", 0, 1.5, "x", 7, "k", 3, "h"), (None, text("de", 30), "de", None, 0, 1.5, "x", 7, "k", 3, "h"), (3, rows[3][1], *rows[3][2:]), (101, "", None, None, 0, None, None, None, None, None, None), (102, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), "")
        assert none.count() == 0, name
        left = stage(spark, docs, "").collect()
        assert left, name
        if name != "packing":
            assert none.columns == docs.columns, name
            docs = spark.createDataFrame(left, SCHEMA)
            assert all(r["score"] == 1.5 and r["__key"] == 7 and r["n_lines"] == 3 for r in left), name
            ids = [r["doc_id"] for r in left]
            assert 102 not in ids and 101 not in ids and 100 in ids and None in ids and ids.count(3) == (2 if name != "near_duplicates" else 1)
            if name == "lines":
                assert not any("Head" in r["text"] for r in left)


def test_near_copies_are_found(spark):
    """Recall of pairs by their exact similarity, on copies with words replaced in whole real texts."""
    rng = random.Random(13)
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars between 400 and 6000").orderBy("doc_id").limit(200).collect()]
    real = list(dict.fromkeys(real))
    copies = []
    for t in real:
        w = t.split(" ")
        for at in rng.sample(range(len(w)), max(1, len(w) // 60)):
            w[at] = "changed"
        copies.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(real + copies)], "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    root = plain_groups(real + copies)
    assert kept == set(root)
    near = [i for i, t in enumerate(real) if similarity(shingles(t), shingles(copies[i])) >= Fraction(4, 5)]
    assert len(near) > 100 and all(len(real) + i not in kept for i in near)


def test_short_texts_at_the_least_similarity_are_linked(spark):
    """Pairs of similarity 4/5 whose 256-bit fingerprints differ in 73 to 76 bits: a radius of 71 lost them."""
    texts = [" ".join(f"w{i}x{k}" for k in range(8)) + end for i in (37800, 64529, 6750, 12109, 1663) for end in ("", " end")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 4, 6, 8]


def test_texts_with_a_common_passage_alone_are_no_candidates(spark):
    """Nothing is compared for them, however many they are; their one near copy is found."""
    passage = " ".join(f"p{k}" for k in range(20))
    texts = [f"{passage} " + " ".join(f"t{i}x{k}" for k in range(60)) for i in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[7] + " end"])], "key long, text string")
    assert {frozenset((r["a"], r["b"])) for r in jaccard.candidates(rows, 5, Fraction(4, 5)).collect()} == {frozenset((7, 400))}  # from each of their shingles' buckets


def test_candidates_of_a_shingle_equal_all_pairs():
    rng = np.random.default_rng(14)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        shingles, sizes = rng.integers(-2, 2, n), rng.integers(1, 40, n)
        partners = sizes * rng.integers(80, 126, n) // 100
        forest = simhash.Forest(n)
        forest.join(*jaccard._candidates(shingles, sizes, partners))
        root = np.arange(n)
        for i in range(n):
            for j in range(i):
                if shingles[i] == shingles[j] and sizes[i] <= partners[j] and sizes[j] <= partners[i] and root[i] != root[j]:
                    root[root == max(root[i], root[j])] = min(root[i], root[j])
        assert (forest.root == root).all()

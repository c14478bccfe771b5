"""The operators against the libraries, brute force, and odd input."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm import ann, bytepair, langid, licences, linedup, packing, polyhash, prefixcount, simhash, warc
from pagewright.llm.queries import ORACLES, QUERIES

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "   ", "Hello  world, it's\n\n fine.\n", "don't WE'LL 日本語 é　x  y", "x<|endoftext|>y", "a" * 5000, "the cat sat on the mat again and again " * 300, "the cat sat on the mat again and again " * 300, "!!!\t\t  --- ===", "Straße ΣΑΣ İ ½ ²"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", None if i == 3 else "s", -1) for i, t in enumerate(TEXTS)] + [(None, "no id", None, "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id > 1000")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_equals_the_library(docs, empty):
    tok = Tokenizer.from_file(BYTE)
    got = by_id(bytepair.bpe_digest(docs, BYTE))
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bytepair.bpe_digest(empty, BYTE).count() == 0
    back = by_id(bytepair.bpe_decode(bytepair.bpe_encode(docs, BYTE), BYTE))
    assert all(back[i]["text"] == (t or "") for i, t in enumerate(TEXTS))


def test_token_counts_at_every_prefix(docs, empty):
    tok = Tokenizer.from_file(BYTE)
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    got = by_id(prefixcount.token_counts(docs, BYTE, 10))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len(raw), count(t or ""))
        assert got[i]["over_limit"] == (got[i]["n_tokens"] > 10)
        assert count(raw[: got[i]["cut_bytes"]].decode()) <= 10
    table = prefixcount.counter(BYTE)
    for t in ["I'll  we've\n\n x'l", "éa 日本 　 b", "a<|endoftext|> ''re"]:
        held = table.prefixes(t.encode())
        assert [held.count(len(t[:i].encode())) for i in range(len(t) + 1)] == [count(t[:i]) for i in range(len(t) + 1)]
    assert prefixcount.token_counts(empty, BYTE).count() == 0


def test_longest_common_extension():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(2))
        i, j, k = rng.randint(0, len(a)), rng.randint(0, len(b)), 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert polyhash.PrefixHash(a).common(polyhash.PrefixHash(b), i, j) == k
    long = polyhash.PrefixHash("xyz" * 50_000)
    assert long.span(0, 6) == long.span(65_535, 65_541) and len(np.concatenate(list(long.windows(6)))) == 149_995


def test_fingerprints_follow_the_next_document(docs, empty, spark):
    got = by_id(polyhash.edit_fingerprints(docs))
    order = [*range(len(TEXTS) - 1, -1, -1), None]
    text = lambda i: "no id" if i is None else TEXTS[i] or ""
    for at, i in enumerate(order):
        own, after = text(i), text(order[(at + 1) % len(order)])
        new = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest(), i
        assert got[i]["n_chars"] == len(own) and 0 <= got[i]["near_edited"] <= 1
    assert got[7]["fingerprint"] == got[8]["fingerprint"] and got[8]["near_next"] == 1
    assert len({r["fingerprint"] for r in got.values()}) == len({text(i) for i in order})
    assert polyhash.edit_fingerprints(empty).count() == 0
    assert polyhash.edit_fingerprints(docs.filter("doc_id = 3")).count() == 1


def test_packing_is_gapless_and_exact(docs, empty):
    tok = Tokenizer.from_file(WORD)
    rows = packing.pack(docs, WORD, capacity=256).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)} | {None: [*tok.encode("no id", add_special_tokens=False).ids, 1]}
    for i, own in ids.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(np.array(own[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(own)
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert packing.pack(empty, WORD).count() == 0


def test_simhash_equals_brute_force(spark, empty):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(60)]
    texts += [t.replace("w1", "W1", 1) + " end" for t in texts[:20]] + texts[:5] + [None, "", " \t ", "one two"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]

    def reference(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        return sum((sum(x >> k & 1 for x in h) * 2 > len(h)) << k for k in range(64)) if h else 0

    marks = {i: reference(t) for i, t in rows}
    parent = {i: i for i in marks}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in marks:
        for b in marks:
            if a < b and (marks[a] ^ marks[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = by_id(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("hex", simhash.hex_fingerprint(F.col("fp"))))
    assert {i: r["hex"] for i, r in got.items()} == {i: f"{m:016x}" for i, m in marks.items()}
    assert {i: r["component_id"] for i, r in got.items()} == {i: root(i) for i in marks}
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("words", "radius"), [(1, 4), (1, 20), (4, 46)])
def test_tiles_equal_all_pairs(words, radius):
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2**63, (700, words), dtype=np.uint64)
    rows[300:400, 0] = rows[:100, 0] ^ np.uint64(7)
    forest, plain = simhash.Forest(700), simhash.Forest(700)
    simhash.link_tiles(rows[:350], rows[350:], radius, forest)
    for part, base in ((rows[:350], 0), (rows[350:], 350)):
        own = simhash.Forest(350)
        simhash.link_tiles(part, None, radius, own)
        forest.join(np.arange(350) + base, own.root + base)
    for i in range(700):
        near = np.flatnonzero(np.bitwise_count(rows[i] ^ rows).sum(1, dtype=int) <= radius)
        plain.join(np.full(len(near), i), near)
    assert (forest.root == plain.root).all()
    tree = simhash.Forest(700)
    tree.join(*forest.trees())
    assert (tree.root == plain.root).all()


def test_neighbours_have_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16))
    x[200:260] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (None, x[0].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    hits = 0
    for q in range(0, 1500, 20):
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in own["vec_id"].tolist()
        assert np.allclose(own["score"], x[own["vec_id"]] @ x[q], rtol=0, atol=1e-12)
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(1500), -score))[:20]) & set(own["vec_id"]))
    assert hits / (75 * 20) >= 0.9
    assert set(got["query_id"]) == set(range(0, 1500, 20))
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language(docs, empty, spark):
    model = langid.train(docs)
    got = by_id(langid.identify(docs, model))
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 9)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(docs, langid.train(empty)).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op5_language"](spark, "/root/testdata/sf0.01").filter("held_out").join(table, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.97


def test_lines_of_a_host(spark, empty):
    rows = [(i, f"Header \nbody {i}\n\nlast {i}", "a", "kept") for i in range(30)] + [(100 + i, "same\nwhole", "a", "kept") for i in range(30)] + [(200, None, "a", "kept"), (201, "Header", None, "kept"), (202, "", "a", "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lines string")
    for limit in (linedup.BROADCAST_LINES, 0):
        got = by_id(linedup.drop_boilerplate(df, counters=True, broadcast_lines=limit))
        assert got[3]["text"] == "body 3\n\nlast 3" and got[3]["n_dropped"] == 1 and got[3]["lines"] == "kept"
        assert got[105]["text"] == "same\nwhole"  # copies do not make their own lines boilerplate
        assert got[200]["text"] is None and got[201]["text"] == "Header" and got[202]["text"] == ""
    assert linedup.drop_boilerplate(empty).count() == 0


def test_licences(spark, empty):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    rows = [(1, "Text. Released under the MIT License.\nMore"), (2, mit), (3, None), (4, "released under the mit licence"), (5, "All rights reserved.\n* Licensed under CC BY-NC 4.0.")]
    got = by_id(licences.recognise(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i]["licence"] for i in range(1, 6)] == ["MIT", "MIT", None, None, "CC-BY-NC-4.0"]
    assert got[2]["rule"] == 2 and got[5]["sentence_ids"] == "all-rights,cc-by-nc-4"
    assert licences.recognise(empty).count() == 0


def test_revisits(spark):
    schema = "record_id long, warc_type string, url string, ts long, etag string, last_modified string, headers map<string,string>"
    rows = [
        (1, "response", "http://www.E.test/a/", 10, '"x"', None, {"ETag": '"x"', "Content-Length": "5"}),
        (2, "revisit", "https://e.test/a?utm_source=q#f", 20, 'W/"x"', None, {"Date": "d", "Content-Length": "0"}),
        (3, "response", "https://e.test/a", 30, '"y"', "m", None),
        (4, "revisit", "https://e.test/a", 40, '"x"', None, None),
        (5, "revisit", "https://e.test/a", 41, None, "m", None),
        (6, "revisit", "https://e.test/b", 50, '"x"', None, None),
        (7, "revisit", None, 50, '"x"', None, None),
        (8, "revisit", "https://e.test/a", 42, None, None, None),
        (9, "revisit", "https://e.test/a", 5, '"x"', None, None),
    ]
    for ranges in (1, 4):
        got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, schema), ranges).collect()}
        assert {i: (r["refers_to"], r["status"]) for i, r in got.items()} == {2: (1, "resolved"), 4: (3, "validator_mismatch"), 5: (3, "resolved"), 6: (None, "no_original"), 7: (None, "incomplete"), 8: (3, "no_validator"), 9: (None, "no_original")}
        assert got[2]["headers"] == {"ETag": '"x"', "Content-Length": "5", "Date": "d"}
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_warc_round_trip(tmp_path, spark):
    body = b"HTTP/1.1 200 OK\r\nETag: \"x\"\r\nX-Long: a\r\n b\r\n\r\npayload"
    data = b"".join(warc.write_record("response", f"http://e.test/{i}", "2024-01-01T00:00:00Z", f"<urn:{i}>", body) for i in range(3))
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(b"junk")
    (tmp_path / "c.warc").write_bytes(b"")
    for recover in (False, True):
        _round_trip(warc.read_warc(spark, str(tmp_path), recover).collect())


def _round_trip(rows):
    good = [r for r in rows if r["warc_type"] == "response"]
    assert [r["record_id"] for r in good] == ["<urn:0>", "<urn:1>", "<urn:2>"] and [r["warc_type"] for r in rows].count("broken") == 1
    assert bytes(good[0]["payload"]) == b"payload" and good[0]["etag"] == '"x"' and good[0]["headers"]["x-long"] == "a b"


@pytest.mark.parametrize("name", ORACLES)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    rel = con.sql(ORACLES[name])
    columns = sorted(rel.columns)
    want = sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()))
    got = sorted(repr(tuple(r)) for r in QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns).collect())
    assert got == want


@pytest.mark.parametrize("radius", [4, 14])
def test_groups_over_many_tiles_equal_one_tile(spark, radius, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    base = " ".join(rng.choice(words) for _ in range(120))
    texts = [f"{base} tail{i} {rng.choice(words)}" for i in range(150)] + [" ".join(rng.choice(words) for _ in range(60)) for _ in range(100)]
    docs = spark.createDataFrame([(None if i % 50 == 7 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    take = lambda: sorted((str(r["doc_id"]), tuple(r["fp"]), r["component_id"]) for r in simhash.near_duplicates(docs, radius=radius).collect())
    whole = take()
    monkeypatch.setattr(simhash, "LEAST_TILE", 4)
    monkeypatch.setattr(simhash, "TILES", 40)
    assert take() == whole


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 8))
    one_id = [(40, v.tolist()) for v in rng.standard_normal((200, 8))]  # unequal vectors of one id
    short = [(100 + i, v.tolist()) for i, v in enumerate(rng.standard_normal((7, 3)))]  # another length, fewer than k
    rows = [(i, v.tolist(), -1.0, 7) for i, v in enumerate(x) if i != 40] + [(i, v, -1.0, 7) for i, v in one_id + short] + [(20, x[20].tolist(), 0.0, 1)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, rank int")).toPandas()
    assert set(got["query_id"]) == {0, 20, 40, 100}
    assert sorted(got.loc[got["query_id"] == 100, "vec_id"]) == list(range(101, 107))
    assert (got["query_id"] == 40).sum() == 200 * 20 and not ((got["query_id"] == 40) & (got["vec_id"] == 40)).any()
    assert (got["query_id"] == 20).sum() == 20 and 20 not in set(got.loc[got["query_id"] == 20, "vec_id"])  # a repeated row asks once
    zero = got[got["query_id"] == 0].sort_values("rank")
    table = [(i, np.array(v) @ x[0]) for i, v, *_ in rows if i != 0 and len(v) == 8]
    best = sorted(table, key=lambda t: (-t[1], t[0]))[:20]
    assert zero["vec_id"].tolist() == [i for i, _ in best]


def test_neighbours_in_many_small_tasks(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 24)) * 3
    x = centres[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 24))
    x[1000:2000] = x[7]  # a third of all rows is one vector
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.search(frame, group_bytes=200 * 8 * 25).toPandas()
    hits = 0
    for q in range(0, 3000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(3000), -np.round(score, 9)))[:20]
        own = got[got["query_id"] == q].sort_values("rank")
        assert len(own) == 20 and np.allclose(own["score"], x[own["vec_id"]] @ x[q], rtol=0, atol=1e-9)
        hits += np.isclose(np.sort(own["score"]), np.sort(score[best]), atol=1e-9).sum()
    assert hits / (150 * 20) >= 0.9


def test_components_of_long_paths(spark):
    rng = random.Random(4)
    n = 600
    names = list(range(n))
    rng.shuffle(names)  # a path in any order, a star, two nodes, and a loop
    links = [(names[i], names[i + 1]) for i in range(n - 1)] + [(n, n + 1 + i) for i in range(500)] + [(9001, 9000), (9000, 9001), (9002, 9002)]
    edges = spark.createDataFrame([([a], [b]) for a, b in links], "a array<bigint>, b array<bigint>")
    values = spark.createDataFrame([([i], None if i == 0 else i) for i in [*range(n + 501), 9000, 9001, 9002]], "fp array<bigint>, value long")
    got = {r["fp"][0]: r["component"] for r in simhash.components(edges, values).collect()}
    assert got == {**{i: 1 for i in range(n)}, **{n + i: n for i in range(501)}, 9000: 9000, 9001: 9000}


def test_fingerprints_of_one_id_and_one_text(spark):
    rows = [(None, "same"), (5, "same"), (5, "other")] * 400 + [(None, f"none {i}") for i in range(300)] + [(9, "last text")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(4)
    parts = polyhash.with_next(frame.coalesce(4)).filter("not ghost").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 900
    got = polyhash.edit_fingerprints(frame.coalesce(4)).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(i), len(t)) for i, t in rows)
    # in a ring every document is the next of one: halves of "same" are joined to the start of what follows
    edits = [r["edited_sha256"] for r in got if r["doc_id"] == 9]
    assert edits[0] in {hashlib.sha256(("last " + t[:4]).encode()).hexdigest() for t in ("same", "other")}


def windows(text, width):
    return {text[i : i + width] for i in range(max(1, len(text) - width + 1))}


def test_likeness_follows_true_overlap():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    gaps = {"long": [], "short": []}
    for kind, size in (("long", 400), ("short", 25)):
        for _ in range(120):
            a = " ".join(rng.choice(words) for _ in range(size))
            cut = rng.randint(0, len(a))
            b = a[:cut] + " ".join(rng.choice(words) for _ in range(size))[: len(a) - cut]
            near = polyhash.likeness(*(polyhash.fingerprint(polyhash.PrefixHash(t)) for t in (a, b)))
            x, y = (windows(t, polyhash.COARSE[0] if kind == "long" else polyhash.FINE[0]) for t in (a, b))
            gaps[kind].append(abs(near - 2 * len(x & y) / (len(x) + len(y))))
    for kind, bins in (("long", polyhash.COARSE[1]), ("short", polyhash.FINE[1])):
        # of so many bins the deviation of the share of equal ones is at most half a root
        assert np.mean(gaps[kind]) < 0.75 / np.sqrt(bins) and max(gaps[kind]) < 3 / np.sqrt(bins), (kind, np.mean(gaps[kind]), max(gaps[kind]))


def test_reading_goes_on_after_a_broken_record(tmp_path, spark):
    body = b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1 is a format, \r\nWARC/1.0 was"
    plain = [warc.write_record("response", f"http://e.test/{i}", "2024-01-01T00:00:00Z", f"<urn:{i}>", body, compress=False) for i in range(4)]
    plain[1] = plain[1].replace(b"Content-Length: ", b"Content-Length: x")
    packed = [warc.write_record("response", f"http://e.test/{i}", "2024-01-01T00:00:00Z", f"<urn:{i}>", body) for i in range(4, 8)]
    packed[1] = packed[1][:40] + b"\xff" * 20 + packed[1][60:]
    packed[3] = packed[3][:-20]
    (tmp_path / "a.warc").write_bytes(b"".join(plain))
    assert [r.get("record_id") for r in warc.read_records(b"".join(packed)) if r["warc_type"] == "response"] == ["<urn:4>", "<urn:6>"]
    for recover in (False, True):
        rows = warc.read_warc(spark, str(tmp_path), recover).collect()
        good = sorted((r["record_id"], bytes(r["payload"])) for r in rows if r["warc_type"] == "response")
        assert good == [(f"<urn:{i}>", body.split(b"\r\n\r\n", 1)[1]) for i in (0, 2, 3)] and any(r["warc_type"] == "broken" for r in rows)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(packed))
    assert warc.read_warc(spark, str(tmp_path), recover=True).filter("warc_type = 'response'").count() == 5
    with pytest.raises(Exception):  # noqa: B017
        warc.read_warc(spark, str(tmp_path)).collect()


def test_revisits_of_files(tmp_path, spark):
    page = b'HTTP/1.1 200 OK\r\nETag: "x"\r\nContent-Type: text/html\r\n\r\nhello'
    same = b'HTTP/1.1 304 Not Modified\r\nETag: W/"x"\r\nDate: later\r\n\r\n'
    records = [("response", "2024-01-01T00:00:00Z", page), ("revisit", "2024-01-03T00:00:00Z", same), ("response", "2024-01-02T00:00:00Z", page), ("revisit", "not a time", same)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.write_record(k, "http://e.test/p", t, f"<urn:{i}>", b) for i, (k, t, b) in enumerate(records)))
    found = warc.read_warc(spark, str(tmp_path))
    extra = found.withColumn("canonical_url", F.lit("x")).withColumn("status", F.lit("y")).withColumn("part", F.lit(1)).withColumn("refers_to", F.lit(1))
    for frame in (found, extra, found.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))):
        got = {r["record_id"]: r for r in warc.resolve_revisits(frame).collect()}
        assert (got["<urn:1>"]["refers_to"], got["<urn:1>"]["status"], got["<urn:3>"]["status"]) == ("<urn:2>", "resolved", "incomplete")
        assert got["<urn:1>"]["headers"] == {"content-type": "text/html", "etag": 'W/"x"', "date": "later"}
    twice = warc.resolve_revisits(found.unionByName(found)).collect()
    assert len(twice) == 4 and {r["refers_to"] for r in twice} == {"<urn:2>", None}


def plain_language(text, counts, grams, languages, least=3):
    """The score of a text, word by word, from counts by language."""
    import math

    def shares(scores):
        top = max(scores)
        total = math.log(sum(math.exp(x - top) for x in scores)) + top
        return [x - total for x in scores]

    def logs(table, kinds, key):
        return [math.log(table.get(key, {}).get(x, 0) + 0.5) - math.log(sum(t.get(x, 0) for t in table.values()) + 0.5 * kinds) for x in languages]

    known = {w: c for w, c in counts.items() if sum(c.values()) >= least}
    words = regex.findall(r"\p{L}+", text.lower())
    total = [0.0] * len(languages)
    for w in words:
        own = None
        if w in known:
            own = shares(logs(known, len(known), w))
        else:
            framed = f"^{w}$"
            for size in (4, 3, 2, 1):
                parts = [framed[i : i + size] for i in range(len(framed) - size + 1)]
                found = [logs(grams[size], len(grams[size]), g) for g in parts if g in grams[size]]
                if found:
                    own = shares([sum(x) / len(found) for x in zip(*found, strict=True)])
                    break
        total = [a + b for a, b in zip(total, own or [0.0] * len(languages), strict=True)]
    if not words:
        return "und", 0.0
    scaled = shares([x * min(1.0, 10 / len(words)) for x in total])
    best = max(range(len(languages)), key=lambda i: (scaled[i], -i))
    return languages[best], math.exp(scaled[best])


def test_language_equals_a_plain_scorer(spark, monkeypatch):
    rng = random.Random(3)
    stems = {"en": ["the", "house", "river", "with", "along"], "de": ["der", "haus", "fluss", "mit", "entlang"], "xx": ["ђ", "ж"]}
    text = lambda lang: " ".join(rng.choice(stems[lang]) + rng.choice(["", "", "s", "en", "x"]) for _ in range(rng.randint(1, 12)))
    labelled = [(i if i % 9 else None, text(lang), lang) for i, lang in enumerate(["en", "de", "xx"] * 40)]
    counts, grams = {}, {n: {} for n in (1, 2, 3, 4)}
    for _, t, lang in labelled:
        for w in t.lower().split():
            counts.setdefault(w, {}).setdefault(lang, 0)
            counts[w][lang] += 1
            framed = f"^{w}$"
            for n, table in grams.items():
                for i in range(len(framed) - n + 1):
                    held = table.setdefault(framed[i : i + n], {})
                    held[lang] = held.get(lang, 0) + 1
    model = langid.train(spark.createDataFrame(labelled + labelled[:30] * 5, "doc_id long, text string, lang string"))  # a repeated row counts once
    asked = [text(lang) for lang in stems for _ in range(20)] + ["riverhouse flussen", "qqq", "123", "", "ж " * 500, "the " * 400 + "mit"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)] + [(999, None)], "doc_id long, text string")
    for limit in (langid.CACHE_WORDS, 7):  # a cache of a few words gives the same
        monkeypatch.setattr(langid, "UNFOLDED", 0 if limit == 7 else langid.UNFOLDED)
        scorer = langid.Scorer(model, limit)
        langs, scores = scorer.classify([langid.words_of(t.encode()) for t in asked])
        for t, lang, score in zip(asked, langs, scores, strict=True):
            want = plain_language(t, counts, grams, sorted(stems))
            assert abs(want[1] - score) < 1e-9 and (lang == want[0] or abs(score - 1 / 3) < 1e-9), t
    got = by_id(langid.identify(docs, model, fluency=True, prefix="x_"))
    assert [got[i]["x_lang_pred"] for i in range(len(asked))] == langs and got[999]["x_lang_pred"] == "und" and got[999]["x_fluency"] is None
    with pytest.raises(ValueError):
        langid.identify(docs.withColumn("score", F.lit(1)), model, keep=("score",))


def test_many_labels_are_all_kept(spark):
    rows = [(i, f"{chr(97 + i // 26)}{chr(97 + i % 26)}zu" * 2, f"l{i:03}") for i in range(400) for _ in range(2)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=1000)
    assert len(model.languages) == 400
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    nameless = spark.createDataFrame([(None, letters(i), "a") for i in range(3000)], "doc_id long, text string, lang string")
    few = langid.train(nameless, rows_per_language=100, least_count=1)
    assert 60 < len(few.words.rows) < 150  # rows without an id are sampled like others

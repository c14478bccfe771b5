"""Odd input of the operators: clashing columns, very long texts, repeated rows, ids from nowhere."""

import public_tokenizers
from pyspark.sql import functions as F

from pagewright.llm import bytepair, linedup, simhash, warc

BYTE = public_tokenizers.path("byte_bpe_50k.json")
LONG = "the long river runs along the old town and " * 40_000  # 1.7 MB


def test_ids_from_nowhere(spark):
    rows = [(1, [0, -1, 10**9, 2**40, None, 5]), (2, None), (3, []), (None, [0])]
    got = {r["doc_id"]: r["text"] for r in bytepair.bpe_decode(spark.createDataFrame(rows, "doc_id long, ids array<bigint>"), BYTE).collect()}
    assert got[2] == got[3] == "" and len(got[1]) == 2 and got[None] == got[1][0]


def test_near_duplicates_with_clashing_columns(spark):
    names = ["fp", "value", "component_id", "root", "tile", "weight", "pair", "a", "b"]
    rows = [(1, LONG), (2, LONG + "end"), (3, "other words here and there " * 30), (3, "other words here and there " * 30), (None, LONG), (4, None), (5, " ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in names:
        frame = frame.withColumn(name, F.lit(9))
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.near_duplicates(frame).collect())
    assert got == [("1", 1), ("2", 1), ("3", 3), ("3", 3), ("4", 4), ("5", 4), ("None", 1)]


def test_lines_with_clashing_columns_and_long_texts(spark):
    names = ["__host", "__known", "__salt", "__part", "__hit", "n_lines", "N_Dropped", "host", "page", "lines", "n"]
    rows = [(i, f"Top\nown {i}\n" + (LONG if i == 0 else ""), "h") for i in range(4)] + [(9, "Top\nown", "small"), (9, "Top\nown", "small")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in names:
        frame = frame.withColumn(name, F.lit("kept"))
    for limit in (linedup.BROADCAST_LINES, 0):
        out = linedup.drop_boilerplate(frame, counters=True, broadcast_lines=limit)
        assert out.columns == [*frame.columns, "_n_lines", "_n_dropped"]
        got = {r["doc_id"]: r for r in out.collect()}
        assert got[1]["text"] == "own 1\n" and got[1]["_n_dropped"] == 1 and got[0]["text"].endswith(LONG) and got[9]["text"] == "Top\nown"
        assert all(got[1][c] == "kept" for c in names)
    # counted by rows, three copies make their own lines boilerplate
    copies = spark.createDataFrame([(i, "a\nb", "h") for i in range(3)], "doc_id long, text string, source string")
    assert {r["text"] for r in linedup.drop_boilerplate(copies, distinct_pages=False).collect()} == {""}
    assert {r["text"] for r in linedup.drop_boilerplate(copies).collect()} == {"a\nb"}


def test_a_url_with_most_records(spark):
    n = 3000
    records = [(i, "revisit" if i % 3 else "response", "http://hot.test/x" if i % 4 else f"http://e.test/{i}", i // 2, '"t"', None, {"Date": str(i)}) for i in range(n)]
    frame = spark.createDataFrame(records, "record_id long, warc_type string, url string, ts long, etag string, last_modified string, headers map<string,string>")
    got = {r["record_id"]: r["refers_to"] for r in warc.resolve_revisits(frame, 7).collect()}
    last, want = {}, {}
    for i, kind, url, *_ in records:  # of records of one time the lower id is the earlier
        if kind == "response":
            last[url] = i
        else:
            want[i] = last.get(url)
    assert got == want


def test_position_is_a_binary_search(spark):
    import bisect

    from pagewright.llm._scratch import position

    points = [-5.0, 0.0, 0.5, 7.0, 7.5]
    values = [-9.0, -5.0, -4.9, 0.0, 0.2, 0.5, 6.0, 7.0, 7.2, 7.5, 99.0]
    for n in range(len(points) + 1):
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        got = {r["v"]: r["p"] for r in frame.select("v", position(F.col("v"), points[:n], "double").alias("p")).collect()}
        assert got == {v: bisect.bisect_left(points[:n], v) for v in values}
    many = list(range(0, 20_000, 2))
    frame = spark.range(0, 20_001, 137).select("id", position(F.struct(F.col("id").alias("i")), [{"i": x} for x in many], "struct<i:bigint>").alias("p"))
    assert all(r["p"] == bisect.bisect_left(many, r["id"]) for r in frame.collect())

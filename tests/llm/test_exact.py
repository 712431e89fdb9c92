import hashlib
import random

from pyspark.sql import functions as F

from fleetspectra.llm import exact

BLANKS = str.maketrans("", "", " \t\n\x0b\x0c\r")


def plain(rows):
    """(doc_id, text) rows -> per row the id that stays, the size of its group, whether it stays, the digest."""
    groups = {}
    for n, (doc_id, text) in enumerate(rows):
        groups.setdefault((text or "").translate(BLANKS), []).append((-len(text or ""), doc_id is None, doc_id or 0, n))
    out = []
    for n, (doc_id, text) in enumerate(rows):
        content = (text or "").translate(BLANKS)
        best = min(groups[content])
        digest = hashlib.sha256(content.encode()).hexdigest()
        out.append((doc_id, None if best[1] else best[2], len(groups[content]), best[3] == n, digest))
    return sorted(out, key=str)


def run(df, **bounds):
    found = exact.exact_duplicates(df, **bounds).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_equal_to_brute_force_with_small_tables(spark):
    """Copies of a third of all rows, near copies, and bounds so small that tables are handed on and buckets dealt again."""
    dice = random.Random(7)
    texts = [" ".join(dice.choice("abcdef") * dice.randint(1, 4) for _ in range(dice.randint(0, 40))) for _ in range(150)]
    rows = [(n, dice.choice(texts)) for n in range(600)] + [(n, "same\ttext " * 50 + " " * (n % 7)) for n in range(600, 900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = run(df)
    assert got == plain(rows)
    assert run(df, bucket_bytes=64, task_bytes=128) == got


def test_buckets_are_dealt_until_they_fit(spark):
    rows = [(h << 44, 60) for h in range(200)] + [(-1, 60)] * 40
    leaders = spark.createDataFrame(rows, "h bigint, n_bytes bigint")
    dealt = exact.bucketed(leaders, 100).groupBy("bucket").agg(F.sum("n_bytes").alias("held"), F.count_distinct("h").alias("n")).collect()
    assert all(r.held <= 100 or r.n == 1 for r in dealt) and sum(r.held for r in dealt) == 60 * 240


def test_table_compares_contents_and_not_hashes():
    table = exact.Contents(4)
    names = [table.place(5, b"a"), table.place(5, b"b"), table.place(5, b"a"), *[table.place(5, bytes([c])) for c in range(99, 120)]]
    assert names[:3] == [0, 1, 0] and names[3:] == list(range(2, 23)) and table.place(5, b"b") == 1


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((r[0], r[1], r[2], r[4]) for r in run(odd) if r[0]) == sorted((r[0], r[1], r[2], r[4]) for r in plain(rows) if r[0])
    assert sum(r[3] for r in run(odd)) == len({(t or "").translate(BLANKS) for _, t in rows})
    assert run(none) == []
    kept = exact.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({(t or "").translate(BLANKS) for _, t in rows})
    assert exact.keep_one(none).count() == 0


def test_text_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([("b", "x y", 1, 2, "c"), ("a", "xy ", 3, 4, "d"), ("a", "z", 5, 6, "e")], "doc_id string, text string, row int, kept int, content string")
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(df).collect()} == {("b", "a", 2, False), ("a", "a", 2, True), ("a", "a", 1, True)}
    assert sorted((r.doc_id, r.row, r.kept, r.content) for r in exact.keep_one(df).collect()) == [("a", 3, 4, "d"), ("a", 5, 6, "e")]

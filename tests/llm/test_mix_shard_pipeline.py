import os
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetspectra.llm import mixing, sharding
from fleetspectra.llm.queries import QUERIES


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, total = {}, sum(sizes.values())
    open_ = set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not above:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in above}
        open_ -= above
    return target


def test_mix_meets_its_targets(spark, sf, documents):
    got = QUERIES["op1_mix_sources"](spark, sf).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in documents}
    sizes = {}
    for r in documents:
        sizes[r.source] = sizes.get(r.source, 0) + size[r.doc_id]
    want = plain_targets(sizes)
    source = {r.doc_id: r.source for r in documents}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s]) and r.target == pytest.approx(want[s])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert len(got) == len(documents)
    for s, words in taken.items():
        assert abs(words - want[s]) <= max(20, 0.05 * want[s])  # sources of about ten documents
    assert sorted(got) == sorted(QUERIES["op1_mix_sources"](spark, sf).collect())


def test_targets_stop_at_three_times_a_source(spark):
    rows = [("a", 10, 1), ("b", 1000, 1), ("c", 1, 1), (None, 400, 2), ("d", 0, 1)]
    df = spark.createDataFrame(rows, "source string, source_size bigint, n_docs bigint")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets({r[0]: r[1] for r in rows}))


def test_many_blocks_meet_the_target_too(spark):
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"),
    )
    for blocks in (20_000, 40):
        got = mixing.mix(docs, block_rows=blocks, fan_in=5)
        off = got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w")).collect()
        assert got.count() == 5000 and all(abs(r.t - r.w) <= 50 for r in off)


def test_mix_with_odd_rows(odd, none):
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    plan = mixing.mix(odd).agg(F.sum("copies")).first()[0]
    mixed = mixing.mixed(odd)
    assert mixed.count() == plan and mixed.columns == odd.columns and mixing.mixed(none).count() == 0


def test_shards(spark, sf, documents):
    got = QUERIES["op9_shard"](spark, sf).collect()
    text = {r.doc_id: (r.text or "").encode() for r in documents}
    load, places = [0] * 40, {}
    for r in got:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]))
        load[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(documents) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load) - min(load) <= max(r.size for r in got)


def test_map_versions_move_little(spark, tmp_path):
    folder = f"file://{tmp_path}/maps"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    sizes = sharding.slot_sizes(spark, sharding.records(docs, slots=256), 256)
    sharding.store_map(sharding.first_map(spark, 8, 256), folder)
    for n in (8, 9):
        sharding.store_map(sharding.edited(sharding.load_map(spark, folder), sizes, n), folder)
    two, three = sharding.load_map(spark, folder, 2), sharding.load_map(spark, folder)
    assert three.select("version").distinct().collect()[0][0] == 3 and three.count() == 256
    moved = two.alias("a").join(three.alias("b"), "vslot").where("a.shard <> b.shard")
    assert 0 < moved.count() < 256 * 0.3


def test_shards_with_odd_rows(spark, odd, none, tmp_path):
    for k, (docs, carry) in enumerate((d, c) for d in (odd, none) for c in (False, True)):
        got = sharding.shard_records(docs, 4, f"file://{tmp_path}/{k}", carry=carry, slots=64)
        assert got.count() == docs.count()


CLASHING = "doc_id bigint, text string, source string, key string, row int, its string, times int, nth int, size string, shard string, slot string, _key int"


def test_mixed_and_sharded_tables_with_clashing_names_can_be_written(spark, tmp_path):
    """Rows that repeat in id, source and size, and columns named like those used inside or like results."""
    rows = [(n % 5 if n < 40 else n, "w " * (n % 3 + 1), "ab"[n % 2], "k", n, "i", 1, 2, "s", "h", "l", 3) for n in range(60)]
    rows += [(7, "same words here", "c", "k", 1, "i", 1, 2, "s", "h", "l", 3)] * 30 + [(None, None, None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, CLASHING).repartition(4)
    got = mixing.mixed(docs)
    got.write.parquet(f"{tmp_path}/mixed")
    back = spark.read.parquet(f"{tmp_path}/mixed")
    assert back.columns == docs.columns
    plan = mixing.mix(docs).groupBy("source").agg(F.sum("copies").alias("n"), F.sum("taken").alias("words")).collect()
    there = {r.source: (r.n, r.words) for r in back.groupBy("source").agg(F.count("*").alias("n"), F.sum(mixing.word_count()).alias("words")).collect()}
    assert there == {r.source: (r.n, r.words) for r in plan if r.n}
    kept = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in kept for r in back.collect())
    sharding.shard_records(back, 4, f"file://{tmp_path}/maps", carry=True, slots=64).write.parquet(f"{tmp_path}/shards")
    placed = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(str, placed.select("doc_id", "text", "key", "row").collect())) == sorted(map(str, back.select("doc_id", "text", "key", "row").collect()))
    assert dict(placed.dtypes)["shard"] == "int" and len(placed.columns) == len(set(placed.columns))


def test_sharding_is_native(spark, sf):
    plan = QUERIES["op9_shard"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_failed(text):
    words = words_of(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    return len(words) < 10 or 100 * len(inside) > 20 * len(words)


def plain_groups(texts):
    """{id: text} -> {id: smallest id of its group}: five-word shingle sets of Jaccard similarity 0.8 or more."""
    sets = {}
    for i, text in texts.items():
        words = [w.translate(LOWER) for w in words_of(text)]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if (len(a & b) >= 0.8 * len(a | b)) and (a or b) or a == b:
                label[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in ids}


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_pipeline_stage_by_stage(spark, sf, tmp_path):
    """Each stage's rows against a plain computation on that stage's own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = before, docs.collect()
        assert docs.columns[: len(columns)] == columns
    before, after = seen["quality_rules"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert all(r in before for r in after) and not any(plain_failed(r.text) for r in after)
    asked = [r.doc_id for r in before if not plain_failed(r.text) and r.doc_id in labels]
    assert sum((i in kept) == (labels[i] == 1) for i in asked) >= 0.95 * len(asked)

    before, after = seen["near_duplicates"]
    group = plain_groups({r.doc_id: r.text for r in before})
    assert all(r in before for r in after)
    assert sorted(group[r.doc_id] for r in after) == sorted(set(group.values()))  # one of each group

    before, after = seen["decontamination"]
    items = [" " + " ".join(r.text.lower().split()) + " " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in before if any(t in " " + " ".join(r.text.lower().split()) + " " for t in items)}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert holds <= gone and len(gone) <= max(3, 1.5 * len(holds)) and all(r in before for r in after)

    before, after = seen["mixture"]
    sizes = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(words_of(r.text))
    want, taken, times = plain_targets(sizes), {}, Counter(r.doc_id for r in after)
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + len(words_of(r.text))
    most = max(len(words_of(r.text)) for r in before)
    assert all(abs(taken.get(s, 0) - want[s]) <= most for s in sizes) and max(times.values()) <= 3
    assert all(r in before for r in after)

    before, after = seen["shards"]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in after))) == sorted(map(str, map(tuple, before)))
    load, places = Counter(), {}
    for r in after:
        assert r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        load[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load[k] for k in range(40)) <= 4 * max(r.size for r in after)


def test_pipeline_stages_act(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [len(documents)]
    folder = f"{os.environ.get('TMPDIR', '/tmp')}/pipeline-test-{os.getpid()}"
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.mode("overwrite").parquet(f"{folder}/{name}")
        before, docs = docs.columns, spark.read.parquet(f"{folder}/{name}")
        counts.append(docs.count())
        assert docs.columns[: len(before)] == before
    assert counts[0] > counts[1] > counts[2] > counts[3] and counts[4] == counts[5]

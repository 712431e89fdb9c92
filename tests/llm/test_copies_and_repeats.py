import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetspectra.llm import mixing, similar, simhash, suffix
from fleetspectra.llm.common import components
from fleetspectra.llm.queries import QUERIES


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(prints, bits):
    label = list(range(len(prints)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(k) for k in range(len(prints))]


def test_near_duplicates_equal_brute_force(spark, sf, documents):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash"](spark, sf).collect()}
    prints = [slow_print(r.text) for r in documents]
    ids = [r.doc_id for r in documents]
    roots = slow_components(prints, 4)
    least = {}
    for i, k in zip(ids, roots, strict=True):
        least[k] = min(i, least.get(k, i))
    assert got == {i: (f"{p:016x}", least[k]) for i, p, k in zip(ids, prints, roots, strict=True)}


@pytest.mark.parametrize("finer", [False, True])
@pytest.mark.parametrize("cell_rows", [5, 16_384])
def test_links_lose_nothing_and_add_nothing(spark, finer, cell_rows):
    rng = random.Random(4)
    prints = []
    for _ in range(60):
        base = rng.getrandbits(64)
        prints += [base] + [base ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 6))) for _ in range(3)]
    prints = sorted(set(prints))
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    label = {r.node: r.label for r in components(simhash.links(df, 4, cell_rows, finer)).collect()}
    got, want = {}, {}
    for s, k in zip(signed, slow_components(prints, 4), strict=True):
        got.setdefault(label.get(s, s), set()).add(s)
        want.setdefault(k, set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_stars_and_chains(spark):
    links = [(0, k) for k in range(1, 40)] + [(100 + k, 101 + k) for k in range(30)] + [(500, 500)]
    parts = {}
    for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect():
        parts.setdefault(r.label, set()).add(r.node)
    assert sorted(map(len, parts.values())) == [31, 40]


def test_small_tables_are_stored_in_few_files(spark, setting, odd):
    setting("spark.sql.shuffle.partitions", "48")
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    links = spark.createDataFrame([(k, k + 1) for k in range(30)], "a bigint, b bigint")
    assert components(links).rdd.getNumPartitions() == 1
    assert similar.similar_documents(odd).count() == odd.count()
    assert mixing.mix(odd).rdd.getNumPartitions() == 1


def test_a_large_group_of_near_copies_takes_little_memory():
    rng = np.random.default_rng(3)
    wide = np.repeat(rng.integers(0, 1 << 63, (1, similar.LANES)).astype(np.uint64), 4096, 0)
    wide[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 4096).astype(np.uint64)
    cell = pa.table({"fp": np.arange(4096), "home": np.ones(4096, bool), "wide": pa.chunked_array([similar._packed(wide)])})
    parts = similar._Parts(cell)
    tracemalloc.start()
    for one, others in parts.near(similar.bits_at(0.8)):
        parts.join(one, others)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(parts.star()[0]) == 4095
    assert peak < 40e6


def test_keep_one_with_odd_rows(odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == [
        (False, 1, 0), (False, 2, 173_000), (False, 5, 55), (False, 5, 56), (False, 6, 5), (True, 0, 3)
    ]
    assert simhash.keep_one(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def slow_repeats(texts, width):
    seen = {}
    for t in texts:
        for p in range(len(t) - width + 1):
            seen[t[p : p + width]] = seen.get(t[p : p + width], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - width + 1):
            if seen[t[p : p + width]] > 1:
                gone[p : p + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("width", [12, 40, 400])
def test_repeats_equal_brute_force(spark, width):
    rng = random.Random(width)
    alphabet = "abö\n "
    pool = ["".join(rng.choice(alphabet) for _ in range(3 * width)) for _ in range(6)]
    texts = ["", "ab" * width, "a" * (width + 3), pool[0], pool[0]]
    for _ in range(25):
        parts = []
        for _ in range(rng.randint(1, 4)):
            source = rng.choice(pool)
            a = rng.randrange(len(source))
            parts.append(rng.choice([source[a : a + rng.randint(1, 2 * width)], "".join(rng.choice("xyz ") for _ in range(width))]))
        texts.append("".join(parts))
    df = spark.createDataFrame(list(enumerate([None, *texts])), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(df, width=width).collect()}
    want = slow_repeats([(t or "").encode() for t in [None, *texts]], width)
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("copies", [2, 60])
def test_lists_of_runs_do_not_grow_with_copies(spark, monkeypatch, copies):
    """Copies, some with the same id or none, beside texts that share a part of them."""
    rng = random.Random(copies)
    body = "".join(rng.choice("abcdef ") for _ in range(3000))
    part, own = body[700:1300], "".join(rng.choice("uvwxyz ") for _ in range(900))
    rows = [(n % 7 if n % 3 else None, body) for n in range(copies)] + [(100, own[:400] + part + own[400:]), (101, own + "!" * 10), (102, "q" * 300)]
    seen = []
    merged = suffix._merged
    monkeypatch.setattr(suffix, "_merged", lambda rows, width: seen.append(rows.groupBy("h", "size").count()) or merged(rows, width))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in suffix.remove_repeats(df, width=200).collect())
    want = []
    for doc_id, text in rows:
        if text == body:
            want.append((str(doc_id), 3000, 1))
        elif doc_id == 100:
            want.append(("100", 600 + 900, 1))
        else:
            want.append((str(doc_id), 900 if doc_id == 101 else 300 - 0, 1))
    # 100's own text stands in 101 too, cut in two by the part; 102 repeats itself.
    assert [w for w in got if w[0] not in ("100",)] == sorted(w for w in want if w[0] not in ("100",))
    assert [w[1] for w in got if w[0] == "100"] == [1500]
    assert max(r["count"] for r in seen[0].collect()) < 80


def test_repeats_query_and_odd_rows(spark, sf, documents, odd, none):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op4_repeats"](spark, sf).collect()}
    want = slow_repeats([(r.text or "").encode() for r in documents], 400)
    assert got == {r.doc_id: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for r, w in zip(documents, want, strict=True)}
    cut = suffix.remove_repeats(odd)
    assert cut.count() == odd.count() and cut.where("n_removed > 0").select(F.countDistinct("doc_id")).first()[0] == 2
    assert suffix.remove_repeats(none).count() == 0


def five_words(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def edited(rng, words, share):
    """The words with about this share of them replaced, in one run, so that few shingles change."""
    n = max(1, round(len(words) * share))
    at = rng.randrange(len(words) - n)
    return words[:at] + [f"new{rng.getrandbits(40)}" for _ in range(n)] + words[at + n :]


@pytest.mark.parametrize("cell_rows", [7, 16_384])
def test_similar_documents_are_found_and_others_are_not(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(similar.links, "__defaults__", (0.8, cell_rows))
    rng = random.Random(8)
    texts = []
    for k in range(80):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([40, 120, 500]))]
        texts += [words, edited(rng, words, 0.02), edited(rng, words, 0.5)] + [words] * (k % 3)
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    label = {r.doc_id: r.label for r in similar.similar_documents(docs).collect()}
    shingles = [five_words(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            share = len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j])
            if share >= 0.85:
                assert label[i] == label[j]
            if share <= 0.5:
                assert label[i] != label[j]
    kept = {r.doc_id for r in similar.keep_one(docs).collect()}
    first = {}
    for i, x in sorted(label.items(), reverse=True):
        first[x] = i
    assert kept == set(first.values())


def test_wide_fingerprint_takes_the_majority_of_different_shingles():
    one, other = similar.wide_fingerprint("a b c d e f"), similar.wide_fingerprint("A B C D E F a b c d e f")
    assert one.shape == (similar.LANES,) and not similar.wide_fingerprint(" \n").any() and not similar.wide_fingerprint(None).any()
    assert (similar.wide_fingerprint("a b c d e f" + " a b c d e f" * 3) == similar.wide_fingerprint("a b c d e f" * 1 + " a b c d e f" * 9)).all()
    assert (one != other).any() and similar.bits_at(1.0) == 0 < similar.bits_at(0.9) < similar.bits_at(0.8)


def test_similar_with_odd_rows(odd, none):
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns
    prints = {similar.node_of(similar.wide_fingerprint(r.text)) for r in odd.collect()}
    assert kept.count() == len(prints) and similar.similar_documents(odd).count() == odd.count()
    assert similar.keep_one(none).count() == 0 and similar.similar_documents(none).count() == 0


@pytest.mark.parametrize("cell_rows", [40, 16_384])
def test_similar_documents_equal_exact_jaccard_groups(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(similar.links, "__defaults__", (0.8, cell_rows))
    rng = random.Random(11)
    texts = []
    for k in range(120):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([9, 30, 104, 404]))]
        n = len(words) - 4
        texts += [words]
        for share in (0.72, 0.77, 0.8, 0.8, 0.83):
            # A text whose end is new: n - m of n shingles stay, of n + m in all.
            m = round(n * (1 - share) / (1 + share)) + rng.choice([0, 0, 1])
            texts.append(words[: len(words) - m] + [f"new{rng.getrandbits(40)}" for _ in range(m)])
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0] + " x"), (3, texts[9])], "doc_id bigint, text string")
    rows = docs.collect()
    sets = [five_words(r.text) for r in rows]
    label = list(range(len(rows)))
    near = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] & sets[j]:
                both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
                near += 0.7 <= both / all_ < 0.8
                if 5 * both >= 4 * all_ and label[i] != label[j]:
                    a, b = label[i], label[j]
                    label = [b if x == a else x for x in label]
    want, got = {}, {}
    for k, r in enumerate(rows):
        want.setdefault(label[k], set()).add((r.doc_id, similar.set_node(similar.shingles(r.text))))
    for r in similar.similar_documents(docs).collect():
        got.setdefault(r.label, set()).add((r.doc_id, r.fp))
    assert near > 100 and set(map(frozenset, got.values())) == set(map(frozenset, want.values()))


def test_bands_meet_as_often_as_stated():
    rng = np.random.default_rng(3)
    met = np.zeros(similar.BANDS)
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 108).astype(np.uint64)  # 96 of 120 are shared
        met += similar.band_keys(x) == similar.band_keys(np.concatenate([x[:96], rng.integers(0, 1 << 63, 12).astype(np.uint64)]))
    assert abs(met.mean() / 300 - 0.8**similar.ROWS) < 0.03 and 1 - (1 - 0.8**similar.ROWS) ** similar.BANDS > 0.9999


def test_pairs_meet_at_codewords_without_the_bands(spark):
    rng = random.Random(12)
    texts, pairs = [], []
    for k in range(300):
        words = [f"w{rng.randrange(4000)}" for _ in range(304)]
        m = round(300 * 0.2 / 1.8) - k % 3 * 12  # Jaccard similarities of 0.8, 0.86 and 0.93
        pairs.append((similar.shingles(" ".join(words)), similar.shingles(" ".join(words[: len(words) - m] + [f"new{rng.getrandbits(40)}" for _ in range(m)]))))
    sets = [x for pair in pairs for x in pair]
    rows = [(similar.set_node(x), bytearray(similar._wide(x).tobytes())) for x in sets]
    nodes = spark.createDataFrame(rows, "fp bigint, wide binary")
    for cell_rows in (20, 16_384):
        label = {r.node: r.label for r in components(similar.linked(similar.at_anchors(nodes), 0.8, cell_rows)).collect()}
        met = [label.get(similar.set_node(a), 1) == label.get(similar.set_node(b), 2) for a, b in pairs]
        assert sum(met[::3]) >= 93 and sum(met[1::3]) >= 97 and sum(met[2::3]) >= 98
        assert len({label[similar.set_node(a)] for (a, _), hit in zip(pairs, met, strict=True) if hit}) == sum(met)

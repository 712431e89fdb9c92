import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fleetspectra.llm import decontam, gam, langid, lm, pii, rules
from fleetspectra.llm.queries import QUERIES, VOCABULARY
from fleetspectra.llm.textvec import chunks

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0

    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(found)


pieces = st.sampled_from(
    ["a@b.co", "a@", "@", ".", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (415) 555-0100", "+", "-", " ", "é", "7", "x_%"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=12).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    assert [(a, k, b) for a, b, k, _ in pii.spans_of(text) if k < 4] == plain_spans(text)


def test_added_spans_need_a_checksum_or_context():
    kinds = [pii.KINDS[k] for _, _, k, _ in pii.spans_of("iban DE89 3704 0044 0532 0130 00, my ssn is 078-05-1120, 078-05-1120")]
    assert kinds == ["iban", "ssn", "ssn"]
    assert pii.spans_of("DE89 3704 0044 0532 0130 01") == [] and pii.spans_of("number 078-05-1120") == []
    assert len(pii.spans_of("a" * 200_000 + "1" * 200_000 + "." * 10)) == 0  # linear on long runs


def test_pii_query_and_odd_rows(spark, sf, documents, odd, none):
    got = {r.doc_id: r for r in QUERIES["op3_find_pii"](spark, sf).collect()}
    for r in documents:
        spans = plain_spans(r.text or "")
        assert [got[r.doc_id][f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s[1] == k for s in spans) for k in range(4)]
        base = ",".join(f"{pii.BASE_KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        every = [x for x in got[r.doc_id].spans.split(",") if x]
        assert set(base.split(",")) - {""} <= set(every) and len(every) == len(set(every))
    assert pii.digest(pii.find_pii(odd)).count() == odd.count() and pii.find_pii(none).count() == 0


@settings(max_examples=100, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab#é \n\t|", max_size=60)), max_size=6))
def test_counts_equal_plain_loops(texts):
    for first, end, part in chunks(pa.array(texts, pa.string()), limit=50):
        base = rules.base_counts(part)
        for k, text in enumerate(texts[first:end]):
            text = text or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
            inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
            assert base["n_words"][k] == len(words) and base["word_chars"][k] == sum(map(len, words))
            assert base["n_symbols"][k] == sum(c in "#*$%&|<>" for c in text)
            assert base["n_dup_lines"][k] == len(lines) - len(set(lines)) and base["n_repeat_words"][k] == len(inside)


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_quality_is_learned(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op2_quality"](spark, sf).collect() if r.doc_id in labels]
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_rules_keep_by_what_they_learned_from_other_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    labels = {r.doc_id: r.quality for r in known.collect()}
    model = rules.train(docs, known.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 0"))
    held = [r for r in rules.judge(docs, model).collect() if r.doc_id in labels and fold(r.doc_id, 4) == 0 and not r.base_failed]
    assert len(held) > 50 and sum(r.kept == (labels[r.doc_id] == 1) for r in held) >= 0.93 * len(held)


def test_language_is_learned(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in QUERIES["op7_language"](spark, sf).collect() if r.held_out]
    assert all(fold(r.doc_id, 4) == 2 for r in held) and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 9, 30])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(c) for c in code}) == n


def test_models_with_odd_rows(spark, odd, none):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (None, 1), (4, None)], "doc_id bigint, quality int")
    for docs in (odd, none):
        n = docs.count()
        for known in (labels, labels.where("false")):
            assert gam.score(docs, gam.train(docs, known, F.lit(True))).where("score between 0 and 1").count() == n
            model = rules.train(docs, known)
            assert rules.judge(docs, model).count() == n and rules.kept_documents(docs, model).columns == docs.columns
        found = langid.identify(docs, langid.train(docs, F.lit(True)))
        assert found.where("lang_pred is not null and score between 0 and 1").count() == n
        assert found.where("lang_pred = 'und'").count() == (5 if n else 0)
        scored = lm.score(docs, F.lit(True), VOCABULARY)
        assert scored.where("score <= 0 and base_score <= 0 and n_known = n_tokens").count() == n


def test_leaks_are_found(spark, sf, documents, odd, none):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontaminate"](spark, sf).collect()}
    items = {r.item_id: " " + " ".join(r.text.lower().split()) + " " for r in benchmark.collect()}
    planted = {(r.doc_id, i) for r in documents for i, t in items.items() if t in " " + " ".join((r.text or "").lower().split()) + " "}
    assert planted and planted <= found and len(found) <= 1.3 * len(planted)
    text = benchmark.first().text.split()
    changed = " ".join(text[: len(text) // 3] + ["quite", "another"] + text[len(text) // 3 + 2 :])
    docs = spark.createDataFrame([(1, f"before it {changed} after it", 0), (2, "nothing of the kind here at all", 0)], "doc_id bigint, text string, item_id int")
    assert [r.doc_id for r in decontam.find_leaks(docs, benchmark).collect()] == [1]
    assert [r.doc_id for r in decontam.without_leaks(docs, benchmark).collect()] == [2]
    assert decontam.without_leaks(odd, benchmark).count() == odd.count() and decontam.without_leaks(none, benchmark).count() == 0
    assert decontam.without_leaks(odd, benchmark.where("false")).count() == odd.count()
    assert decontam.find_leaks(odd, benchmark.where("false")).count() == 0


def test_common_subsequence():
    assert decontam.common_subsequence([1, 2, 3, 4], [9, 1, 3, 9, 4]) == 3
    assert decontam.common_subsequence([1, 1, 2], [1, 2, 1]) == 2


def test_base_scores_equal_plain_counts(spark, sf, documents):
    counts, learned = {}, [r for r in documents if fold(r.doc_id, 5) != 1]
    for r in learned:
        for w in [*(r.text or "").encode().lower().split(), None]:
            counts[w] = counts.get(w, 0) + 1
    total, size = sum(counts.values()), len(counts)
    for few in (lm.FREQUENT, 4):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        from fleetspectra.llm.common import fold_of

        got = {r.doc_id: r for r in lm.score(docs, fold_of("doc_id", 5) != 1, VOCABULARY, frequent=few).collect()}
        for r in documents:
            words = [*(r.text or "").encode().lower().split(), None]
            want = sum(np.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (size + 1))) for w in words)
            mine = got[r.doc_id]
            assert (mine.n_tokens, mine.n_known, mine.train_tokens) == (len(words), sum(w in counts for w in words), total)
            assert mine.base_score == pytest.approx(want, rel=1e-9) and mine.score < 0


def test_windows_score_each_subword_once_and_look_back_only():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50, 100)
    doc = np.sort(rng.integers(0, 5, 100))
    x, y, window_doc = lm.layout(ids, doc, 6, 50)
    for d in range(6):
        targets = y[window_doc == d].ravel()
        assert targets[targets >= 0].tolist() == [*ids[doc == d], 50]
    model = lm.Attention(lm.Classes(np.arange(51.0)))
    scorer = lm.Scorer(model)
    before = scorer.log_probability(model.classes.of(x, "input"), y)
    later = x.copy()
    later[:, -1] = 7  # the last input, which only the last target may see
    after = scorer.log_probability(model.classes.of(later, "input"), y)
    assert np.allclose(before[:, :-1], after[:, :-1]) and np.allclose(np.exp(_all(scorer, model, x)).sum(), 1.0, atol=1e-4)


def test_the_model_learns_from_every_window_of_the_rows_in_use(spark, sf, documents):
    from fleetspectra.llm.common import fold_of

    docs, ranks = spark.read.parquet(f"{sf}/documents.parquet"), lm.load_ranks(VOCABULARY)
    encoder, want, count = lm.Encoder(ranks), 0, np.zeros(max(ranks.values()) + 2)
    for r in documents:
        if fold(r.doc_id, 5) != 1:
            words = (r.text or "").encode().lower().split()
            n = sum(map(len, encoder.words([hash(w) for w in words], words))) + 1
            want += -(-n // lm.QUERIES)
    assert want > 1000
    for least in (want // 8, want + 1):  # some tasks, and rows of their own for each round; one task and all rows in each
        model = lm.Attention(lm.Classes(count))
        before = model.weights()
        assert lm.learn(docs, fold_of("doc_id", 5) != 1, ranks, model, want, least=least) == want
        assert (model.weights() != before).mean() > 0.5


def test_models_of_tasks_are_averaged_by_their_windows():
    import pyarrow as pa

    rows = pa.table({"task": [3, 1], "n": [30, 10], "at": [7, 7], "weights": [[1.0, 2.0], [5.0, 2.0]]})
    assert lm._average(rows).to_pylist() == [{"at": 7, "n": 40, "weights": [2.0, 2.0]}]


def _all(scorer, model, x):
    """Log probability of every subword as the first target of one window."""
    n = 51
    y = np.full((n, lm.QUERIES), -1)
    y[:, 0] = np.arange(n)
    return scorer.log_probability(model.classes.of(np.repeat(x[:1], n, 0), "input"), y)[:, 0]


def _zipf_words(rng, n, words=20_000):
    return [f"w{k}" for k in np.minimum(words - 1, (words ** rng.random(n)).astype(int))]


def test_short_items_in_running_text_are_found_against_a_large_benchmark(spark):
    rng = np.random.default_rng(6)
    items = [_zipf_words(rng, 5 + k % 12) for k in range(2000)]
    rows, planted = [], set()
    for d in range(240):
        words, k = _zipf_words(rng, 150), d * 8 + d % 8
        at = int(rng.integers(0, 150))
        rows.append((d, " ".join(words[:at] + items[k] + words[at:])))
        planted.add((d, k))
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), benchmark).collect()}
    assert planted <= found


def _leaked_by_brute_force(piece, answer, words):
    size, leaked = len(piece), False
    for begin in range(0, len(words), decontam.STRIDE):
        region = words[max(0, begin - size) : begin + decontam.PASSAGE + size]
        share = decontam.common_subsequence(piece, region) / size
        answered = decontam.common_subsequence(answer, region) / len(answer)
        leaked |= share >= decontam.COPY or share >= decontam.PARAPHRASE and answered >= decontam.ANSWER
    return leaked


def test_gapped_copies_are_found_as_by_brute_force():
    rng = np.random.default_rng(7)
    items = [(k, " ".join(_zipf_words(rng, int(rng.integers(16, 49)))), None) for k in range(60)]
    docs = []
    for d in range(120):
        item = items[d % 60][1].split()
        kept = [w for k, w in enumerate(item) if k >= len(item) * 2 // 3 or rng.random() < (0.3, 0.5, 0.8)[d % 3]]
        copy = [x for w in kept for x in [w, *_zipf_words(rng, int(rng.integers(0, 3)))]]
        docs.append(" ".join(_zipf_words(rng, 60 + d % 9) + copy + _zipf_words(rng, 70)))
    docs += ["", " ".join(_zipf_words(rng, 3)), "w0 " * 300]
    pieces = decontam.pieces_of(items)
    known = pieces.vocabulary
    idf = decontam.inverse_frequency(rng.integers(0, 50, len(known)).astype(float), 400)
    nothing = np.zeros((len(known), 1), np.float32), np.zeros((len(pieces.items), 1), np.float32)
    index = decontam.Index(pieces, *nothing, decontam.Anchors(pieces, idf))
    _, _, texts = next(iter(chunks(pa.array(docs))))
    got = {(d, p) for d, p, *_ in index.search(texts, index.membership())}
    want = {
        (d, p) for d, text in enumerate(docs) for p in range(len(pieces.items))
        if _leaked_by_brute_force(pieces.words[p].tolist(), pieces.answers[p].tolist(), decontam.hashed(text).tolist())
    }
    assert got == want and len(want) > 80


def test_words_out_of_order_need_no_window_and_no_answer(monkeypatch):
    """A piece's words in another order are ruled out for all windows at once, and what is not leaked has its answer left alone."""
    rng = np.random.default_rng(9)
    item = [f"v{k}" for k in range(40)]
    backwards = " ".join(_zipf_words(rng, 200) + item[::-1] + _zipf_words(rng, 200))
    pieces = decontam.pieces_of([(1, " ".join(item), "gold silver")])
    known = pieces.vocabulary
    nothing = np.zeros((len(known), 1), np.float32), np.zeros((1, 1), np.float32)
    index = decontam.Index(pieces, *nothing, decontam.Anchors(pieces, decontam.inverse_frequency(np.ones(len(known)), 400)))
    looked, checked = [], decontam.Anchors._masks
    monkeypatch.setattr(decontam.Anchors, "_masks", lambda self, piece, *rest: looked.append(len(piece)) or checked(self, piece, *rest))
    for text, leaked in ((backwards, []), (" ".join(item), [(0, 0)])):
        looked.clear()
        _, _, texts = next(iter(chunks(pa.array([text]))))
        assert [x[:2] for x in index.search(texts, index.membership())] == leaked
        assert leaked or sum(looked) <= 12


def test_latent_search_alone_finds_paraphrases(spark, monkeypatch):
    """Recall of the latent search without the search by rarer words: items of 16 words and more with every fifth word changed, in running text."""
    sf = "/root/testdata/sf0.01"
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    documents = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(300).collect() if r.text]
    rng = np.random.default_rng(8)
    items = [(r.item_id, r.text.split()) for r in benchmark.collect() if len(r.text.split()) >= 16]
    planted = []
    for n, (item_id, words) in enumerate(items):
        changed = [f"other{rng.integers(1 << 30)}" if k % 5 == 2 else w for k, w in enumerate(words)]
        around = documents[n].split()
        at = int(rng.integers(0, len(around) + 1))
        planted.append((n, " ".join(around[:at] + changed + around[at:]), item_id))
    docs = spark.createDataFrame([(n, t) for n, t, _ in planted] + [(1000 + k, t) for k, t in enumerate(documents[100:])], "doc_id bigint, text string")
    monkeypatch.setattr(decontam.Anchors, "regions", lambda self, feature, doc, blocks: iter(()))
    [index] = decontam.build(docs, benchmark)
    has, found = index.membership(), set()
    for n, text, _ in planted:
        for _, _, texts in chunks(pa.array([text])):
            found |= {(n, index.pieces.items[p]) for _, p, *_ in index.search(texts, has)}
    recall = sum((n, item) in found for n, _, item in planted) / len(planted)
    assert len(planted) >= 20 and recall >= 0.9

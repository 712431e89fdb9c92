import hashlib
import os
import random
from collections import Counter, defaultdict

import pytest

from fleetspectra.llm import alignment
from fleetspectra.llm.queries import ALIGNED

pytestmark = pytest.mark.skipif(not all(os.path.exists(p) for p in ALIGNED), reason="no vocabulary files")


@pytest.fixture(scope="module")
def sides():
    out = []
    for path in ALIGNED:
        with open(path, "rb") as file:
            out.append(alignment.tokenizer(path, file.read()))
    return out


def plain_tokens(text):
    """(ids, end offsets) of both sides by the vocabularies' own libraries, or None if bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(plain_tokens, "have"):
        a = Tokenizer.from_file(ALIGNED[0])
        a.encode_special_tokens = True
        plain_tokens.have = a, sentencepiece.SentencePieceProcessor(model_file=ALIGNED[1]), alignment.byte_alphabet()
    a, b, alphabet = plain_tokens.have
    if not text:
        return None
    want, out = (" " + text).encode(), []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    sides = [(ids, [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids])]
    ids = b.encode(text)
    sides.append((ids, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]))
    for ids, parts in sides:
        if b"".join(parts) != want:
            return None
        end, ends = 0, []
        for part in parts:
            end += len(part)
            ends.append(end)
        out.append((ids, ends))
    return out


def plain_groups(text):
    """[(A ids, B ids), ...] cut where both sides end."""
    tokens = plain_tokens(text)
    if tokens is None:
        return []
    (a, ends_a), (b, ends_b) = tokens
    out, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        x, y = i, j
        while i < len(a) and ends_a[i] <= cut:
            i += 1
        while j < len(b) and ends_b[j] <= cut:
            j += 1
        out.append((a[x:i], b[y:j]))
    return out


def plain(rows):
    docs = [(doc_id, plain_groups(text)) for doc_id, text in rows]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in docs]
    held = Counter(pair for link in links for pair in link)
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (doc_id, groups), link in zip(docs, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((
            doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(link.values()),
            sum(n for p, n in link.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in link.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "Hello, world! It's 2026.", "  two  blanks\n\n\tand\r\nbreaks ", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve façade – “quotes” €5", "日本語のテキスト 한국어", "▁x y",
    "🙂 emoji 👩‍👩‍👧 é \x00 \x85 \x1c     힣", "a" * 3000, "ab" * 700 + "!" * 900, " ", "\n", "don't we'll I'M", "ﬁ ① Å ñ ñ", "͸ᲀ \U0001f9ff x",
]


def test_sides_give_the_ids_of_their_own_libraries(sides):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(ALIGNED[0])
    own.encode_special_tokens = True
    dice = random.Random(1)
    some = TEXTS + ["".join(dice.choice("aZ ß9'\n.é\t-漢") for _ in range(dice.randint(1, 60))) for _ in range(300)]
    assert sides[0].fast is not None
    assert sides[0].encode(some) == [own.encode(" " + t, add_special_tokens=False).ids for t in some]
    assert len(sides[0].bytes) == own.get_vocab_size()


def test_groups_of_a_chunk(sides):
    found = alignment.Aligned([*TEXTS, None, ""], *sides)
    names = [b"%d%s" % (i, mark) for i in range(60_000) for mark in (b",", b"|", b";", b"")]
    want = [r for t in [*TEXTS, None, ""] for r in plain([(0, t)])]
    assert found.digests(names) == [r[7] for r in want]
    assert found.links().tolist() == [r[4] for r in want] and found.per_doc(found.doc).tolist() == [r[3] for r in want]


def run(df, **options):
    found = alignment.score(df, *ALIGNED, **options)
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_equal_to_brute_force(spark, documents, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents[:60]] + list(enumerate(TEXTS, 1000)) + [(2000, None), (2001, ""), (None, "x y"), (5, "x y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = plain(rows)
    assert run(df) == want
    assert run(df, frequent=40) == want and run(df, frequent=0) == want


def test_odd_rows(odd, none):
    assert run(odd) == plain([(r.doc_id, r.text) for r in odd.collect()])
    assert run(none) == []


def test_groups_as_spans(spark):
    rows = [(1, "Hello, wörld!"), (2, None), (3, "x")]
    got = alignment.groups(spark.createDataFrame(rows, "doc_id int, text string").coalesce(1), *ALIGNED).collect()
    for (_, text), r in zip(rows, got):
        assert [(g.a, g.b) for g in r.groups] == [tuple(g) for g in plain_groups(text)]
        ends = [g.end for g in r.groups]
        assert [g.begin for g in r.groups] == ([0, *ends[:-1]] if ends else []) and (not ends or ends[-1] == len((" " + text).encode()))

"""Strings that a polynomial modulo a power of two confuses: the words of Thue and Morse and their complements."""

import numpy as np
import pyarrow as pa
import pytest

from fleetspectra.llm import decontam, rules, suffix
from fleetspectra.llm.lm import Words
from fleetspectra.llm.textvec import PRIME, Rolling, _power, chunks, distinct


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_thue_morse_strings_differ(n):
    both = (thue_morse(n) + thue_morse(n, "b", "a") + thue_morse(n)).encode()
    rolling = Rolling(np.frombuffer(both, np.uint8))
    at = np.array([0, n, 2 * n])
    one, other, again = rolling.of(at, at + n).tolist()
    assert one == again != other
    assert rolling.raw(at, at + n)[0] == rolling.raw(at, at + n)[2] != rolling.raw(at, at + n)[1]


def test_powers_modulo_a_prime():
    got = _power("test", 12345, 1000, PRIME)[:1000]
    assert got.tolist() == [pow(12345, i, PRIME) for i in range(1000)]


def test_equal_stretches_have_equal_hashes():
    dice = np.random.default_rng(3)
    data = dice.integers(97, 99, 3000).astype(np.uint8)
    rolling = Rolling(data)
    start = np.arange(2990)
    value = rolling.of(start, start + 10)
    groups = {}
    for s in start.tolist():
        groups.setdefault(data[s : s + 10].tobytes(), set()).add(int(value[s]))
    assert all(len(v) == 1 for v in groups.values()) and len({v for g in groups.values() for v in g}) == len(groups)


@pytest.mark.parametrize("n", [1024, 4096])
def test_rules_count_only_equal_lines_and_words(n):
    a, b = thue_morse(n), thue_morse(n, "b", "a")
    batch = pa.array([f"{a}\n{b}\n{a}", f"x {a} y z w x {b} y z w", f"x {a} y z w x {a} y z w"])
    [(_, _, texts)] = chunks(batch)
    got = rules.base_counts(texts)
    assert got["n_dup_lines"].tolist() == [1, 0, 0] and got["n_repeat_words"].tolist() == [0, 0, 10]
    assert len(Words(texts).keys) == 6


def test_repeats_of_windows_of_thue_morse(spark):
    a, b = thue_morse(1024), thue_morse(1024, "b", "a")
    rows = spark.createDataFrame([(1, a), (2, b), (3, "x" + a)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in suffix.remove_repeats(rows, width=1024).collect()}
    assert got == {1: 1024, 2: 0, 3: 1024}


def test_distinct_words_are_hashed_once_and_as_by_rolling(monkeypatch):
    dice = np.random.default_rng(4)
    some = ["a", "a\0", "\0a", "é", "日" * 21, "x" * 63, "x" * 64, "x" * 65, "y" * 64 + "z", "b" * 8, "b" * 16, "b" * 17, "q" * 5000]
    some += ["".join(dice.choice(list("ab0"), dice.integers(1, 20))) for _ in range(400)]
    text = " \n".join(some[k] for k in dice.integers(0, len(some), 6000))
    for _, _, texts in chunks(pa.array([text, None, "", " ", "a", "a\0"])):
        start, end, _ = texts.words()
        if not len(start):
            continue
        at, hashes, first = distinct(texts.data, start, end)
        want = Rolling(texts.data).of(start, end)
        assert (hashes[at] == want).all() and len(hashes) == len(set(want.tolist())) and (at[first] == np.arange(len(first))).all()
    hashed = []
    monkeypatch.setattr("fleetspectra.llm.textvec.Rolling", lambda data: hashed.append(len(data)))
    assert len(decontam.hashed("one two three " * 1000)) == 3000 and not hashed

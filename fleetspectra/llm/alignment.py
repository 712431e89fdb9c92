"""Alignment of two tokenizers over the same texts by interval coalescing.

Both token sequences of a text tile the same bytes. All tokens of a chunk of texts are sorted by their start in one
lexsort, a running maximum of their ends follows, and a group begins where a start reaches that maximum; so groups
end where tokens of both sides end. Within a group every A token is linked with every B token. How many documents hold
a pair of ids linked is counted over the corpus, and each document's links are valued by it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspectra.llm.common import in_batches, shared_folder, stored

#: Counts of at most so many pairs go to every task; rarer pairs are joined.
FREQUENT = 1 << 19
#: Texts are aligned in chunks of about so many characters.
CHUNK_CHARS = 1 << 19
#: A group of more links is reduced to its different ids, with how often each stands in it.
LARGE_GROUP = 1 << 10

# Fixed value: how the byte-level vocabulary cuts a text before merging (the public pattern of that vocabulary).
CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose class no version of Unicode changes; other texts are cut by the vocabulary's own library.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-ɏΑ-ΡΣ-ωЀ-ҁҊ-ӿ‐-‧‰-›€ぁ-ゖァ-ヺ一-龥가-힣]")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class ByteLevel:
    """Side A: a byte-level BPE vocabulary from its JSON text."""

    def __init__(self, text: str):
        self.text, model = text, json.loads(text)
        alphabet = byte_alphabet()
        special = {t["id"]: t["content"] for t in model["added_tokens"]}
        entries = {i: bytes(alphabet[c] for c in token) for token, i in model["model"]["vocab"].items() if i not in special}
        entries |= {i: content.encode() for i, content in special.items()}
        self.bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.fast = self._fast({entries[i]: i for i in entries if i not in special}, model)
        self.slow = None

    @staticmethod
    def _fast(ranks: dict[bytes, int], model: dict):
        """The same merges by rank, if the vocabulary is cut by the usual pattern and numbered in order of its merges."""
        cut, bpe = model["pre_tokenizer"] or {}, model["model"]
        usual = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and model["normalizer"] is None
        usual = usual and not bpe.get("dropout") and not bpe.get("ignore_merges") and not bpe.get("continuing_subword_prefix") and not bpe.get("end_of_word_suffix")
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in bpe["merges"]]
        if not usual or [bpe["vocab"].get(m) for m in made] != list(range(256, 256 + len(made))):
            return None
        import tiktoken

        return tiktoken.Encoding("a", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text after a space."""
        out = [None if self.fast is None or UNUSUAL.search(t) else self.fast.encode_ordinary(" " + t) for t in texts]
        rest = [n for n, ids in enumerate(out) if ids is None]
        if rest:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_str(self.text)
                self.slow.encode_special_tokens = True
            for n in rest:
                out[n] = self.slow.encode(" " + texts[n], add_special_tokens=False).ids
        return out


class Pieces:
    """Side B: a SentencePiece model from its bytes; it puts a space before a text by itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def tokenizer(name: str, content: bytes) -> ByteLevel | Pieces:
    return ByteLevel(content.decode()) if name.endswith(".json") else Pieces(content)


class Aligned:
    """The groups of a chunk of texts. Texts that a side does not give back byte by byte have no tokens."""

    def __init__(self, texts: list[str | None], a, b):
        self.n = len(texts)
        whole = [n for n, t in enumerate(texts) if t]
        some = [texts[n] for n in whole]
        ids = [(x, y) if self._same(t, x, y, a, b) else ([], []) for t, x, y in zip(some, a.encode(some), b.encode(some))]
        doc = np.array(whole, np.int64)
        self.a, self.doc_a = self._flat([x for x, _ in ids], doc)
        self.b, self.doc_b = self._flat([y for _, y in ids], doc)
        self.start_a, end_a = self._places(self.a, a)
        self.start_b, end_b = self._places(self.b, b)
        start, end = np.concatenate([self.start_a, self.start_b]), np.concatenate([end_a, end_b])
        side = np.repeat(np.array([0, 1], np.int8), [len(self.a), len(self.b)])
        order = np.lexsort((side, start))
        reach = np.maximum.accumulate(end[order])
        begins = np.ones(len(order), bool)
        begins[1:] = start[order[1:]] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(begins) - 1
        self.group_a, self.group_b = group[: len(self.a)], group[len(self.a) :]
        self.n_groups = int(begins.sum())
        self.size_a = np.bincount(self.group_a, minlength=self.n_groups)
        self.size_b = np.bincount(self.group_b, minlength=self.n_groups)
        self.first_a, self.first_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        self.doc = self.doc_a[self.first_a]

    @staticmethod
    def _same(text: str, x: list[int], y: list[int], a, b) -> bool:
        want = b" " + text.encode()
        return b"".join(map(a.bytes.__getitem__, x)) == want and b"".join(map(b.bytes.__getitem__, y)) == want

    @staticmethod
    def _flat(lists: list[list[int]], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.concatenate([np.array(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64)
        return flat, np.repeat(doc, sizes)

    @staticmethod
    def _places(ids: np.ndarray, side) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in side.bytes], np.int64)[ids]
        end = np.cumsum(size)
        return end - size, end

    def per_doc(self, of: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(of, weights, self.n).astype(np.int64)

    def links(self) -> np.ndarray:
        """Links of each document (a group's are fewer than 2**53)."""
        return self.per_doc(self.doc, self.size_a * self.size_b)

    def digests(self, names: list[bytes]) -> list[str]:
        """SHA-256 of each document's groups as text; ``names[4 * id + k]`` is the id followed by the k-th of ``, | ;`` or nothing."""
        last_a = np.zeros(len(self.a), np.int64)
        last_a[self.first_a + self.size_a - 1] = 1
        last_b = np.zeros(len(self.b), np.int64)
        ends = self.first_b + self.size_b - 1
        last_b[ends] = 2
        final = np.ones(self.n_groups, bool)
        final[:-1] = self.doc[1:] != self.doc[:-1]
        last_b[ends[final]] = 3
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + self.first_b[self.group_a]] = 4 * self.a + last_a
        code[np.arange(len(self.b)) + (self.first_a + self.size_a)[self.group_b]] = 4 * self.b + last_b
        edges = np.concatenate([[0], np.cumsum(self.per_doc(self.doc_a) + self.per_doc(self.doc_b))]).tolist()
        return [
            hashlib.sha256(b"".join(map(names.__getitem__, code[x:y].tolist()))).hexdigest() if y > x else ""
            for x, y in zip(edges, edges[1:])
        ]

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair ``a * width + b`` and number of its links, ordered by document and pair."""
        large = self.size_a * self.size_b > LARGE_GROUP
        group_a, a, times_a = _condensed(self.group_a, self.a, large)
        group_b, b, times_b = _condensed(self.group_b, self.b, large)
        count = np.bincount(group_b, minlength=self.n_groups)
        first = np.cumsum(count) - count
        each = count[group_a]
        at = np.repeat(first[group_a] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        pair = np.repeat(a, each) * width + b[at]
        of = np.repeat(self.doc[group_a], each)
        if not large.any():
            span = int(pair.max(initial=0)) + 1
            key = np.sort(of * span + pair)
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            return *np.divmod(key[new], span), np.diff(np.append(new, len(key)))
        times = np.repeat(times_a, each) * times_b[at]
        order = np.lexsort((pair, of))
        pair, of = pair[order], of[order]
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])]))
        return of[new], pair[new], np.add.reduceat(times[order], new)


def _condensed(group: np.ndarray, ids: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens in order of their group; in large groups each different id once, with its number."""
    inside = large[group]
    if not inside.any():
        return group, ids, np.ones(len(ids), np.int64)
    some = np.unique(np.stack([group[inside], ids[inside]]), axis=1, return_counts=True)
    group = np.concatenate([group[~inside], some[0][0]])
    order = np.argsort(group, kind="stable")
    return group[order], np.concatenate([ids[~inside], some[0][1]])[order], np.concatenate([np.ones((~inside).sum(), np.int64), some[1]])[order]


def _chunks(texts: list[str | None]):
    """Runs of texts of about CHUNK_CHARS characters; a longer text alone."""
    first, size = 0, 0
    for n, text in enumerate(texts):
        if n > first and size + len(text or "") > CHUNK_CHARS:
            yield first, n
            first, size = n, 0
        size += len(text or "")
    yield first, len(texts)


def _over_chunks(files, describe: Callable[[Aligned, object, object], list[pa.Array]], names: list[str]):
    """For ``mapInArrow``: row and id, then what ``describe`` says of each chunk of texts."""

    def make():
        a, b = (tokenizer(name, content) for name, content in files.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(2).to_pylist()
            parts = [describe(Aligned(texts[x:y], a, b), a, b) for x, y in _chunks(texts)]
            columns = [pa.concat_arrays(column) for column in zip(*parts)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["row", "doc_id", *names])

        return step

    return in_batches(make)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _files(docs: DataFrame, *paths: str):
    """Both vocabularies, read once by the driver; each is a few MB."""
    content = []
    for path in paths:
        with open(path, "rb") as file:
            content.append((path, file.read()))
    return docs.sparkSession.sparkContext.broadcast(content)


def groups(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, groups``: per text its groups of tokens, with their bytes' start and end in space+text and both sides' ids."""

    def describe(found: Aligned, a, b) -> list[pa.Array]:
        edges = np.concatenate([[0], np.cumsum(found.per_doc(found.doc))])
        first = found.start_a[found.first_a]
        base = first[np.minimum(edges[:-1], max(0, found.n_groups - 1))][found.doc] if found.n_groups else first
        size_of = np.array([len(x) for x in a.bytes], np.int64)
        last = found.first_a + found.size_a - 1
        end = found.start_a[last] + size_of[found.a[last]]
        sides = [
            pa.ListArray.from_arrays(pa.array(np.append(f, len(ids)), pa.int32()), pa.array(ids, pa.int32()))
            for f, ids in ((found.first_a, found.a), (found.first_b, found.b))
        ]
        inner = pa.StructArray.from_arrays([pa.array(first - base), pa.array(end - base), *sides], ["begin", "end", "a", "b"])
        return [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), inner)]

    rows = _rows(docs, id_col, text_col)
    schema = f"row bigint, doc_id {dict(rows.dtypes)['doc_id']}, groups array<struct<begin:bigint,end:bigint,a:array<int>,b:array<int>>>"
    return rows.mapInArrow(_over_chunks(_files(docs, a, b), describe, ["groups"]), schema)


def linked(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table ``row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times`` with a row for each document.

    ``pairs`` are the different linked id pairs (A id times the size of B, plus B id), ``times`` how often each is linked.
    """

    def describe(found: Aligned, a, b) -> list[pa.Array]:
        size = max(len(a.bytes), len(b.bytes))
        if not hasattr(a, "names"):
            a.names = [b"%d%s" % (i, mark) for i in range(size) for mark in (b",", b"|", b";", b"")]
        of, pair, times = found.pairs(len(b.bytes))
        edges = pa.array(np.searchsorted(of, np.arange(found.n + 1)), pa.int32())
        counts = [found.per_doc(found.doc_a), found.per_doc(found.doc_b), found.per_doc(found.doc), found.links()]
        lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int64())) for x in (pair, times)]
        return [*(pa.array(c) for c in counts), pa.array(found.digests(a.names), pa.string()), *lists]

    rows = _rows(docs, id_col, text_col)
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    schema = f"row bigint, doc_id {dict(rows.dtypes)['doc_id']}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    out = rows.mapInArrow(_over_chunks(_files(docs, a, b), describe, names), schema + "pairs array<bigint>, times array<bigint>")
    path = f"{shared_folder(docs.sparkSession)}/step-{uuid.uuid4().hex}"
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """A stored table ``pair, a, b, held, best``: documents that hold the pair linked, and whether no pair of its A id has more.

    Rows are at most the pairs of the two vocabularies, an A id's at most the size of B.
    """
    held = stored(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("held")))
    held = held.select("pair", F.expr(f"pair div {width}").cast("int").alias("a"), (F.col("pair") % width).cast("int").alias("b"), "held")
    most = held.groupBy("a").agg(F.max("held").alias("most"))
    return stored(held.join(most, "a").select("pair", "a", "b", "held", (F.col("held") == F.col("most")).alias("best")))


def _frequent(counted: DataFrame, limit: int) -> int:
    """The least count from which on there are at most ``limit`` pairs (by sixteenths of a power of two)."""
    level = F.floor(F.log2("held") * 16).cast("int")
    sizes = sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True)
    total, least = 0, None
    for level, n in sizes:
        total += n
        if total > limit:
            break
        least = level
    return 1 << 62 if least is None else int(np.ceil(2 ** (least / 16) - 1e-9))


def score(
    docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row.

    ``a`` is the file of a byte-level vocabulary (.json), ``b`` of a SentencePiece model. A text that is null or empty,
    or that a side does not give back byte by byte, has no tokens: zeros and an empty digest. Repeated rows count as
    documents of their own. Ids keep their type; other columns are not looked at. An empty table gives no rows.
    """
    links = linked(docs, a, b, id_col, text_col)
    with open(b, "rb") as file:
        width = len(Pieces(file.read()).bytes)
    counted = pair_counts(links, width)
    least = _frequent(counted, frequent)
    known = counted.where(F.col("held") >= least).select("pair", "held", "best").orderBy("pair").toPandas()
    sent = docs.sparkSession.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("pair", "held", "best")))

    def make():
        pairs, held, best = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column("pairs")
            pair, times = np.asarray(lists.flatten()), np.asarray(batch.column("times").flatten())
            doc = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
            hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            sums = []
            for value in (best, held):
                total = np.zeros(batch.num_rows, np.int64)
                if len(pairs):
                    np.add.at(total, doc[hit], times[hit] * value[at[hit]].astype(np.int64))
                sums.append(pa.array(total))
            edges = pa.array(np.searchsorted(doc[~hit], np.arange(batch.num_rows + 1)), pa.int32())
            inner = pa.StructArray.from_arrays([pa.array(pair[~hit]), pa.array(times[~hit])], ["pair", "times"])
            return pa.RecordBatch.from_arrays([*batch.columns[:7], *sums, pa.ListArray.from_arrays(edges, inner)], [*batch.schema.names[:7], "best", "sum", "rare"])

        return step

    kept = "row bigint, doc_id {}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string".format(dict(links.dtypes)["doc_id"])
    schema = kept + ", best bigint, sum bigint, rare array<struct<pair:bigint,times:bigint>>"
    main = stored(links.mapInArrow(in_batches(make), schema))
    rest = main.select("row", F.explode("rare").alias("r")).select("row", "r.pair", "r.times").join(counted, "pair")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("bigint")).alias("more_best"), F.sum(F.col("times") * F.col("held")).alias("more"))
    out = main.join(rest, "row", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256",
    )

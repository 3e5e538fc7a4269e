"""Byte-level BPE: whole texts to token ids and back, in parallel within a text.

A text longer than ``chunk_chars`` is cut into windows that overlap their
successors by ``overlap_chars``. Each window is pre-tokenised by itself, in
parallel. No alternative of the pattern looks back, so two pre-tokenisations
that share one boundary agree from there on: neighbours are stitched at their
first common boundary within the overlap (one that does not follow white
space, where the pattern looks ahead), and where there is none the two
windows stay one piece (a run of thousands of letters has no boundary inside).
The pieces between the cuts are encoded in parallel, and their ids concatenate
to those of the whole text. Decoding concatenates the tokens' raw bytes.

Pre-tokens are merged by rank, lowest first and leftmost among equals: the distinct
ones that a slice of texts brings anew all at once, in arrays, and long runs with a
heap, so that one costs n log n. A bounded cache of two generations holds the
frequent ones.

Defined cases: null counts as the empty text, which has no tokens (the digest is
of the empty string); repeated rows stay repeated, and rows that share an id keep
their own results; ties between equal ranks merge from the left; very long texts
are cut as above, and their digests are made piece by piece; other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import STAGE_BYTES, bounded_batches, by_bytes, forgetful, table

CHUNK_CHARS, OVERLAP_CHARS = 1 << 15, 1 << 10
#: Pre-tokens that each of a task's two generations of cached ones keeps, about.
CACHE = 1 << 17
#: Pre-tokens up to this many characters are cached.
CACHED_CHARS = 48


#: Pre-tokens up to this many bytes are merged many at once, TOGETHER at most, longer ones by a heap.
SHORT, TOGETHER, NONE = 40, 8192, 1 << 30


def numbers(ids: str) -> list[int]:
    return np.fromstring(ids, np.int32, sep=",").tolist()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Coder:
    """Encodes and decodes with one rank file; made once in each Python worker."""

    _made: dict[tuple[str, str], Coder] = {}

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks = read_ranks(path)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in self.bytes_of}
        self.pieces = regex.compile(pattern)
        self.forget()
        # which token any two make together
        pairs = {left << 20 | right: rank for token, rank in ranks.items() for i in range(1, len(token)) if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None}
        self.pairs = np.sort(np.fromiter(pairs, np.int64, len(pairs)))
        self.made = np.fromiter((pairs[k] for k in self.pairs.tolist()), np.int64, len(pairs))
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    @classmethod
    def get(cls, path: str, pattern: str) -> Coder:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def forget(self) -> None:
        self.ids: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}
        self.older: tuple[dict[str, str], dict[str, bytes]] = ({}, {})

    @classmethod
    def forget_all(cls) -> None:
        """Empties the caches of pre-tokens, which are larger than all else here; the tables stay."""
        for coder in cls._made.values():
            coder.forget()

    def together(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of what each two tokens make together, or NONE."""
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.made[at], NONE)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of some pre-tokens: in each, the adjacent pair of the lowest rank merges, the leftmost among equals, until none has a rank."""
        out: list[list[int]] = [None if (r := self.ranks.get(w)) is None else [r] for w in words]
        for i, w in enumerate(words):
            if out[i] is None and len(w) > SHORT:
                out[i] = self._merge_long(w)
        rest = sorted((i for i, ids in enumerate(out) if ids is None), key=lambda i: len(words[i]))
        for at in range(0, len(rest), TOGETHER):
            some = rest[at : at + TOGETHER]
            for i, ids in zip(some, self._merge_short([words[i] for i in some])):
                out[i] = ids
        return out

    def _merge_short(self, words: list[bytes]) -> list[list[int]]:
        """Words of much the same length, all at once: a row for each, of its tokens and of the ranks of its neighbours."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        columns = np.arange(int(n.max()))
        tokens = np.zeros((len(words), len(columns)), np.int64)
        tokens[columns < n[:, None]] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full(tokens.shape, NONE)
        ranks[:, :-1] = np.where(columns[:-1] < n[:, None] - 1, self.together(tokens[:, :-1] << 20 | tokens[:, 1:]), NONE)
        rows = np.arange(len(words))
        while True:
            at = ranks[rows].argmin(1)
            least = ranks[rows, at]
            rows, at, least = (x[least < NONE] for x in (rows, at, least))
            if not len(rows):
                break
            after = np.minimum(columns + (columns > at[:, None]), len(columns) - 1)
            tokens[rows] = np.take_along_axis(tokens[rows], after, 1)
            ranks[rows] = np.take_along_axis(ranks[rows], after, 1)
            tokens[rows, at] = least
            n[rows] -= 1
            for left in (at - 1, at):
                right = np.minimum(left + 1, len(columns) - 1)
                there = (left >= 0) & (left + 1 < n[rows])
                ranks[rows, np.maximum(left, 0)] = np.where(there, self.together(tokens[rows, np.maximum(left, 0)] << 20 | tokens[rows, right]), np.where(left >= 0, NONE, ranks[rows, 0]))
            ranks[rows, n[rows] - 1] = NONE
        return [ids[:k] for ids, k in zip(tokens.tolist(), n.tolist())]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same of one long pre-token, by a heap."""
        ranks = self.ranks
        n = len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := ends[i]) >= n or ends[j] != end:
                continue
            alive[j] = False
            ends[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(data[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return out

    def coded(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """(ids as text, their bytes) of each text; what the texts' pre-tokens have in common is coded once, and the frequent ones are kept."""
        if len(self.ids) > CACHE:
            self.older, self.ids, self.raw = (self.ids, self.raw), {}, {}
        pieces = [self.pieces.findall(t) for t in texts]
        ids, raw, (older_ids, older_raw), names, bytes_of = self.ids, self.raw, self.older, self.names, self.bytes_of
        lacking = set(itertools.chain.from_iterable(pieces)).difference(ids)
        again = lacking.intersection(older_ids)
        for p in again:
            ids[p], raw[p] = older_ids[p], older_raw[p]
        new = list(lacking - again)
        for p, found in zip(new, self.merge([p.encode() for p in new])):
            if len(found) == 1:
                ids[p], raw[p] = names[found[0]], bytes_of[found[0]]
            else:
                ids[p], raw[p] = ",".join([names[i] for i in found]), b"".join([bytes_of[i] for i in found])
        out = [(",".join(map(ids.__getitem__, found)), b"".join(map(raw.__getitem__, found))) for found in pieces]
        for p in new:
            if len(p) > CACHED_CHARS:
                del ids[p], raw[p]
        return out

    def encode(self, text: str) -> list[int]:
        return numbers(self.coded([text])[0][0])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def boundaries(self, text: str) -> list[int]:
        """Where the pre-tokens of text begin, except after white space: the pattern looks ahead there, and would see the end of a piece.

        If text is cut off, a contraction cut in two may put a wrong one before its last character.
        """
        return [i for m in self.pieces.finditer(text) if not (i := m.start()) or not text[i - 1].isspace()]


def _windows(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """One row for each window of the columns row and text: row, k, window (with its overlap), is_last."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, row, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
                last = (len(text) - 1) // chunk
                for k in range(last + 1):
                    window = text[k * chunk : (k + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([row]), pa.array([k], pa.int32()), pa.array([k == last]), pa.array([window])], ["doc_id", "row", "k", "is_last", "window"])

    return docs.select("doc_id", "row", "text").mapInArrow(forgetful(cut), "doc_id bigint, row bigint, k int, is_last boolean, window string")


def _with_boundaries(windows: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Each window with the boundaries within its first ``overlap`` characters and, counted from the next window, within its last."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.get(path, pattern)
        for b in batches:
            heads, tails = [], []
            for text in b.column("window").to_pylist():
                at = coder.boundaries(text)
                heads.append([i for i in at if i < overlap])
                tails.append([i - chunk for i in at if chunk <= i < chunk + overlap - 1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], [*b.schema.names, "head", "tail"])

    return windows.mapInArrow(forgetful(mark), "doc_id bigint, row bigint, k int, is_last boolean, window string, head array<int>, tail array<int>")


def _pieces(marked: DataFrame, chunk: int) -> DataFrame:
    """Rows (row, k, piece): what lies between the stitches, in order; windows without a common boundary are joined."""
    order = Window.partitionBy("doc_id", "row").orderBy("k")
    cut = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    cuts = marked.select("doc_id", "row", "k", "is_last", "window", cut.alias("cut"))
    # the text from this window's stitch (or its start, if it has none) to the next window's stitch (or start)
    begin, end = F.coalesce("cut", F.lit(0)), F.coalesce(F.lead("cut").over(order), F.lit(0)) + chunk
    part = F.when(F.col("is_last"), F.expr("substring(window, b + 1)")).otherwise(F.expr("substring(window, b + 1, e - b)"))
    parts = cuts.select("*", begin.alias("b"), end.alias("e"), F.count("cut").over(order).alias("piece_no")).select("doc_id", "row", "k", "piece_no", part.alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "")
    return parts.groupBy("doc_id", "row", "piece_no").agg(joined.alias("piece"))


DIGESTS, ARRAYS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string", "n_tokens bigint, ids array<int>, decoded binary"
FIELDS = {DIGESTS: [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())], ARRAYS: [("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]}


def _batch(ids: list[int], rows: list[tuple], kinds: str) -> pa.RecordBatch:
    fields = FIELDS[kinds]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields))], ["doc_id", *(n for n, _ in fields)])


def _short(docs: DataFrame, path: str, pattern: str, kinds: str) -> DataFrame:
    """Each row's doc_id, with the ids and the decoded bytes of its text, or their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.get(path, pattern)
        for b in by_bytes(batches):
            rows = []
            for ids, raw in coder.coded(b.column("text").to_pylist()):
                n = ids.count(",") + 1 if ids else 0
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()) if kinds == DIGESTS else (n, numbers(ids), raw))
            yield _batch(b.column("doc_id").to_pylist(), rows, kinds)

    return docs.select("doc_id", "text").mapInArrow(forgetful(run, Coder.forget_all), f"doc_id bigint, {kinds}")


def _long(pieces: DataFrame, path: str, pattern: str, kinds: str) -> DataFrame:
    """The same of texts in pieces (doc_id, row, piece_no, piece): pieces are encoded wherever they are, and each text's follow one another through a task."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.get(path, pattern)
        for b in by_bytes(batches, "piece"):
            found = coder.coded(b.column("piece").to_pylist())
            ids, raw = [numbers(x) for x, _ in found], [x for _, x in found]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "row", "piece_no")), pa.array(ids, pa.list_(pa.int32())), pa.array(raw, pa.binary())], ["doc_id", "row", "piece_no", "ids", "decoded"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, ids, decoded = None, 0, [], []

        def out() -> pa.RecordBatch:
            whole = (n, sums[0].hexdigest(), sums[1].hexdigest()) if kinds == DIGESTS else (n, list(itertools.chain.from_iterable(ids)), b"".join(decoded))
            return _batch([at[0]], [whole], kinds)

        for b in batches:
            for doc_id, row, some, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "ids", "decoded"))):
                if at != (doc_id, row):
                    if at is not None:
                        yield out()
                    at, n, ids, decoded, sums = (doc_id, row), 0, [], [], [hashlib.sha256(), hashlib.sha256()]
                if kinds == DIGESTS:
                    sums[0].update((("," if n else "") + ",".join(map(str, some))).encode() if some else b"")
                    sums[1].update(raw)
                else:
                    ids.append(some)
                    decoded.append(raw)
                n += len(some)
        if at is not None:
            yield out()

    coded = pieces.select("doc_id", "row", "piece_no", "piece").mapInArrow(forgetful(code, Coder.forget_all), "doc_id bigint, row bigint, piece_no bigint, ids array<int>, decoded binary")
    dealt = coded.repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "piece_no")
    return dealt.mapInArrow(forgetful(gather), f"doc_id bigint, {kinds}")


def encode(spark: SparkSession, docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each row's text; with digest, (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Short texts are one window and need no shuffle; only longer ones are cut,
    stitched and brought together again.
    """
    if not 0 < overlap_chars <= chunk_chars:
        raise ValueError("0 < overlap_chars <= chunk_chars")
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = DIGESTS if digest else ARRAYS
    is_long = F.length("text") > chunk_chars
    long = docs.where(is_long).withColumn("row", F.monotonically_increasing_id())
    marked = _with_boundaries(_windows(long, chunk_chars, overlap_chars).repartition("doc_id", "row", "k"), path, pattern, chunk_chars, overlap_chars)
    return _short(docs.where(~is_long), path, pattern, kinds).unionByName(_long(_pieces(marked, chunk_chars), path, pattern, kinds))


def decode(df: DataFrame, column: str, path: str, to: str = "decoded") -> DataFrame:
    """df with column ``to``: the raw bytes of a column of id arrays (null stays null)."""

    @F.pandas_udf("binary")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Coder.get(path, public_tokenizers.PATTERN)
        for batch in values:
            yield batch.map(lambda x: None if x is None else coder.decode(x.tolist()))

    return df.withColumn(to, run(F.col(column)))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return encode(spark, docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digest=True)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: (doc_id, n_tokens, ids) of each document."""
    bounded_batches(spark, STAGE_BYTES)
    return encode(spark, docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).select("doc_id", "n_tokens", "ids")


QUERIES = {"op6_byte_bpe": op6_byte_bpe}

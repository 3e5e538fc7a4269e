"""N-gram Jaccard join: parity sketches, pigeonhole chunks within size bands, exact verification, connected groups.

A document's set holds the 64-bit hashes of its distinct word shingles. Equal sets
are one class, known by a fingerprint, so that exact copies meet nobody. Two sets
with a similarity of at least need/100 differ in at most
``(100 - need) / (100 + need) * (a + b)`` elements. Each element flips one bit of a
parity sketch, so the sketches' Hamming distance is a lower bound of the symmetric
difference, and each differing element spoils at most one chunk of the sketch.

Sizes fall into bands such that linked sets lie in the same band or in neighbours;
a pair meets in the larger one's band, whose sketches have one chunk more than the
most differing elements there, and ``spare`` more: an empty chunk says nothing, so
such chunks are left out, which loses no pair as long as one of its
sets has no more than ``spare`` of them; sets with more bring theirs along. Linked
classes therefore share a (band, chunk, bits) bucket for sure.

A band of large sets is cut into parts of up to ``PART`` elements by hash, a power of
two of them. Of sets that differ in d elements, some part differs in d / parts at
most, so that the chunks, the spare ones and a sketch of ``LOCAL`` longs are those of
a part, and a pair's sketches tell as much for large sets as for small ones.

A bucket without a member of its own band is of no use and is dropped, as are
chunks that hold fewer than two elements: one shingle that many texts share says
little, and ``spare`` covers those chunks like empty ones. Buckets that a sample
shows to be very large are dealt out by class as well.

A bucket's members need not all be compared to know what is connected. First, each
class meets one of its buckets' heads, the one it shares most buckets with (a
bucket's head is the member that meets others in most buckets); then groups meet
the heads of other groups by one member each; at last all members of different
groups that still share a bucket meet once, in the first bucket that they share, if
the Hamming distance of the part's sketches, then of the whole ones, allows a link. Every pair that shares a bucket is
so compared, or connected already. Verification brings the texts of a pair together
(large stars are split) and compares the sets. Components come from rounds of
smallest-neighbour exchange and jumps.

Defined cases: null and word-free texts have an empty set, n_shingles 0, and are
linked with nothing; fewer than ``width`` words are one shingle; repeated rows stay
repeated; rows that share an id but not a text are documents of their own with the
same id; very long texts are read whole, a few at a time; other columns, whatever
their names, are not read. Two different sets share a fingerprint, or
two shingles a hash, with a probability of about pairs / 2**63.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import STAGE_BYTES, bounded_batches, by_bytes, forget, forgetful, frequent, level, saved, table

#: What op10 is asked for: words of a shingle, per cent of similarity; the pipeline's stage is asked for STAGE_WIDTH and STAGE_NEED.
WIDTH, NEED = 4, 85
STAGE_WIDTH, STAGE_NEED = 5, 80
CHUNK_BITS = 30
STAR = 64
#: One class in so many is looked at to find large buckets; how many of those make one, and how many are dealt out by class, over SALTS parts.
SAMPLED, LARGE, LARGE_BUCKETS, SALTS = 64, 32, 1 << 14, 64
#: Buckets of a class up to which a pair is told by the first bucket that it shares; pairs of classes with more may be told by each.
LISTED = 200
#: Elements of a part, parts of a set at most (larger parts lose no pair, but tell less), and longs of a part's sketch; the sketch is also looked at folded to FOLDED longs.
PART, PARTS, LOCAL, FOLDED = 512, 1 << 10, 8, 2
#: Bits of a key that name its part: as a heap's index, the number of parts plus the part.
PART_BITS = (PARTS << 1) - 1
#: Rows of (document, comparison) that are broadcast to the scan of the texts; more are joined by doc_id.
BROADCAST_ROWS = 300_000
#: Bytes of texts whose sets are made at a time: a set's arrays take many times its text. Results are the same with any.
SETS_BYTES = 1 << 18
#: Fingerprints that a task knows it has passed on.
CACHE = 1 << 17
#: Words of up to so many times eight bytes are hashed together, longer ones one by one.
BLOCKS = 16
U = np.uint64
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
EVEN = ~U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


#: The arrays in which a task hashes words, by use: the next slice of texts takes them over.
_hashes: dict[str, np.ndarray] = {}


def forget_hashes() -> None:
    _hashes.clear()


def scratch(use: str, n: int) -> np.ndarray:
    """An array of n numbers, valid until the next call for this use."""
    held = _hashes.get(use)
    if held is None or len(held) < n:
        held = _hashes[use] = np.empty(n + n // 4 + 1, U)
    return held[:n]


def stir(x: np.ndarray) -> np.ndarray:
    """mixed(x), in place."""
    t = scratch("mixed", len(x))
    for bits, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.bitwise_xor(x, np.right_shift(x, U(bits), out=t), out=x)
        if factor:
            np.multiply(x, U(factor), out=x)
    return x


def words_of(texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, end to end, until the next call; how many words each text has). Equal words have equal hashes, in any text and slice."""
    column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, U), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    upto = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    n, text = int(upto[-1] - upto[0]), memoryview(data or b"")[upto[0] : upto[-1]].tobytes().lower() + bytes(8)
    upto = upto - upto[0]
    letters = np.frombuffer(text, np.uint8, n)
    inside = (letters != 32) & (letters - np.uint8(9) > 4)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # where a text begins, so does its first word, whatever the text before it ends with
    cut = upto[:-1][(upto[:-1] > 0) & (upto[:-1] < n)]
    first[cut], last[cut - 1] = inside[cut], inside[cut - 1]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    # eight bytes at a time, from any place; what lies behind a word's end is masked
    eight = np.ndarray(n + 1, "<u8", text, strides=(1,))
    h = scratch("words", len(start))
    np.multiply(size.astype(U), U(0x9E3779B97F4A7C15), out=h)
    h += eight[start] & MASKS[np.minimum(size, 8)]
    stir(h)
    more = np.flatnonzero((size > 8) & (size <= 8 * BLOCKS))
    for k in range(8, 8 * BLOCKS, 8):
        more = more[size[more] > k]
        if not len(more):
            break
        h[more] = stir(h[more] * U(0x9E3779B97F4A7C15) + (eight[start[more] + k] & MASKS[np.minimum(size[more] - k, 8)]))
    for i in np.flatnonzero(size > 8 * BLOCKS).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[start[i] : start[i] + size[i]])
    return h, np.diff(np.searchsorted(start, upto))


class Sets:
    """The sets of some texts, end to end: ``flat`` holds each text's sorted distinct shingle hashes, ``n`` how many."""

    def __init__(self, texts: list[str | None] | pa.Array, width: int = WIDTH, need: int = NEED):
        self.need = need
        h, sizes = words_of(texts)
        # a text of fewer than width words is one shingle, as wide as it has words
        wide = np.minimum(sizes, width)
        many = np.where(sizes > 0, sizes - wide + 1, 0)
        ends = np.cumsum(many)
        start = np.repeat(np.cumsum(sizes) - sizes - (ends - many), many) + np.arange(int(many.sum()))
        span = np.repeat(wide, many)
        out = span.astype(U)
        short = np.flatnonzero(span < width)
        for k in range(width):
            done = short[span[short] <= k]
            kept = out[done]
            out *= U(0x9E3779B97F4A7C15)
            out += h[np.minimum(start + k, len(h) - 1)]
            stir(out)
            out[done] = kept
        for e, m in zip(ends.tolist(), many.tolist()):
            out[e - m : e].sort()
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        new[(ends - many)[many > 0]] = True
        self.flat = out[new]
        self.n = np.diff(np.searchsorted(np.flatnonzero(new), np.append(0, ends)))
        self.ends = np.cumsum(self.n)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] - self.n[i] : self.ends[i]]

    def _sums(self, x: np.ndarray, ufunc=np.add) -> np.ndarray:
        out, full = np.zeros(len(self.n), U), self.n > 0
        if full.any():
            out[full] = ufunc.reduceat(x, (self.ends - self.n)[full])
        return out

    def fingerprints(self) -> np.ndarray:
        """Even numbers: the last bit is free for a mark."""
        with np.errstate(over="ignore"):
            return (mixed(self._sums(mixed(self.flat + U(1))) + self.n.astype(U)) & EVEN).view(np.int64)

    def sketches(self) -> list[np.ndarray]:
        """Parity bits of each set, as signed longs: a power of two of them, at least two bits for each element."""
        place = mixed(self.flat ^ U(0x5851F42D4C957F2D))
        longs = sketch_longs(self.n)
        begin = np.cumsum(longs) - longs
        at = place & (np.repeat(longs, self.n).astype(U) * U(64) - U(1))
        bits = np.bincount(at.astype(np.int64) + np.repeat(begin, self.n) * 64, minlength=int(longs.sum()) * 64) & 1
        packed = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)
        return [packed[b : b + k] for b, k in zip(begin.tolist(), longs.tolist())]

    def local(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(codes, sketches) of each set's parts, for its own band and, where that has other parts, the next."""
        own = np.searchsorted(edges_for(self.need), self.n, "right") - 1
        place = mixed(self.flat ^ U(0x5851F42D4C957F2D)) & U(LOCAL * 64 - 1)
        many = np.zeros((2, len(self.n)), np.int64)
        for i in np.flatnonzero(self.n):
            many[:, i] = [parts_of(int(own[i]) + step, self.need) for step in (0, 1)]
        many[1, many[1] == many[0]] = 0
        codes, sketches = [[] for _ in self.n], [[] for _ in self.n]
        for parts in many:
            used = np.repeat(parts > 0, self.n)
            who = np.repeat(np.arange(len(self.n)), self.n)[used]
            begin = np.cumsum(parts) - parts
            part = begin[who] + (((self.flat[used] >> U(32)) * parts[who].astype(U)) >> U(32)).astype(np.int64)
            bits = np.bincount(part * (LOCAL * 64) + place[used].astype(np.int64), minlength=int(parts.sum()) * LOCAL * 64) & 1
            packed = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)
            for i in np.flatnonzero(parts):
                codes[i].append(np.arange(parts[i], 2 * parts[i]))
                sketches[i].append(packed[begin[i] * LOCAL : (begin[i] + parts[i]) * LOCAL])
        none = np.zeros(0, np.int64)
        return [np.concatenate([none, *c]) for c in codes], [np.concatenate([none, *s]) for s in sketches]

    def bucket_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, the text of each, whether it is of the set's own band): the buckets of each set, for its own band and, where it can have larger partners there, the next."""
        own = np.searchsorted(edges_for(self.need), self.n, "right") - 1
        keys, owners, owns = [], [], []
        bits = mixed((self.flat & U((1 << CHUNK_BITS) - 1)) + U(1))
        for step in (0, 1):
            chunks = np.zeros(len(self.n), np.int64)  # of each part
            spare = np.zeros(len(self.n), np.int64)
            parts = np.zeros(len(self.n), np.int64)
            for i in np.flatnonzero(self.n):
                chunks[i], spare[i], parts[i] = chunks_for(int(self.n[i]), int(own[i]), step, self.need)
            used = np.repeat(chunks > 0, self.n)
            if not used.any():
                continue
            found, bit = self.flat[used], bits[used]
            who = np.repeat(np.arange(len(self.n)), self.n)[used]
            whole = chunks * parts
            chunk = ((found >> U(32)) * whole[who].astype(U)) >> U(32)  # ascending within a set, as its hashes are
            begin = np.cumsum(whole) - whole
            place = begin[who] + chunk.astype(np.int64)
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            many = np.diff(np.append(first, len(place))) > 1
            parity = np.bitwise_xor.reduceat(bit, first)
            who, chunk, place = who[first], chunk[first].astype(np.int64), place[first]
            # parts with too many chunks of fewer than two elements bring all of those along
            unit = np.cumsum(parts) - parts
            of = np.repeat(np.arange(len(self.n)), parts)
            at = unit[who] + chunk // chunks[who]
            poor = chunks[of] - np.bincount(at[many], minlength=len(of))
            all_of = poor > spare[of]
            held = many | all_of[at]
            who, chunk, parity = who[held], chunk[held], parity[held]
            absent = np.ones(int(whole.sum()), bool)
            absent[place[held]] = False
            empty = np.flatnonzero(absent & np.repeat(all_of, chunks[of]))
            whose = np.searchsorted(begin + whole, empty, "right")
            who, chunk, parity = np.append(who, whose), np.append(chunk, empty - begin[whose]), np.append(parity, np.zeros(len(empty), U))
            code = (parts[who] + chunk // chunks[who]).astype(U)
            named = mixed(parity ^ mixed(chunk.astype(U) * U(1 << 20) + (own[who] + step + 1).astype(U)))
            keys.append(((named & ~U(2 * PART_BITS + 1)) | code << U(1)).view(np.int64))
            owners.append(who)
            owns.append(np.full(len(who), step == 0))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *keys]), np.concatenate([none, *owners]), np.concatenate([none.astype(bool), *owns])


def sketch_longs(n: np.ndarray) -> np.ndarray:
    """Longs of a sketch: a power of two, from 2 on, with at least two bits for each element."""
    return 1 << np.maximum(1, np.ceil(np.log2(np.maximum(n, 1) / 32))).astype(np.int64)


def differing(a, b, need: int = NEED):
    """The most elements in which linked sets of these sizes can differ."""
    return ((100 - need) * (a + b)) // (100 + need)


def band_edges(most: int, need: int = NEED) -> list[int]:
    """Where size bands begin: linked sizes lie in one band or in neighbours."""
    edges = [1, 2]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, 100 * (edges[-1] - 1) // need + 1))
    return edges


@functools.cache
def edges_for(need: int) -> np.ndarray:
    return np.array(band_edges(1 << 40, need))


EDGES = edges_for(NEED)


@functools.cache
def parts_of(band: int, need: int = NEED) -> int:
    """Into how many parts the sets that meet in a band are cut."""
    largest, parts = int(edges_for(need)[band + 1]) - 1, 1
    while largest > PART * parts and parts < PARTS:
        parts *= 2
    return parts


def chunks_of(band: int, need: int = NEED) -> tuple[int, int, int]:
    """(chunks of a part, spare ones among them, parts) of the sets that meet in a band."""
    largest, parts = int(edges_for(need)[band + 1]) - 1, parts_of(band, need)
    most = differing(largest, largest, need) // parts
    # about how many chunks hold fewer than two elements, if a chunk holds a tenth less than in the band's largest sets
    mean = 0.9 * (100 + need) / (2 * (100 - need))
    poor = most * np.exp(-mean) * (1 + mean)
    spare = 1 if most < 8 else 1 + int(np.ceil(poor + 1.5 * np.sqrt(poor)))
    return most + 1 + spare, spare, parts


@functools.lru_cache(1 << 16)
def chunks_for(n: int, own: int, step: int, need: int = NEED) -> tuple[int, int, int]:
    """(chunks, spare, parts) of a set of n in its own band or the next (step 1); none where it can't link with another set."""
    band = own + step
    edges = edges_for(need)
    largest = int(edges[band + 1]) - 1
    if step and 100 * n < need * int(edges[band]) or not differing(min(largest, 100 * n // need), n if step else largest, need):
        return 0, 0, 0
    return chunks_of(band, need)


def sets(docs: DataFrame, width: int = WIDTH, need: int = NEED) -> DataFrame:
    """(row, doc_id, n, fp, sketch, codes, local): size, fingerprint, sketch and parts' sketches, end to end, of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, most=SETS_BYTES):
            found = Sets(b.column("text"), width, need)
            longs = [pa.array(x, pa.list_(pa.int64())) for x in (found.sketches(), *found.local())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(found.n), pa.array(found.fingerprints()), *longs], ["row", "doc_id", "n", "fp", "sketch", "codes", "local"])

    return docs.select("row", F.col("doc_id").cast("bigint"), "text").mapInArrow(forgetful(run, forget_hashes), "row bigint, doc_id bigint, n bigint, fp bigint, sketch array<bigint>, codes array<bigint>, local array<bigint>")


def bucket_rows(docs: DataFrame, width: int, need: int, large: np.ndarray) -> DataFrame:
    """(key, fp): the buckets of each class; a task gives a class's buckets once. An odd key marks a large bucket, an odd fp a bucket of the class's own band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: set[int] = set()
        for b in by_bytes(batches, most=SETS_BYTES):
            if len(passed) > CACHE:
                passed.clear()
            found = Sets(b.column("text"), width, need)
            fps = found.fingerprints()
            keys, who, own = found.bucket_keys()
            new = np.zeros(len(fps), bool)
            for i, fp in enumerate(fps.tolist()):
                if fp not in passed:
                    passed.add(fp)
                    new[i] = True
            held = new[who] if len(who) else np.zeros(0, bool)
            keys = keys[held] | np.isin(keys[held], large)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[who[held]] | own[held])], ["key", "fp"])

    return docs.select("text").mapInArrow(forgetful(run, forget_hashes), "key bigint, fp bigint")


def large_buckets(spark: SparkSession, docs: DataFrame, width: int, need: int) -> np.ndarray:
    """The sorted keys of the buckets that hold many of a sample's classes; LARGE_BUCKETS at most."""
    sample = docs.where(F.pmod(F.xxhash64("text", F.lit("buckets")), F.lit(SAMPLED)) == 0)
    counted = bucket_rows(sample, width, need, np.zeros(0, np.int64)).groupBy("key").agg(F.count_distinct(F.col("fp").bitwiseAND(-2)).alias("c")).where(f"c >= {LARGE}")
    counted = saved(spark, counted, "large")
    least = frequent(counted, "c", LARGE_BUCKETS)
    return np.sort(np.array([r.key for r in counted.where(level("c") >= least).select("key").collect()], np.int64))


def folded(sketch, longs):
    """A sketch folded to so many longs: half over half, which keeps it a parity sketch. Linked sizes differ by one fold at most."""
    half = F.slice(sketch, F.lit(1), longs)
    return F.when(F.size(sketch) == longs, sketch).otherwise(F.zip_with(half, F.slice(sketch, longs + 1, longs), lambda a, b: a.bitwiseXOR(b)))


def may_link(a: str, b: str, need: int = NEED):
    """Whether sizes and sketches of the rows a and b leave a link possible."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    longs = F.least(F.size(f"{a}.sketch"), F.size(f"{b}.sketch"))
    apart = F.aggregate(F.zip_with(folded(F.col(f"{a}.sketch"), longs), folded(F.col(f"{b}.sketch"), longs), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (small * 100 >= large * need) & (apart * (100 + need) <= (small + large) * (100 - need))


def local_sketches(classes: DataFrame) -> DataFrame:
    """(fp, n, code, parts, m0, m1, ...): of each part of each class its sketch, then the same folded to FOLDED longs, as whole-number columns."""
    rows = classes.select("fp", "n", "local", F.posexplode("codes").alias("k", "code"))
    longs = [F.get("local", F.col("k") * LOCAL + i) for i in range(LOCAL)]
    folded = [functools.reduce(lambda a, b: a.bitwiseXOR(b), longs[i::FOLDED]) for i in range(FOLDED)]
    parts = F.expr("shiftleft(1L, length(bin(code)) - 1)")
    return rows.select("fp", "n", "code", parts.alias("parts"), *(x.alias(f"m{i}") for i, x in enumerate(longs + folded)))


def local_may_link(a: str, b: str, need: int = NEED):
    """Whether a and b may be linked with no part alike more than the one in which they meet, by sizes and that part's sketches: whole-number columns, as most pairs end here."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    out = small * 100 >= large * need
    for at in (range(LOCAL, LOCAL + FOLDED), range(LOCAL)):
        apart = sum((F.bit_count(F.col(f"{a}.m{i}").bitwiseXOR(F.col(f"{b}.m{i}"))) for i in at), F.lit(0))
        out = out & (apart * F.col(f"{a}.parts") * (100 + need) <= (small + large) * (100 - need))
    return out


def verified(spark: SparkSession, docs: DataFrame, reps: DataFrame, pairs: DataFrame, width: int = WIDTH, need: int = NEED) -> DataFrame:
    """Those of pairs (a, b: fingerprints) whose sets are similar enough; reps: (fp, doc_id)."""
    size = pairs.groupBy("a").agg(F.count("*").alias("members"))
    cut = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / STAR)).alias("part"))
    asked = cut.select("a", "part", F.col("b").alias("fp")).unionByName(cut.select("a", "part", F.col("a").alias("fp")).distinct())
    asked = saved(spark, asked.join(reps, "fp"), "asked")
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").join(asked, "doc_id").repartition("a", "part").sortWithinPartitions("a", "part", F.col("fp") != F.col("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = centre = None
        for b in by_bytes(batches, most=SETS_BYTES):
            left, right = [], []
            found = Sets(b.column("text"), width, need)
            own = found.fingerprints().tolist()
            for i, (a, part, fp) in enumerate(zip(*(b.column(c).to_pylist() for c in ("a", "part", "fp")))):
                if own[i] != fp:  # another row with this id
                    continue
                if a == fp:
                    at, centre = (a, part), found[i].copy()
                elif at == (a, part):
                    mine = found[i]
                    place = np.minimum(np.searchsorted(centre, mine), len(centre) - 1)
                    common = int((centre[place] == mine).sum())
                    if 100 * common >= need * (len(centre) + len(mine) - common):
                        left.append(a), right.append(fp)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return rows.select("a", "part", "fp", "text").mapInArrow(forgetful(run, forget_hashes), "a bigint, b bigint").distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(fp, group) for each end of links (a, b): the smallest fingerprint that links reach."""
    both = saved(spark, links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    now = saved(spark, both.groupBy(F.col("a").alias("fp")).agg(F.least(F.min("b"), F.min("a")).alias("group")), "groups")
    while True:
        near = both.join(now.select(F.col("fp").alias("b"), "group"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("group").alias("near"))
        lower = now.join(near, "fp").select("fp", "group", F.least("group", "near").alias("lower"))
        # a group's root takes the smallest that any of its members has found, and each member its root's
        roots = lower.groupBy(F.col("group").alias("root")).agg(F.min("lower").alias("to"))
        step = lower.join(roots, lower["group"] == roots["root"]).select("fp", F.least("lower", "to").alias("group"), F.col("group").alias("was"))
        step = saved(spark, step, "groups")
        forget(spark, now)
        if step.where("group != was").isEmpty():
            forget(spark, both)
            return step.select("fp", "group")
        now = step


def linked_rows(spark: SparkSession, docs: DataFrame, width: int = WIDTH, need: int = NEED) -> DataFrame:
    """(row, doc_id, n, group, component_id) of each row of docs (row, doc_id, text); group is null for empty sets."""
    bounded_batches(spark, STAGE_BYTES)
    members = saved(spark, sets(docs, width, need), "sets")
    classes = saved(spark, members.where("n > 0").groupBy("fp", "n", "sketch", "codes", "local").agg(F.min("doc_id").alias("doc_id")), "classes")
    # of the rows, sketches are of no more use
    whole, members = members, saved(spark, members.select("row", "doc_id", "n", "fp"), "members")
    forget(spark, whole)
    reps, shape = classes.select("fp", "doc_id"), classes.select("fp", "n", "sketch")

    is_large, fp = F.col("key").bitwiseAND(1) == 1, F.col("fp").bitwiseAND(-2)
    by_key = Window.partitionBy("key", F.when(is_large, F.pmod(F.shiftright("fp", 1), F.lit(SALTS))).otherwise(0))
    met = bucket_rows(docs, width, need, large_buckets(spark, docs, width, need))
    met = met.select("*", F.min(fp).over(by_key).alias("least"), F.max(fp).over(by_key).alias("most"), F.max(F.col("fp").bitwiseAND(1)).over(by_key).alias("useful"))
    met = met.where(is_large | ((F.col("least") != F.col("most")) & (F.col("useful") == 1)))
    met = saved(spark, met.select("key", fp.alias("fp"), (F.col("fp").bitwiseAND(1) == 1).alias("own")), "met")
    # the head of a bucket is its member that meets others in most buckets: an original rather than one of its edited copies
    weight = met.groupBy("fp").agg(F.count("*").alias("weight"))
    shared = saved(spark, met.join(weight, "fp").distinct(), "buckets")
    forget(spark, met)

    def possible(pairs: DataFrame) -> DataFrame:
        x, y = shape.select(F.col("fp").alias("a"), F.struct("n", "sketch").alias("x")), shape.select(F.col("fp").alias("b"), F.struct("n", "sketch").alias("y"))
        return pairs.join(x, "a").join(y, "b").where(may_link("x", "y", need)).drop("x", "y")

    def headed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.max(F.struct("own", "weight", "fp"))["fp"].alias("head"))

    # each class first meets that one of its buckets' heads with which it shares most buckets
    heads = shared.select("key", "fp").join(headed(shared), "key").where("fp != head").groupBy(F.col("head").alias("a"), F.col("fp").alias("b")).agg(F.count("*").alias("in_common"))
    pairs = heads.groupBy("b").agg(F.max_by("a", F.struct("in_common", "a")).alias("a")).select("a", "b")
    links = saved(spark, verified(spark, docs, reps, saved(spark, possible(pairs), "pairs"), width, need), "links")
    groups = components(spark, links)

    def several(rows: DataFrame) -> DataFrame:
        """Rows (key, fp, own, weight) with their group, of the buckets where different groups still meet."""
        found = saved(spark, rows.join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp")), "grouped")
        spread = found.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.max("own").alias("useful")).where("low != high and useful").select("key")
        out = saved(spark, found.join(spread, "key"), "left")
        forget(spark, found)
        return out

    left = several(shared)
    forget(spark, shared)
    # of each group that a head's bucket holds besides its own, the member that meets most others meets the head
    own = left.select(F.col("fp").alias("head"), F.col("group").alias("own_group")).distinct()
    others = left.join(headed(left).join(own, "head"), "key").where("group != own_group")
    one = others.groupBy("key", "head", "own_group", "group").agg(F.max_by("fp", F.struct("weight", "fp")).alias("fp"))
    two = one.groupBy("own_group", "group", F.least("head", "fp").alias("a"), F.greatest("head", "fp").alias("b")).agg(F.count("*").alias("in_common"))
    pairs = two.groupBy("own_group", "group").agg(F.max_by(F.struct("a", "b"), F.struct("in_common", "a", "b")).alias("p")).select("p.*").distinct()
    pairs = saved(spark, possible(pairs), "pairs")
    if not pairs.isEmpty():
        links = saved(spark, links.union(verified(spark, docs, reps, pairs, width, need)), "links")
        groups = components(spark, links)

    # the rest, whole: members of different groups that share a bucket and whose sizes and sketches allow a link, once each
    left = several(left.select("key", "fp", "own", "weight"))
    # a pair of sets of one part is told by the first bucket that it shares; one of more parts by each, as only some part's sketches need to be alike
    left = left.withColumn("code", F.shiftright("key", 1).bitwiseAND(PART_BITS))
    single = lambda own: F.collect_list(F.when((F.col("code") == 1) & (F.col("own") == own), F.col("key")))
    lists = left.groupBy("fp").agg(single(True).alias("ours"), single(False).alias("theirs"))
    lists = lists.select("fp", *(F.when(F.size("ours") + F.size("theirs") <= LISTED, F.col(c)).alias(c) for c in ("ours", "theirs")))
    left = saved(spark, left.join(local_sketches(classes), ["fp", "code"]).join(lists, "fp").drop("weight"), "listed")
    x, y = left.alias("x"), left.alias("y")
    common = lambda i, j: F.array_min(F.array_intersect(i, j))
    first = F.least(common("x.ours", "y.ours"), common("x.ours", "y.theirs"), common("x.theirs", "y.ours"))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.group") < F.col("y.group")) & (F.col("x.own") | F.col("y.own")) & local_may_link("x", "y", need) & ((F.col("x.code") > 1) | first.isNull() | (first == F.col("x.key"))))
    rest = saved(spark, rest.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct(), "rest")
    rest = saved(spark, possible(rest), "rest")
    if not rest.isEmpty():
        links = saved(spark, links.union(verified(spark, docs, reps, rest, width, need)), "links")
        groups = components(spark, links)

    rooted = classes.select("fp", "doc_id").join(groups, "fp", "left").select("fp", "doc_id", F.coalesce("group", "fp").alias("group"))
    lowest = rooted.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(lowest, "group").select("fp", "group", "component_id")
    empty = F.col("n") == 0
    return members.join(named, "fp", "left").select("row", "doc_id", "n", F.when(~empty, F.col("group")).alias("group"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text)."""
    got = linked_rows(spark, docs.select(F.lit(0).cast("bigint").alias("row"), "doc_id", "text"))
    return got.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked documents, the row with the smallest doc_id stays; documents without words stay. Linked are those alike in 80 % of their shingles of five words.

    Rows are told apart by numbers that are written with them once: numbered anew, a scan that is split otherwise would give other rows these numbers.
    """
    marked = saved(spark, docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    got = saved(spark, linked_rows(spark, marked.select("row", "doc.doc_id", "doc.text"), STAGE_WIDTH, STAGE_NEED).where("group is not null").select("row", "doc_id", "group"), "groups")
    first = got.groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    gone = saved(spark, got.join(first, "group").where("row != first.row").select("row"), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return marked.join(gone, "row", "left_anti").select("doc.*")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}

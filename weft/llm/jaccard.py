r"""N-gram Jaccard self-join by universe partitioning and the pigeonhole principle.

Sets are the distinct word 5-grams of a text as 64-bit hashes. Two sets of sizes a and b with a Jaccard similarity of
at least 4/5 differ in at most H = (a + b) // 9 elements. Sizes fall into bands such that similar
sets lie in one band or in neighbouring ones. In band k the universe of n-grams is hashed into m_k segments. If
two sets differ in at most H elements, then among any choice of segments with allocations v_i (1: compare the subset of the
segment; 2: also its one-deletion neighbourhood) that sum to H + 1, at least one segment's subsets differ by less than v_i.

Every set is indexed by its subsets in its own band, and probes its own band and the one below. Which segments a set
probes is chosen by cost, from what is known after the signatures have met:

* A signature that no other set has costs nothing, nor does one that is shared within one
  component of sets known to be connected. A set with H + 1 such segments has no other partner at all.
* The others are compared at the finest partition, n-gram by n-gram, the rarest first, with the sets that the fewest
  further segments they need, those of least frequency, lead to.
* Empty segments aren't compared. A set left with too few others takes allocations of 2 for its
  largest segments, and bands where that happens index one-deletion neighbourhoods, too. In the rest of the cases, sets
  of a few n-grams, single n-grams of the set's prefix are compared.

Between the two, each set is verified against the set that it shares most signatures with, and components are
formed, so large groups of near copies are joined through few sets and never expanded into pairs. Then sets that still
share signatures with other components are tried against a few of these, while that joins many; the links found join
components, not sets, so that graph shrinks from round to round. What remains is enumerated, between sets that must probe and
members of other components, and verified. Components are exact: no candidate is capped or sampled.

Shuffles: the signatures once (8 bytes and the set's hash), those that two or more sets share, and n-grams
of sets in candidate pairs. Copies have one hash, so they are one set everywhere. Of a signature that many sets of a task
have, the task sends two rows to where it is compared, the others go straight on with the task's first set as their hub:
no task gets more than two rows of a signature from each chunk of a task. Tables of a round are deleted with the next.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, dropped, pieces, shared_dir, table, texts, unused, written
from .graph import components

N, NUM, DEN = 5, 4, 5  # words of an n-gram; similarity of NUM / DEN or more
OWN, INDEX, LOW, EXTRA = range(4)  # what a signature row is: indexed and probed, indexed, probed in the band below, probed for want of segments
TRIES, FEW, BITS = 4, 20, 1 << 24
SKETCH = 4  # longs of a set's sketch
CHUNK = 1 << 20  # signatures of a task that are looked through together
_U = np.uint64
_SALTS = {"segment": _U(0x9E3779B97F4A7C15), "subset": _U(0xC2B2AE3D27D4EB4F), "deleted": _U(0x165667B19E3779F9), "single": _U(0x27D4EB2F165667C5), "set": _U(0x85EBCA77C2B2AE63), "word": _U(0xFF51AFD7ED558CCD), "sketch": _U(0xC4CEB9FE1A85EC53)}


def mix(x):
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return lower, blank, mix(np.arange(1, 64 * 256 + 1, dtype=_U) * _SALTS["word"])


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lowered: the sum of a random number for each byte and place, mixed with the length."""
    lower, blank, random = _TABLES
    a = lower[np.frombuffer(text.encode(), np.uint8)]
    gap = np.flatnonzero(blank[a])
    bounds = np.concatenate(([-1], gap, [len(a)]))
    lengths = np.diff(bounds) - 1
    starts = bounds[:-1][lengths > 0] + 1
    lengths = lengths[lengths > 0]
    if not len(starts):
        return np.empty(0, _U)
    offsets = np.cumsum(lengths) - lengths
    place = np.arange(offsets[-1] + lengths[-1]) - np.repeat(offsets, lengths)
    byte = a[place + np.repeat(starts, lengths)]
    with np.errstate(over="ignore"):
        value = random[(place & 63) << 8 | byte]
        if lengths.max() > 64:
            value = value * (mix((place >> 6).astype(_U)) | _U(1))
        return mix(np.add.reduceat(value, offsets) + lengths.astype(_U))


def shingles(text: str, n: int = N) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text; of a shorter text, the hash of its whole sequence."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(n, len(w))
    with np.errstate(over="ignore"):
        h = np.zeros(len(w) - k + 1, _U)
        for j in range(k):
            h = h * _U(0xD6E8FEB86659FD93) + w[j : len(w) - k + 1 + j]
    return np.unique(mix(h + _U(k)))


_TABLES = _tables()


def set_hash(h: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(h ^ _SALTS["set"]).sum(dtype=_U) + _U(len(h))).astype(np.int64))


def sketch(h: np.ndarray) -> tuple[int, ...]:
    """The parities of the set's n-grams in SKETCH x 64 places, as signed longs: sets that differ in d elements differ in d places at most."""
    bits = np.bincount((mix(h ^ _SALTS["sketch"]) & _U(SKETCH * 64 - 1)).astype(np.int64), minlength=SKETCH * 64) & 1
    return tuple(np.packbits(bits.astype(np.uint8)).view(np.int64).tolist())


def most(a: int, b: int) -> int:
    """Elements in which similar sets of these sizes may differ."""
    return (DEN - NUM) * (a + b) // (DEN + NUM)


def _bands() -> list[int]:
    top, out = 1, [1]
    while top < 1 << 40:
        top = max(top + 1, top * DEN * DEN // (NUM * NUM))
        out.append(top)
    return out


TOPS = _bands()  # the largest size of each band


def segments(band: int) -> int:
    """Segments of a band: enough for the largest difference, and some to spare for empty ones."""
    top = TOPS[band]
    need = most(top * DEN // NUM, top) + 1
    return 1 if need == 1 else need + 2 + need // 24


def _segments_of(h: np.ndarray, band: int, m: int) -> tuple[np.uint64, np.ndarray]:
    seed = mix(_SALTS["segment"] + _U(band))
    seg = ((mix(h ^ seed) >> _U(32)) * _U(m)) >> _U(32)
    return seed, seg.astype(np.uint16 if m < 65536 else np.uint32)  # short integers sort by radix


def filled(h: np.ndarray, band: int) -> int:
    """How many segments of the band a set reaches."""
    m = segments(band)
    return int(np.count_nonzero(np.bincount(_segments_of(h, band, m)[1], minlength=m)))


class Cut:
    """A set cut into the segments of a band."""

    def __init__(self, h: np.ndarray, band: int) -> None:
        m = segments(band)
        seed, seg = _segments_of(h, band, m)
        order = np.argsort(seg, kind="stable")
        seg = seg[order]
        self.h = h[order]
        self.value = mix(self.h ^ _SALTS["subset"])
        starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1]))) if len(seg) else np.empty(0, np.int64)
        self.sizes = np.diff(np.append(starts, len(seg)))
        with np.errstate(over="ignore"):
            self.sums = np.add.reduceat(self.value, starts) if len(starts) else np.empty(0, _U)
            self.tags = mix(seed + (seg[starts].astype(_U) << _U(8)))
        self.of = np.repeat(np.arange(len(starts)), self.sizes)

    def keys(self, sums: np.ndarray, tags: np.ndarray, space: str) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(sums + tags * _SALTS[space])

    def exact(self) -> np.ndarray:
        return self.keys(self.sums, self.tags, "subset")

    def without(self, which: np.ndarray, space: str) -> np.ndarray:
        """Signatures of the segments chosen (by mask, two elements at least) with one element left out."""
        at = np.flatnonzero((which & (self.sizes > 1))[self.of])
        with np.errstate(over="ignore"):
            return self.keys(self.sums[self.of[at]] - self.value[at], self.tags[self.of[at]], space)

    def singles(self, count: int | None = None) -> np.ndarray:
        h = np.sort(self.h)[:count]
        return self.keys(mix(h ^ _SALTS["single"]), np.full(len(h), _SALTS["single"]), "single")


def needs(n: int) -> tuple[int, int, int, int]:
    """(own band, H of own + 1, band below or -1, H there + 1); where H is 0 only equal sets are similar: none is needed."""
    band = bisect_left(TOPS, n)
    own = most(n, n) + 1 if most(n, n) else 0
    low, below = -1, 0
    if band and NUM * n <= DEN * TOPS[band - 1] and most(n, TOPS[band - 1]):
        low, below = band - 1, most(n, TOPS[band - 1]) + 1
    return band, own, low, below


def spare(h: np.ndarray) -> tuple[int, int, int]:
    """band, and how many segments the set has beyond those it needs, in its own band and below (negative: too few)."""
    band, own, low, below = needs(len(h))
    return band, (filled(h, band) - own if own else 0), (filled(h, low) - below if low >= 0 else 0)


def signatures(h: np.ndarray, deleting: frozenset[int]) -> np.ndarray:
    """Signature rows as signed longs: 62 bits of signature, 2 of what the row is."""
    out: list[tuple[np.ndarray, int]] = []
    band, own, low, below = needs(len(h))

    def missing(cut: Cut, need: int) -> None:
        lack = need - len(cut.sums)
        if lack <= 0:
            return
        big = np.argsort(-cut.sizes, kind="stable")[:lack]
        which = np.zeros(len(cut.sums), bool)
        which[big[cut.sizes[big] > 1]] = True
        out.append((cut.without(which, "subset"), EXTRA))
        out.append((cut.keys(cut.sums[which], cut.tags[which], "deleted"), EXTRA))
        if which.sum() < lack:
            out.append((cut.singles(len(h) - -(-len(h) * NUM // DEN) + 1), EXTRA))

    cut = Cut(h, band)
    if most(len(h) * DEN // NUM, len(h)):
        out.append((cut.exact(), OWN))
        if band in deleting:
            out.append((cut.without(np.ones(len(cut.sums), bool), "deleted"), INDEX))
            out.append((cut.singles(), INDEX))
        if own:
            missing(cut, own)
    if low >= 0:
        cut = Cut(h, low)
        out.append((cut.exact(), LOW))
        missing(cut, below)
    if not out:
        return np.empty(0, np.int64)
    return np.concatenate([(k & ~_U(3)) | _U(kind) for k, kind in out]).astype(np.int64)


_SETS = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("band", pa.int32()), ("spare_own", pa.int64()), ("spare_low", pa.int64()), *[(f"s{k}", pa.int64()) for k in range(SKETCH)]])
SETS = "doc_id long, t long, n long, fp long, band int, spare_own long, spare_low long, " + ", ".join(f"s{k} long" for k in range(SKETCH))
_ROWS = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("hub", pa.int64())])
ROWS = "key long, fp long, hub long"


def row_hash() -> Column:
    """64 bits of the text (null: empty), and of whether there is a doc_id."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").isNull())


def _describe(batches):
    for batch in pieces(batches, "text"):
        rows = []
        for text in batch.column("text").to_pylist():
            h = shingles(text)
            rows.append((len(h), set_hash(h), *(spare(h) if len(h) else (0, 0, 0)), *sketch(h)))
        yield batch_of(_SETS, {"doc_id": batch.column("doc_id"), "t": batch.column("t")} | dict(zip(_SETS.names[2:], zip(*rows, strict=True), strict=True)))


def _routed(keys: np.ndarray, fps: np.ndarray):
    """Rows of a chunk; hub is null in those to compare elsewhere: the first two sets of each signature. The other sets
    of a signature have the first as their hub already."""
    sig = keys >> 2
    order = np.lexsort((fps, sig))
    s, f = sig[order], fps[order]
    first = np.concatenate(([True], s[1:] != s[:-1]))
    begin = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    other = f != f[begin][run]
    # Of each signature the second set's rows are those equal to the least set that is not the first.
    third = np.zeros(len(s), bool)
    rest = np.flatnonzero(other)
    if len(rest):
        head = np.concatenate(([True], run[rest][1:] != run[rest][:-1]))
        second = f[rest][head][np.cumsum(head) - 1]
        third[rest] = f[rest] != second
    hubs = pa.array(f[begin][run], mask=~third)
    k = keys[order]
    for at in range(0, len(k), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(k[at : at + 200_000]), pa.array(f[at : at + 200_000]), hubs[at : at + 200_000]], schema=_ROWS)


def _sign(deleting: frozenset[int], chunk: int):
    def run(batches):
        seen, keys, fps, n = set(), [], [], 0
        for batch in pieces(batches, "text"):
            for text in batch.column("text").to_pylist():
                h = shingles(text)
                if not len(h) or (fp := set_hash(h)) in seen:  # copies within a task are signed once
                    continue
                seen.add(fp)
                keys.append(signatures(h, deleting))
                fps.append(np.full(len(keys[-1]), fp, np.int64))
                n += len(keys[-1])
                if n >= chunk:
                    yield from _routed(np.concatenate(keys), np.concatenate(fps))
                    keys, fps, n = [], [], 0
        if n:
            yield from _routed(np.concatenate(keys), np.concatenate(fps))

    return run


def _shared(batches):
    """Of rows sorted by key and fp: those whose signature two sets or more have, with the signature's first set.

    Rows that have a hub pass. Streams: what is held back are rows of a signature's first set until another set is met."""
    last_key = last_fp = hub = None
    several, held = True, np.empty(0, np.int64)
    for batch in batches:
        done = batch.column(2).is_valid()
        ready = batch.filter(done)
        if ready.num_rows:
            yield ready
            batch = batch.filter(pc.invert(done))
        k = batch.column(0).to_numpy()
        f = batch.column(1).to_numpy()
        if not len(k):
            continue
        new = np.empty(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
        new[0] = last_key is None or k[0] != last_key or f[0] != last_fp
        before = last_key
        last_key, last_fp = int(k[-1]), int(f[-1])
        k, f = k[new], f[new]
        if not len(k):
            continue
        s = k >> 2
        first = np.empty(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        first[0] = before is None or s[0] != before >> 2
        at = np.flatnonzero(first)
        run = np.cumsum(first) - (0 if not first[0] else 1)  # 0: the run carried on, if there is one
        hubs = f[at] if first[0] else np.concatenate(([hub], f[at]))
        h = hubs[run]
        other = f != h
        begin = at if first[0] else np.concatenate(([0], at))
        multi = np.logical_or.reduceat(other, begin)
        parts = []
        if first[0]:
            held = held[:0]
        elif (multi[0] or several) and len(held):
            parts.append((held, np.full(len(held), hub, np.int64), np.full(len(held), hub, np.int64)))
            held = held[:0]
        if not first[0]:
            multi[0] |= several
        take = multi[run]
        parts.append((k[take], f[take], h[take]))
        tail = run == run[-1]
        more = k[tail] if not multi[-1] else k[:0]
        held = np.concatenate((held, more)) if len(multi) == 1 and not first[0] else more
        hub, several = int(hubs[-1]), bool(multi[-1])
        k, f, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f), pa.array(h)], schema=_ROWS)


def _as_sets(batches):
    for batch in pieces(batches, "text"):
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([set_hash(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["fp", "grams"])


def _as_grams(batches):
    """Rows of (set, n-gram)."""
    for batch in pieces(batches, "text"):
        for text in batch.column("text").to_pylist():
            h = shingles(text)
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), set_hash(h), np.int64)), pa.array(h.astype(np.int64))], names=["fp", "gram"])


def _similar(batches):
    for batch in batches:
        out = []
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("comp_a", "comp_b", "grams_a", "grams_b")), strict=True):
            x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if DEN * both >= NUM * (len(x) + len(y) - both):
                out.append((a, b))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["u", "v"])


class Join:
    """One self-join of a documents table; steps are tables in a folder of the shared directory."""

    def __init__(self, docs: DataFrame) -> None:
        self.spark = docs.sparkSession
        self.docs = texts(docs).withColumn("t", row_hash())
        self.folder = shared_dir(self.spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        dropped(self.spark, *[f"{self.folder}/{n}" for n in names])

    def wanted(self, fps: DataFrame, most_fps: int, make, schema: str) -> DataFrame:
        """``make`` over one document of each set in ``fps`` (fp; ``most_fps`` rows at most).

        Few sets: their documents set bits in a map of fixed size, and documents without a bit there are passed over,
        without a shuffle of texts; those that share a bit by chance yield sets that nothing is joined with. More sets
        than an eighth of the bits: documents are joined with the sets' keys."""
        keys = fps.join(self.classes.select("fp", "lead"), "fp").select("lead.*")
        if most_fps * 8 > BITS:
            keys = keys.select(F.coalesce("doc_id", F.lit(0)).alias("d"), "t").distinct()
            rows = self.docs.withColumn("d", F.coalesce("doc_id", F.lit(0))).join(keys, ["d", "t"], "left_semi")
            return rows.select("text").mapInArrow(make, schema)
        bit = lambda: F.pmod(F.xxhash64("doc_id", "t"), F.lit(BITS))
        words = keys.select(bit().alias("bit")).groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).collect()
        bits = np.zeros(BITS // 64, np.int64)
        bits[[r.word for r in words]] = [r.bits for r in words]
        shared = self.spark.sparkContext.broadcast(bits.view(np.uint8))

        def run(batches):
            bitmap = shared.value
            for batch in batches:
                at = batch.column("bit").to_numpy()
                batch = batch.filter(pa.array((bitmap[at >> 3] >> (at & 7) & 1).astype(bool)))
                if batch.num_rows:
                    yield batch

        return self.docs.select("text", bit().alias("bit")).mapInArrow(lambda batches: make(run(batches)), schema)

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Edges (u, v) between the components comp_a, comp_b of the pairs (a, b) that are similar."""
        swap = F.col("a") > F.col("b")
        turned = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("comp_a", "comp_b"), ("comp_b", "comp_a"))]
        pairs = self.write(pairs.select(*turned).distinct(), f"{name}/pairs")
        fps = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
        sets = self.wanted(fps, 2 * pairs.count(), _as_sets, "fp long, grams binary").dropDuplicates(["fp"])
        sets = self.write(sets, f"{name}/sets")
        both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("grams").alias("grams_a")), "a").join(sets.select(F.col("fp").alias("b"), F.col("grams").alias("grams_b")), "b")
        edges = self.write(both.mapInArrow(_similar, "u long, v long"), f"{name}/edges")
        self.drop(f"{name}/pairs", f"{name}/sets")
        return edges

    def run(self) -> DataFrame:
        self.sets = self.write(self.docs.mapInArrow(_describe, SETS), "described")
        lead = F.min(F.struct("doc_id", "t")).alias("lead")
        self.classes = self.write(
            self.sets.where("n > 0").groupBy("fp").agg(lead, F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("spare_own").alias("spare_own"), F.min("spare_low").alias("spare_low"), F.min("band").alias("band"), *[F.min(f"s{k}").alias(f"s{k}") for k in range(SKETCH)]), "classes"
        )
        # The bands in which some set has too few segments: as many rows as there are bands, about 10 per factor of 10 in size.
        short = self.classes.select(F.explode(F.array(F.when(F.col("spare_own") < 0, F.col("band")), F.when(F.col("spare_low") < 0, F.col("band") - 1))).alias("b")).where("b is not null").agg(F.collect_set("b").alias("b"))
        deleting = frozenset(short.first().b)
        rows = self.docs.select("text").mapInArrow(_sign(deleting, CHUNK), ROWS)
        place = F.when(F.col("hub").isNull(), F.shiftright("key", 2)).otherwise(F.xxhash64("key", "fp"))
        met = rows.repartition(place).sortWithinPartitions("key", "fp").mapInArrow(_shared, ROWS)
        shared = self.write(met, "shared")
        # Each set against the one that it shares most signatures with.
        best = shared.where("fp <> hub").repartition("fp").groupBy("fp", "hub").agg(F.count("*").alias("c")).groupBy("fp").agg(F.max(F.struct("c", "hub")).alias("x"))
        # Similar sets share half of their signatures; those that share a few only are left to the full enumeration.
        likely = best.join(self.classes.select("fp", "n"), "fp").where(F.col("x.c") * 20 >= F.col("n"))
        edges = self.verified(likely.select(F.col("fp").alias("a"), F.col("x.hub").alias("b"), F.col("fp").alias("comp_a"), F.col("x.hub").alias("comp_b")), "hubs")
        known = components(edges, f"{self.folder}/known")
        self.named = self.write(self.classes.join(known, F.col("fp") == F.col("node"), "left").select("fp", "rep", "n", "spare_own", "spare_low", F.coalesce("component", "fp").alias("comp")), "named")
        self.drop("known", "hubs")
        rows = shared.select("fp", F.shiftright("key", 2).alias("sig"), F.col("key").bitwiseAND(3).cast("int").alias("kind")).join(self.named.drop("rep"), "fp")
        open_, k, links = self.open_rows(rows, 0), 0, []
        self.drop("shared")
        chosen, n_chosen = self.chosen(open_, k)
        while n_chosen:
            # Each open set against a few others in the largest components that it meets, while that connects many.
            links.append(more := self.verified(self.tried(chosen, open_, k), f"try{k}"))
            n_more = more.count()
            if not n_more:
                break
            # Links join the components themselves, so this graph has one node for each of them.
            moved = components(more, f"{self.folder}/comp{k}")
            moved = open_.join(moved, F.col("comp") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "comp")).drop("node", "component", "others")
            open_ = self.open_rows(moved, k + 1)
            self.drop(f"open{k}", f"chosen{k}", f"comp{k}")
            before, k = n_chosen, k + 1
            chosen, n_chosen = self.chosen(open_, k)
            if n_more * FEW < before:
                break
        if n_chosen:
            links.append(self.verified(self.all_pairs(chosen, open_), "rest"))
        return self.labelled(links)

    def open_rows(self, rows: DataFrame, k: int) -> DataFrame:
        """Of rows (fp, sig, kind, comp, ...) those of signatures that sets of two components or more have."""
        rows = self.write(rows, f"all{k}")
        mixed = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("others")).where("lo <> hi").select("sig", "others")
        out = self.write(rows.join(mixed, "sig"), f"open{k}")
        self.drop(f"all{k}")
        return out

    def chosen(self, open_: DataFrame, k: int) -> tuple[DataFrame, int]:
        """The signatures that sets without enough costless segments must probe, those of least frequency first; and about how many sets these are."""
        spare_ = F.when(F.col("kind") == OWN, F.col("spare_own")).otherwise(F.col("spare_low"))
        by = Window.partitionBy("fp", "kind")
        lacking = (F.col("spare_own") < 0) | (F.col("spare_low") < 0)
        rows = open_.where(F.col("kind") != INDEX).withColumn("n_mixed", F.count("*").over(by)).withColumn("at", F.row_number().over(by.orderBy("others", "sig")))
        take = F.when(F.col("kind") == EXTRA, lacking).otherwise((spare_ < 0) | (F.col("at") <= F.col("n_mixed") - spare_))
        out = self.write(rows.where(take).select("fp", "sig", "comp", "n", "others"), f"chosen{k}")
        return out, out.agg(F.approx_count_distinct("fp")).first()[0]

    def tried(self, chosen: DataFrame, open_: DataFrame, k: int) -> DataFrame:
        """A few pairs for each open set: members, drawn by hash, of the component that has most rows of a signature."""
        members = open_.where(F.col("kind") <= INDEX)
        draw = F.struct(F.xxhash64("fp", "sig", F.lit(k)), "fp")
        per = members.groupBy("sig", "comp").agg(F.count("*").alias("c"), F.min(draw).alias("d"))
        largest = per.groupBy("sig").agg(F.max(F.struct("c", F.col("comp").alias("other"), F.col("d.fp").alias("b"))).alias("x")).select("sig", "x.other", "x.b")
        pairs = chosen.join(largest, "sig").where("comp <> other").withColumn("at", F.row_number().over(Window.partitionBy("fp").orderBy(F.xxhash64("sig", F.lit(k)))))
        return pairs.where(F.col("at") <= TRIES).select(F.col("fp").alias("a"), "b", F.col("comp").alias("comp_a"), F.col("other").alias("comp_b"))

    def all_pairs(self, chosen: DataFrame, open_: DataFrame) -> DataFrame:
        """All pairs that may still be similar, of a set that probes and a set of another component indexed at a signature that it probes.

        The finest partition: every n-gram is a segment, allocated rarest first. Of similar sets the first common n-gram in
        that order has at most H of their n-grams before it, so it stands in the prefix of both, and no more
        n-grams than the overlap needs are left behind it. N-grams of one set only have no row, they count as places.
        Of n-grams that one component alone has no pair is made, so components are not expanded, nor of sets whose sketches
        differ in more places than similar sets may in elements."""
        met = open_.where(F.col("kind") <= INDEX).join(chosen.select("sig").distinct(), "sig", "left_semi").select("fp", "n", "comp", F.lit(0).alias("probes"))
        ids = met.unionByName(chosen.select("fp", "n", "comp", F.lit(1).alias("probes"))).groupBy("fp").agg(F.max("n").alias("n"), F.max("comp").alias("comp"), F.max("probes").alias("probes"))
        sketches = [f"s{k}" for k in range(SKETCH)]
        ids = self.write(ids.join(self.classes.select("fp", *sketches), "fp"), "rest/ids")
        grams = self.write(self.wanted(ids.select("fp"), ids.count(), _as_grams, "fp long, gram long").join(ids, "fp").distinct(), "rest/grams")
        common = grams.groupBy("gram").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("df > 1")
        rows = grams.join(common, "gram")
        by = Window.partitionBy("fp")
        rank = F.row_number().over(by.orderBy("df", "gram")) + F.col("n") - F.count("*").over(by)
        rows = rows.select("fp", "gram", "comp", "n", "probes", *sketches, "lo", "hi", rank.alias("at")).where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1) & (F.col("lo") != F.col("hi")))
        rows = self.write(rows.drop("lo", "hi"), "rest/prefixes")
        other = rows.select(F.col("fp").alias("b"), "gram", F.col("comp").alias("comp_b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), F.col("probes").alias("probes_b"), *[F.col(c).alias(f"{c}_b") for c in sketches])
        overlap = F.ceil((F.col("n") + F.col("n_b")) * NUM / (NUM + DEN))
        behind = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")) + 1
        once = (F.col("probes_b") == 0) | (F.col("fp") < F.col("b"))
        apart = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in sketches)
        near = apart <= F.floor((F.col("n") + F.col("n_b")) * (DEN - NUM) / (DEN + NUM))
        found = rows.where("probes = 1").join(other, "gram").where((F.col("comp") != F.col("comp_b")) & once & (behind >= overlap) & near)
        return found.select(F.col("fp").alias("a"), "b", F.col("comp").alias("comp_a"), "comp_b")

    def labelled(self, links: list[DataFrame]) -> DataFrame:
        """doc_id, n_shingles, component_id of every document, with comp (its component, whatever the ids) and t (hash of its row).

        links: edges between components."""
        named = self.named.select("fp", "rep", "comp")
        if links:
            every = links[0]
            for more in links[1:]:
                every = every.unionByName(more)
            moved = components(every, f"{self.folder}/final")
            named = named.join(moved, F.col("comp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "comp").alias("comp"))
        named = self.write(named, "labels")
        least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
        ids = named.join(least, "comp").select("fp", "comp", "component_id")
        out = self.sets.select("doc_id", "t", "n", "fp").where("n > 0").join(ids, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "comp", "t")
        return out.unionByName(self.sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("t").alias("comp"), "t"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every document.

    A null or wordless text has no n-grams and is its own component; fewer than five words are one n-gram;
    equal sets are linked; repeated rows are returned as often as they stand there; a null doc_id is never
    least unless all of a component are null; an empty table gives an empty result; other columns are not read.
    Similarity is that of the 64-bit hashes of n-grams."""
    return Join(docs).run().select("doc_id", "n_shingles", "component_id")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, with its own columns: that of the least doc_id, whatever other texts share it.

    Components count, not ids: rows without an id, or with one id, stay if their texts aren't linked. Of a component's
    rows with the least doc_id the one with the least hash of its text stays; of rows that share doc_id and text one stays.
    Other columns may have any names. An empty table stays empty. Texts are shuffled once: rows of one doc_id and text
    meet where the join is made."""
    d, t = unused(docs, "_d", "_t")
    lead = Join(docs).run().where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "comp").agg(F.min("t").alias(t)).select(F.coalesce("doc_id", F.lit(0)).alias(d), t).distinct()
    rows = docs.withColumn(d, F.coalesce("doc_id", F.lit(0))).withColumn(t, row_hash())
    return rows.join(lead, [d, t], "left_semi").dropDuplicates([d, t]).select(*docs.columns)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))

"""N-gram Jaccard join with PartEnum signatures.

Equal sets are collapsed by digest (two sums over independent 64-bit hashes).
Sets fall into size bands; for each band
the shingle domain is cut by hash into n1 parts of three sub-parts, where n1
exceeds half the largest symmetric difference that a linked pair can have.
Some part then holds at most one difference, so two of its three sub-parts
agree: enumerating the pairs of sub-parts gives signatures of which any linked
pair shares one.  A few parts are spare, so that as many parts more hold at
most one difference: a set in which no more parts than these have an empty pair
of sub-parts needs no signature of nothing, which unrelated sets would share.  Sets that share a signature are compared with the first of
them (a star, never all pairs) and verified exactly.  Where a star leaves a
signature's sets in several components, the remaining pairs across components
are verified too, less those that the triangle inequality of the Jaccard
distance rules out; a signature with many such sets is cut into blocks of
BLOCK sets, and every pair of blocks is a join key of its own.  Before a pair
is verified its parity sketches are compared, short ones first and then some
as long as the sets need: the number of bits in which they differ never exceeds
the symmetric difference of the sets, so what they rule out is no link; none is
lost.

Signatures are never stored: they are computed from the texts of distinct sets
on their way into one range partitioning together with their sets, so one
signature held by most sets is spread over tasks, and stars are written as a
stream.  Texts meet the sets that are wanted by broadcast while these are at
most BROADCAST_ROWS rows, else by a join.

Defined cases: null and empty texts have empty sets and link with nothing;
texts below three words have one shingle of all words; rows with equal sets
share a component even if their ids repeat; a row with a null id joins in and
never names a component of others; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import U64, Words, chunks, mix64, range_hashes, signed, sort_within
from .components import components
from .shared import stored

PERCENT, GRAM = 90, 3
#: 64-bit words of a parity sketch.
SKETCH = 8
#: Most rows of (row, doc_id, tk), 24 bytes each, that are broadcast.
BROADCAST_ROWS = 1 << 18
#: Most bytes of sketches or sets that are broadcast.
BROADCAST_BYTES = 8 << 20
#: Sets of one signature that are compared with each other in one task.
BLOCK = 512


def shingles(words: Words, gram: int = GRAM, *seeds: int) -> tuple[np.ndarray, ...]:
    """(hash, owner) of the distinct shingles of each text, ascending by owner and hash; then their hashes by other seeds."""
    h, own = words.hashes(), words.owner()
    left = np.repeat(words.first[1:], words.counts) - np.arange(len(h))
    starts = np.flatnonzero((left >= gram) | (np.arange(len(h)) == words.first[own]))
    ends = np.minimum(starts + gram, words.first[own[starts] + 1])
    x, o = range_hashes(h, starts, ends), own[starts]
    order = sort_within(o, x)
    x, o = x[order], o[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (o[1:] != o[:-1])
    kept = order[new]
    return x[new], o[new], *[range_hashes(words.hashes(s), starts[kept], ends[kept]) for s in seeds]


class Bands:
    """Size bands of PartEnum: instance i is for pairs whose smaller set is in band i, so a set of band i takes part in the instances i and i - 1."""

    def __init__(self, percent: int = PERCENT, most: int = 1 << 32) -> None:
        self.low, low = [], 1
        high = []
        while low <= most:
            self.low.append(low)
            high.append(low * 100 // percent)
            low = high[-1] + 1
        self.low = np.array(self.low)
        # the largest symmetric difference of a linked pair whose smaller set has up to `high` shingles
        k = np.array(high) * (100 - percent) // percent
        self.spare = 1 + (k // 2 + 1) // 12
        self.parts = k // 2 + 1 + self.spare

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1


def signatures(x: np.ndarray, owner: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """All signatures, and how many each set has (sets in order).

    Signatures of two empty sub-parts are left out unless more parts of the set
    have one than are spare: else some part with at most one difference has none.
    """
    n, out, owners = len(sizes), [], []
    band = bands.of(np.maximum(sizes, 1))
    value, place = mix64(x ^ U64(0xA5A5A5A5)), mix64(x ^ U64(0x77777777)) >> U64(11)
    for step in (0, 1):
        instance = np.maximum(band - step, 0)
        n1 = np.where((sizes > 0) & (band >= step), bands.parts[instance], 0)
        base = np.cumsum(n1) - n1
        member = n1[owner] > 0
        who = owner[member]
        slot = base[who] * 3 + (place[member] % (3 * n1[who]).astype(U64)).astype(np.int64)
        size = 3 * int(n1.sum())
        sums = np.zeros(size, U64)
        np.add.at(sums, slot, value[member])
        sums, held = sums.reshape(-1, 3), np.bincount(slot, minlength=size).reshape(-1, 3)
        pairs = sums.sum(1, dtype=U64)[:, None] - sums
        nothing = held.sum(1)[:, None] == held
        own = np.repeat(np.arange(n), n1)
        poor = np.bincount(own, nothing.any(1), n) > bands.spare[instance]
        at = (np.arange(len(own)) - base[own]).astype(U64)
        seed = mix64((instance[own].astype(U64) << U64(40))[:, None] + (at << U64(2))[:, None] + np.arange(3, dtype=U64))
        kept = ~nothing | poor[own][:, None]
        out.append(mix64(pairs ^ seed)[kept])
        owners.append(np.repeat(own, 3)[kept.ravel()])
    sig, own = np.concatenate(out), np.concatenate(owners)
    return sig[np.argsort(own, kind="stable")], np.bincount(own, minlength=n)


def sketches(x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One row of SKETCH words a set: each bit is the parity of the number of its shingles that hash there."""
    bit = (mix64(x ^ U64(0x3C3C3C3C)) % U64(64 * SKETCH)).astype(np.int64)
    odd = np.bincount(owner * (64 * SKETCH) + bit, minlength=n * 64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8").reshape(n, SKETCH)


def digests(x: np.ndarray, y: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Two sums a set, over independent hashes of its shingles."""
    d = np.zeros((2, n), U64)
    np.add.at(d[0], own, mix64(x ^ U64(0x1111)))
    np.add.at(d[1], own, mix64(y ^ U64(0x2222)))
    return d


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, text); tk is a hash of the text as it is, which tells texts under one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")


def described(docs: DataFrame, gram: int) -> DataFrame:
    """(row, doc_id, tk, n, d1, d2, sketch) of every row."""
    schema = "row bigint, doc_id bigint, tk bigint, n bigint, d1 bigint, d2 bigint, sketch array<bigint>"

    def run(batches):
        for b in batches:
            for at, end, words in chunks(b.column("text"), True):
                x, own, y = shingles(words, gram, 1)
                n = end - at
                d = digests(x, y, own, n)
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * SKETCH), pa.array(signed(sketches(x, own, n).ravel())))
                part = b.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("tk"), pa.array(np.bincount(own, minlength=n).astype(np.int64)), pa.array(signed(d[0])), pa.array(signed(d[1])), sketch],
                    names=["row", "doc_id", "tk", "n", "d1", "d2", "sketch"],
                )

    return stored(keyed(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "tk", "text").mapInArrow(run, schema), "sets")


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, text) of the stored rows `wanted` (row, doc_id, tk); a row whose id and text repeat comes repeatedly."""
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    t = keyed(docs)
    return t.join(side, t["doc_id"].eqNullSafe(side["doc_id"]) & (t["tk"] == side["tk"])).select("row", "text")


def signature_rows(docs: DataFrame, reps: DataFrame, percent: int, gram: int) -> DataFrame:
    """(sig, row) of every distinct set."""

    def run(batches):
        bands = Bands(percent)
        for b in batches:
            for at, end, words in chunks(b.column("text"), True):
                x, own = shingles(words, gram)
                sig, counts = signatures(x, own, np.bincount(own, minlength=end - at), bands)
                yield pa.RecordBatch.from_arrays([pa.array(signed(sig)), pa.array(np.repeat(b.column("row").to_numpy()[at:end], counts))], names=["sig", "row"])

    return with_texts(docs, reps.select("row", "doc_id", "tk")).mapInArrow(run, "sig bigint, row bigint")


def stars(rows: DataFrame) -> DataFrame:
    """(kind, sig, row, head) from (sig, row): kind 0 ties each set of a signature to the first of its stretch; kind 1 names the first and last stretch of a partition."""

    def run(batches):
        names = ["kind", "sig", "row", "head"]
        sig = head = None

        def edge():
            return pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([sig], pa.int64()), pa.array([head], pa.int64()), pa.array([head], pa.int64())], names=names)

        for b in batches:
            s, r = b.column("sig").to_numpy(), b.column("row").to_numpy()
            if not len(s):
                continue
            first = np.ones(len(s), bool)
            first[1:] = s[1:] != s[:-1]
            begins = sig is None
            if not begins:
                first[0] = s[0] != sig
            at = np.maximum.accumulate(np.where(first, np.arange(len(s)), -1))
            heads = np.where(at >= 0, r[np.maximum(at, 0)], head if head is not None else 0)
            if begins:
                sig, head = int(s[0]), int(r[0])
                yield edge()
            sig, head = int(s[-1]), int(heads[-1])
            m = ~first & (r != heads)
            if m.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(int(m.sum()), np.int32)), pa.array(s[m]), pa.array(r[m]), pa.array(heads[m])], names=names)
        if sig is not None:
            yield edge()

    spread = rows.repartitionByRange(F.col("sig"), F.col("row")).sortWithinPartitions("sig", "row")
    return stored(spread.mapInArrow(run, "kind int, sig bigint, row bigint, head bigint"), "stars")


def sized(a: Column, b: Column, percent: int) -> Column:
    """Sizes that a linked pair can have."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def close(na: Column, nb: Column, sa: Column, sb: Column, percent: int) -> Column:
    """Sketches that a linked pair can have: they differ in at most as many bits as the sets in shingles."""
    bits = sum((F.bit_count(sa[i].bitwiseXOR(sb[i])) for i in range(SKETCH)), F.lit(0))
    return bits * (100 + percent) <= (100 - percent) * (na + nb)


def long_sketch(x: np.ndarray) -> bytes:
    """A parity sketch of a power of two of bits, twice the set's size at least; half of it is the exclusive or of its halves."""
    bits = max(64 * SKETCH, 1 << (2 * len(x) - 1).bit_length())
    return np.packbits(np.bincount((mix64(x ^ U64(0x5555)) & U64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two long sketches differ, at the width of the shorter one."""
    x, y = (np.frombuffer(z, U64) for z in (a, b))
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, gram: int) -> DataFrame:
    """(a, b, na, nb, both) of the pairs (a, b, na, nb) of rows that their long sketches don't rule out: the size of the intersection of their sets, rebuilt from the texts."""
    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    wanted = stored(reps.join(wanted, "row").select("row", "doc_id", "tk"), "wanted")

    def build(batches):
        for b in batches:
            for at, end, words in chunks(b.column("text"), True):
                x, own = shingles(words, gram)
                cuts = np.searchsorted(own, np.arange(end - at + 1)).tolist()
                parts = [x[p:q] for p, q in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.slice(at, end - at).column("row"), pa.array([long_sketch(y) for y in parts], pa.binary()), pa.array([y.tobytes() for y in parts], pa.binary())], names=["row", "long", "set"])

    sets = stored(with_texts(docs, wanted).mapInArrow(build, "row bigint, long binary, set binary").dropDuplicates(["row"]), "shingles")

    def compared(batches):
        for b in batches:
            both = b.column("na").to_numpy() + b.column("nb").to_numpy()
            bits = np.array([differing(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column("la"), b.column("lb"), strict=True)], np.int64)
            yield b.select(["a", "b", "na", "nb"]).filter(pa.array(bits * (100 + percent) <= (100 - percent) * both))

    def meet(batches):
        for b in batches:
            both = [len(np.intersect1d(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), assume_unique=True)) for x, y in zip(b.column("sa"), b.column("sb"), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("a", "b", "na", "nb")], pa.array(both, pa.int64())], names=["a", "b", "na", "nb", "both"])

    def beside(x: DataFrame, column: str, bytes_: int) -> DataFrame:
        """x with a column of the sets of both sides; the sets come by broadcast while they have no more than BROADCAST_BYTES."""
        for side in "ab":
            right = sets.select(F.col("row").alias(side), F.col(column).alias(f"{column[0]}{side}"))
            x = x.join(F.broadcast(right) if bytes_ <= BROADCAST_BYTES else right, side)
        return x.select("a", "b", "na", "nb", f"{column[0]}a", f"{column[0]}b")

    sizes = sets.agg(*[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in ("long", "set")]).first()
    near = stored(beside(pairs.select("a", "b", "na", "nb"), "long", sizes[0]).mapInArrow(compared, "a bigint, b bigint, na bigint, nb bigint"), "near")
    return beside(near, "set", sizes[1]).mapInArrow(meet, "a bigint, b bigint, na bigint, nb bigint, both bigint")


def meeting(members: DataFrame, *columns: str) -> DataFrame:
    """Every two members (sig, a row, more columns) of a signature once, in no order, as columns with the suffixes a and b (rows a and b).

    The members of a signature are cut into blocks of about BLOCK by a hash of
    the row; a pair of blocks is a join key, so no task holds a whole group.
    """
    n = members.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    m = members.join(n, "sig").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    a = m.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    a = a.select("sig", F.col("block").alias("i"), F.col("other").alias("j"), F.col("row").alias("a"), *[F.col(c).alias(f"{c}a") for c in columns])
    b = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block"))))
    b = b.select("sig", F.col("other").alias("i"), F.col("block").alias("j"), F.col("row").alias("b"), *[F.col(c).alias(f"{c}b") for c in columns])
    return a.join(b, ["sig", "i", "j"]).filter("i < j or a > b").drop("i", "j")


def join(docs: DataFrame, percent: int = PERCENT, gram: int = GRAM) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return classes(docs, percent, gram).select("doc_id", "n_shingles", "component_id")


def _reps(all_sets: DataFrame) -> DataFrame:
    """One row of each distinct set, its copies, and the smallest id among them."""
    first = F.min(F.struct("row", "doc_id", "tk", "sketch")).alias("r")
    x = all_sets.filter("n > 0").groupBy("n", "d1", "d2").agg(first, F.count("*").alias("copies"), F.min("doc_id").alias("low"))
    return stored(x.select("n", "d1", "d2", "r.row", "r.doc_id", "r.tk", "r.sketch", "copies", "low"), "reps")


def classes(docs: DataFrame, percent: int = PERCENT, gram: int = GRAM) -> DataFrame:
    """doc_id, tk, n_shingles, root, component_id of every row: root tells components apart where ids repeat and is null for empty sets."""
    all_sets = described(docs, gram)
    reps = _reps(all_sets)
    star = stars(signature_rows(docs, reps, percent, gram))
    size = reps.select("row", "n", "sketch")
    # a signature that runs over partitions has several heads; they meet at the smallest
    edges = star.filter("kind = 1")
    bridges = edges.groupBy("sig").agg(F.min("head").alias("low"), F.max("head").alias("high")).filter("low < high").select("sig", "low")
    bridge = edges.join(bridges, "sig").filter("head > low").select("sig", F.col("head").alias("row"), F.col("low").alias("head"))
    ties = stored(star.filter("kind = 0").select("sig", "row", "head").unionByName(bridge), "ties")
    pairs = ties.select(F.col("row").alias("a"), F.col("head").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(size.select(F.col("row").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    na, nb = F.col("na"), F.col("nb")
    pairs = stored(pairs.withColumn("fits", sized(na, nb, percent) & close(na, nb, F.col("sa"), F.col("sb"), percent)).drop("sa", "sb"), "pairs")
    fits = pairs.filter("fits")
    seen = stored(_linked(verified(fits, reps, docs, percent, gram), percent), "seen")
    linked = seen.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(linked)
    rest = stored(_across(ties, pairs, seen, roots, size, percent), "rest")
    if rest.limit(1).count():
        more = _linked(verified(rest, reps, docs, percent, gram), percent).filter("linked")
        roots = components(linked.union(more.select("a", "b")))
    nodes = reps.join(roots.withColumnRenamed("node", "row"), "row", "left").select("n", "d1", "d2", "low", F.coalesce("root", "row").alias("root"))
    lowest = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    nodes = stored(nodes.drop("low").join(lowest, "root"), "nodes")
    out = all_sets.select("doc_id", "tk", "n", "d1", "d2").join(nodes, ["n", "d1", "d2"], "left")
    return out.select("doc_id", "tk", F.col("n").alias("n_shingles"), "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def links(docs: DataFrame, percent: int = PERCENT, gram: int = GRAM) -> DataFrame:
    """doc_id, n_shingles, n_links of every row: the other rows that it is linked with, copies included.

    Every pair of different sets that share a signature is verified, inside
    components too, so the work grows with the square of a group of near copies.
    """
    all_sets = described(docs, gram)
    reps = _reps(all_sets)
    sigs = stored(signature_rows(docs, reps, percent, gram).distinct(), "signatures")
    pairs = meeting(sigs).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(reps.select(F.col("row").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    na, nb = F.col("na"), F.col("nb")
    pairs = stored(pairs.filter(sized(na, nb, percent) & close(na, nb, F.col("sa"), F.col("sb"), percent)).select("a", "b", "na", "nb"), "pairs")
    linked = stored(_linked(verified(pairs, reps, docs, percent, gram), percent).filter("linked").select("a", "b"), "links")
    near = linked.union(linked.select("b", "a")).join(reps.select(F.col("row").alias("b"), "copies"), "b").groupBy(F.col("a").alias("row")).agg(F.sum("copies").alias("near"))
    nodes = reps.join(near, "row", "left").select("n", "d1", "d2", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    out = all_sets.select("doc_id", "n", "d1", "d2").join(nodes, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _linked(met: DataFrame, percent: int) -> DataFrame:
    """a, b, linked and the Jaccard distance d."""
    union = F.col("na") + F.col("nb") - F.col("both")
    return met.select("a", "b", (100 * F.col("both") >= percent * union).alias("linked"), (1 - F.col("both") / union).alias("d"))


def _across(ties: DataFrame, pairs: DataFrame, seen: DataFrame, roots: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a signature, lie in different components so far, and may still be linked."""
    root = roots.select(F.col("node").alias("row"), "root")
    # ties that didn't hold and that no other path made up for
    apart = pairs.select("a", "b").join(seen.filter("linked").select("a", "b"), ["a", "b"], "left_anti")
    for side in ("a", "b"):
        apart = apart.join(root.select(F.col("row").alias(side), F.col("root").alias(f"r{side}")), side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
    apart = apart.filter("ra <> rb").select(F.col("a").alias("row"), F.col("b").alias("head"))
    open_sigs = ties.join(apart, ["row", "head"]).select("sig").distinct()
    members = ties.join(open_sigs, "sig")
    known = seen.select(F.col("a").alias("row"), F.col("b").alias("head"), "d")
    members = members.join(known, ["row", "head"], "left").select("sig", "row", "head", "d").unionByName(members.select("sig", F.col("head").alias("row"), "head", F.lit(0.0).alias("d")).distinct())
    members = members.join(root, "row", "left").withColumn("root", F.coalesce("root", "row")).join(size, "row")
    members = stored(members, "members")
    both = meeting(members, "head", "d", "root", "n", "sketch")
    na, nb = F.col("na"), F.col("nb")
    near = F.coalesce(F.abs(F.col("da") - F.col("db")) <= (100 - percent) / 100 + 1e-9, F.lit(True)) | (F.col("heada") != F.col("headb"))
    may = (F.col("roota") != F.col("rootb")) & sized(na, nb, percent) & near & close(na, nb, F.col("sketcha"), F.col("sketchb"), percent)
    first = F.col("a") > F.col("b")
    x = both.filter(may).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.when(first, na).otherwise(nb).alias("na"), F.when(first, nb).otherwise(na).alias("nb")).distinct()
    return x.join(pairs.select("a", "b"), ["a", "b"], "left_anti").join(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")

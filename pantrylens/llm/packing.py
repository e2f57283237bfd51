"""Mixture-controlled packing by deficit round-robin over source queues.

Every source with at least 1/GRAIN of the weight is a queue; smaller ones share
a queue, so there are at most GRAIN + 1 of them, whatever the data.  A window of
1024 tokens takes from each queue its target share.  What a share is off a
whole number of tokens is the queue's deficit, carried into the next window:
after k windows a queue has got its exact share to within one token.  When a
queue runs out, the others go on in their proportions; what it had left and
could not fill a turn with goes to the rest, which is packed at the end and cut
into powers of two, so that nothing is padded.

The schedule is a function of the queues' totals alone (a few exact integers a
queue), so no scheduler runs over the tokens: documents are tokenized once,
prefix sums of token counts say where a document stands in its queue, and its
pieces follow from that in the task that reads it.  Deficits thus carry over
windows and partitions alike.  Queues are in the order of the stored rows.

Defined cases: null and empty texts are the single id 0; a null source is a
source of its own; sources without a target come last; texts of any length are
cut freely; repeated rows are separate documents; an empty table packs to
nothing; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, running_sums

WINDOW, END_ID = 1024, 0
#: Sources with less than 1 / GRAIN of the weight share a queue.
GRAIN = 64
#: Most rows (part, source, tokens before) that are broadcast.
BROADCAST_ROWS = 1 << 17

Source = tuple[bool, str]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Every row with its ids as little-endian 16-bit values, stored once: (doc_id, s0, s1, part, earlier, n_tokens, ids).

    earlier counts the tokens of the same source before the row in its part.
    """
    schema = "doc_id bigint, s0 boolean, s1 string, part int, earlier bigint, n_tokens bigint, ids binary"

    def encode(batches):
        from .tokens import Encoder

        enc = Encoder(tokenizer)
        if len(enc.sizes) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        upto: dict[Source, int] = {}
        for b in batches:
            # output goes out in parts, so that a batch of long texts needs no second copy of all of it
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids = [np.append(x, END_ID).astype("<u2").tobytes() for x in enc.column(part.column("text"))]
                n, earlier = [len(x) // 2 for x in ids], []
                for source, k in zip(zip(part.column("s0").to_pylist(), part.column("s1").to_pylist(), strict=True), n, strict=True):
                    earlier.append(upto.get(source, 0))
                    upto[source] = earlier[-1] + k
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "s0", "s1", "part")], pa.array(earlier, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "s0", "s1", "part", "earlier", "n_tokens", "ids"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("s0"), F.coalesce("source", F.lit("")).alias("s1"), F.spark_partition_id().alias("part"), "text")
    path = new_path(docs.sparkSession, "tokens")
    x.mapInArrow(encode, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


class Schedule:
    """Which tokens of which queue fill which window.

    queues holds (tokens, weight); a phase is a number of windows in which the
    same queues take part.  With C the running sum of the weights of the phase
    and W their total, queues up to j have C[j] * window * k // W tokens in the
    first k windows of a phase: the differences are the queues' tokens, never
    off their share by a whole token, and they fill every window.
    """

    def __init__(self, queues: list[tuple[int, int]], window: int = WINDOW) -> None:
        self.window = window
        left, done = [t for t, _ in queues], [0] * len(queues)
        active = [q for q, (t, w) in enumerate(queues) if t and w]
        #: by queue: (first token, end, first window, weight before, weight after, all weight) of its phases
        self.phases: list[list[tuple[int, int, int, int, int, int]]] = [[] for _ in queues]
        self.rest: list[tuple[int, int]] = [(0, 0)] * len(queues)  # first token of the queue's rest, its place in all rests
        at, first, rest = 0, [], 0
        while active:
            weights = [queues[q][1] for q in active]
            total = sum(weights)
            upto = [sum(weights[: j + 1]) for j in range(len(weights))]
            bounds = list(zip([0, *upto], upto, strict=False))
            n = min(left[q] * total // (w * window) for q, w in zip(active, weights, strict=True)) + 1
            while any(self._of(lo, hi, total, n) > left[q] for q, (lo, hi) in zip(active, bounds, strict=True)):
                n -= 1
            for q, (lo, hi) in zip(active, bounds, strict=True):
                got = self._of(lo, hi, total, n)
                self.phases[q].append((done[q], done[q] + got, at, lo, hi, total))
                left[q], done[q] = left[q] - got, done[q] + got
            at += n
            # a queue that can't fill its next turn has had its last
            over = [q for q, (lo, hi) in zip(active, bounds, strict=True) if self._of(lo, hi, total, n + 1) - self._of(lo, hi, total, n) > left[q]]
            first += over
            active = [q for q in active if q not in over]
        for q in [*first, *[q for q, (_, w) in enumerate(queues) if not w]]:
            self.rest[q] = (done[q], rest)
            rest += left[q]
        self.windows, full = at, rest - rest % window
        # ends of the sequences of the rest: whole windows, then its binary digits
        self.ends = [full + sum(1 << b for b in range(i, window.bit_length()) if rest - full >> b & 1) for i in range(window.bit_length() - 2, -1, -1) if rest - full >> i & 1]
        self.full = full

    def _of(self, lo: int, hi: int, total: int, k: int) -> int:
        """Tokens of a queue in the first k windows of a phase."""
        return hi * self.window * k // total - lo * self.window * k // total

    def pieces(self, queue: int, a: int, b: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the queue, length, sequence, offset) of the tokens a:b of a queue."""
        size = self.window
        for start, end, first, lo, hi, total in self.phases[queue]:
            x, stop = max(a, start), min(b, end)
            if x >= stop:
                continue
            k = (x - start) * total // ((hi - lo) * size) + 1
            while self._of(lo, hi, total, k) > x - start:
                k -= 1
            lo_k, hi_k = lo * size * k // total, hi * size * k // total
            while x < stop:
                lo_next, hi_next = lo * size * (k + 1) // total, hi * size * (k + 1) // total
                n = min(stop, start + hi_next - lo_next) - x
                if n > 0:
                    yield x, n, first + k, lo_next - lo_k + (x - start) - (hi_k - lo_k)
                    x += n
                k, lo_k, hi_k = k + 1, lo_next, hi_next
        start, place = self.rest[queue]
        x, stop = place + max(a, start) - start, place + b - start
        while x < stop and b > start:
            if x < self.full:
                begin, end, sequence = x - x % size, x - x % size + size, x // size
            else:
                i = sum(e <= x for e in self.ends)
                begin, end, sequence = ([self.full, *self.ends])[i], self.ends[i], self.full // size + i
            n = min(stop, end) - x
            yield x - place + start, n, self.windows + sequence, x - begin
            x += n


def queues_of(totals: DataFrame, targets: dict[str | None, int] | None) -> tuple[list[Source], list[tuple[int, int]]]:
    """The sources with a queue of their own, and (tokens, weight) of these queues, of the shared one and of the sources without a target.

    At most GRAIN sources have so much weight, so a few rows come to the driver.
    """
    spark = totals.sparkSession
    if targets is None:
        x = totals.withColumn("weight", F.col("n"))
    else:
        rows = [(s is None, s or "", int(w)) for s, w in targets.items() if w > 0]
        x = totals.join(spark.createDataFrame(rows, "s0 boolean, s1 string, weight bigint"), ["s0", "s1"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)).cast("long"))
    n, weight, unweighted = x.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("weight") == 0, F.col("n"))), F.lit(0))).first()
    big = [((r["s0"], r["s1"]), r["n"], r["weight"]) for r in x.filter((F.col("weight") > 0) & (F.col("weight") * GRAIN >= F.lit(weight))).orderBy("weight", "s0", "s1").collect()]
    # the shared queue needs its share too: it takes in the least of the others while it lacks it
    shared, shared_n = weight - sum(w for _, _, w in big), n - unweighted - sum(k for _, k, _ in big)
    while big and 0 < shared * GRAIN < weight:
        _, k, w = big.pop(0)
        shared, shared_n = shared + w, shared_n + k
    return [s for s, _, _ in big], [*[(k, w) for _, k, w in big], (shared_n, shared), (unweighted, 0)]


def pack(docs: DataFrame, tokenizer: str | None = None, targets: dict[str | None, int] | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    targets gives weights of sources; without it every source has its share of
    all tokens.
    """
    t = tokenized(docs, tokenizer or default_tokenizer())
    per_part = t.groupBy("part", "s0", "s1").agg(F.sum("n_tokens").alias("n"))
    own, queues = queues_of(per_part.groupBy("s0", "s1").agg(F.sum("n").alias("n")), targets)
    plan = Schedule(queues, window)
    weighted = F.lit(True) if targets is None else F.struct("s0", "s1").isin([F.struct(F.lit(s is None), F.lit(s or "")) for s, w in targets.items() if w > 0]) if any(w > 0 for w in targets.values()) else F.lit(False)
    queue = F.when(weighted, len(own)).otherwise(len(own) + 1)
    for i, (null, name) in enumerate(own):
        queue = F.when((F.col("s0") == null) & (F.col("s1") == name), i).otherwise(queue)
    parts = per_part.agg(F.max("part")).first()[0]
    ranges = per_part.withColumn("queue", queue).withColumn("fine", F.floor(F.col("part").cast("long") * 65536 / ((parts or 0) + 1)).cast("int"))
    starts = running_sums(ranges, ["queue"], ["part", "s0", "s1"], "n").select("part", "s0", "s1", "queue", F.col("before").alias("base"))
    if starts.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def cut(batches):
        for b in batches:
            own_row, columns, crc = [], [], []
            rows = zip(b.column("queue").to_pylist(), b.column("base").to_pylist(), b.column("earlier").to_pylist(), b.column("n_tokens").to_pylist(), b.column("ids"), strict=True)
            for i, (q, base, earlier, n, ids) in enumerate(rows):
                a, x = base + earlier, np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")
                raw = memoryview(x).cast("B")
                for start, length, sequence, offset in plan.pieces(q, a, a + n):
                    own_row.append(i)
                    columns.append((start - a, length, sequence, offset))
                    crc.append(zlib.crc32(raw[4 * (start - a) : 4 * (start - a + length)]))
            start, length, sequence, offset = np.array(columns, np.int64).reshape(-1, 4).T
            take = pa.array(own_row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), b.column("n_tokens").take(take), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return t.join(starts, ["part", "s0", "s1"]).select("doc_id", "queue", "base", "earlier", "n_tokens", "ids").mapInArrow(cut, schema)

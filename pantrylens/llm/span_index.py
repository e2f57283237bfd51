"""Substring dedup with a log-structured fingerprint index.

A window is 50 consecutive words.  Its *anchor* is the smallest hash among its
8-word grams, so equal windows have equal anchors.  Consecutive windows with
one anchor form a *run* of a document, stored as (anchor, fingerprint of the
run's words, doc_id, start, n).  The index keeps immutable runs
files sorted by anchor; a batch is fingerprinted once, written as a new file,
and merge-joined by anchor with all files: equal runs of earlier documents
settle whole runs, and distinct runs whose anchor another one shares are noted
to be opened into windows.  When files pile up they are compacted into one that
keeps the first document of each distinct run.  At the end the noted runs of
all batches are opened in one pass over the texts, and their windows compared.
The outcome equals that of comparing every window with every window of smaller
ids; nothing is sampled or capped.

Anchors only bring candidates together.  What decides is a 128-bit BLAKE2b
digest of the words of the run or window themselves, joined by one space - not
of hashes of words - so a match is verified on the words of both sides, and
texts that are made to collide in the anchors' hashes are told apart.

Batches must come in ascending ranges of doc_id, as "first" means the smallest;
a batch that does not is refused.

Defined cases: null and empty texts have no words; texts below 50 words have
no windows and lose nothing; rows with a null id neither remove nor lose words;
rows with the same id never remove each other's words, whatever their texts;
exact copies of windowed texts lose everything; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import U64, Words, chunks, gathered, range_hashes, signed
from .shared import new_path, release, stored

WINDOW, GRAM = 50, 8
#: Batches of a whole corpus, and runs files that are merged into one.
BATCHES, FAN_OUT = 3, 2
RUN = "anchor bigint, f1 bigint, f2 bigint, doc_id bigint, tk bigint, start int, n int"
OPEN = "doc_id bigint, tk bigint, start int, n int"
WIN = "w1 bigint, w2 bigint, doc_id bigint, tk bigint, pos int"


class Windows:
    """Windows of the texts of a chunk: valid starts, anchors, and digests of word ranges."""

    def __init__(self, words: Words, window: int = WINDOW) -> None:
        self.words = words
        left = np.repeat(words.first[1:], words.counts) - np.arange(len(words.starts))
        self.valid = left >= window
        # every word with one space behind it
        sizes = words.ends - words.starts + 1
        text = gathered(np.append(words.buf, np.uint8(32)), words.starts, sizes) if len(sizes) else np.zeros(0, np.uint8)
        self.upto = np.concatenate([[0], np.cumsum(sizes)])
        text[self.upto[1:] - 1] = 32
        self.text = memoryview(text.tobytes())

    def anchors(self, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
        h = self.words.hashes()
        n = len(h)
        grams = np.full(n, np.iinfo(np.uint64).max, U64)
        at = np.arange(max(0, n - gram + 1))
        grams[: len(at)] = range_hashes(h, at, at + gram)
        # minimum over window - gram + 1 grams by doubling
        span, low = window - gram + 1, grams
        k = 1
        while 2 * k <= span:
            low = np.minimum(low, np.concatenate([low[k:], low[:k]]) if n > k else low)
            k *= 2
        shift = span - k
        return np.minimum(low, np.concatenate([low[shift:], low[:shift]])) if 0 < shift < n else low

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the digest of the words start:end, for every range."""
        text, new = self.text, hashlib.blake2b
        got = b"".join([new(text[a:z], digest_size=16).digest() for a, z in zip(self.upto[starts].tolist(), (self.upto[ends] - 1).tolist(), strict=True)])
        pairs = np.frombuffer(got, "<i8").reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def fingerprints(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs of every document (doc_id, tk, text); tk is the text's hash, which tells texts under one id apart."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("tk").to_numpy()
            for at, end, words in chunks(batch.column("text")):
                w, own = Windows(words, window), words.owner()
                v = w.valid
                if not v.any():
                    continue
                anchors, fresh = w.anchors(window), v.copy()
                fresh[1:] &= ~(v[:-1] & (own[1:] == own[:-1]) & (anchors[1:] == anchors[:-1]))
                starts = np.flatnonzero(fresh)
                group = np.cumsum(fresh)[v] - 1
                n = np.bincount(group, minlength=len(starts))
                f1, f2 = w.digests(starts, starts + n + window - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchors[starts])), pa.array(f1), pa.array(f2), pa.array(ids[at:end][own[starts]]), pa.array(keys[at:end][own[starts]]), pa.array((starts - words.first[own[starts]]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["anchor", "f1", "f2", "doc_id", "tk", "start", "n"],
                )

    return docs.mapInArrow(run, RUN)


def opened(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Digests of the windows in the ranges `runs` (start, n) of each document (doc_id, tk, text, runs)."""

    def run(batches):
        for batch in batches:
            ids, keys, col = batch.column("doc_id").to_numpy(), batch.column("tk").to_numpy(), batch.column("runs")
            flat, sizes = col.flatten(), np.diff(col.offsets.to_numpy())
            upto = np.concatenate([[0], np.cumsum(sizes)])
            start, n = flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
            for at, end, words in chunks(batch.column("text")):
                w = Windows(words, window)
                r = slice(upto[at], upto[end])
                own = np.repeat(np.arange(end - at), sizes[at:end])
                m = n[r]
                first = words.first[own] + start[r]
                pos = np.arange(int(m.sum())) + np.repeat(first - (np.cumsum(m) - m), m)
                w1, w2 = w.digests(pos, pos + window)
                d = np.repeat(own, m)
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(ids[at:end][d]), pa.array(keys[at:end][d]), pa.array((pos - words.first[d]).astype(np.int32))], names=["w1", "w2", "doc_id", "tk", "pos"])

    return docs.mapInArrow(run, WIN)


class FingerprintIndex:
    """Sorted immutable runs files of all documents so far, in the shared folder."""

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT, window: int = WINDOW) -> None:
        self.spark, self.fan_out, self.window = spark, fan_out, window
        self.files: list[str] = []
        self.last: int | None = None

    def _read(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*files) if files else self.spark.createDataFrame([], RUN)

    def _write(self, runs: DataFrame) -> str:
        path = new_path(self.spark, "runs")
        runs.sortWithinPartitions("anchor", "f1", "f2").write.parquet(path)
        return path

    def add(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Index a batch (doc_id, tk, text) of larger ids than all before; no text of an earlier batch is read.

        Gives the runs of the batch that an earlier document holds whole, and
        the runs (of any batch) that must be opened into windows, both as
        (doc_id, tk, start, n).
        """
        least, most = batch.agg(F.min("doc_id"), F.max("doc_id")).first()
        if least is None:
            return self.spark.createDataFrame([], OPEN), self.spark.createDataFrame([], OPEN)
        if self.last is not None and least <= self.last:
            raise ValueError(f"a batch that starts at id {least} after id {self.last}")
        self.last = most
        new = self._write(fingerprints(batch, self.window))
        runs = self._read([new]).withColumn("new", F.lit(True))
        if self.files:
            runs = runs.unionByName(self._read(self.files).withColumn("new", F.lit(False)))
        shared = runs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("new").alias("any_new")).filter("lo < hi and any_new").select("anchor")
        runs = runs.join(shared, "anchor")
        key = ["anchor", "f1", "f2"]
        distinct = runs.groupBy(*key).agg(F.min("doc_id").alias("lo"), F.max("new").alias("fresh"))
        path = new_path(self.spark, "firsts")
        distinct.write.parquet(path)
        firsts = self.spark.read.schema(distinct.schema).parquet(path)
        # distinct runs under an anchor that several of them share, one of them new
        several = firsts.groupBy("anchor").agg(F.count("*").alias("c"), F.max("fresh").alias("fresh")).filter("c > 1 and fresh").select("anchor", F.lit(True).alias("open"))
        firsts = firsts.select(*key, "lo").join(several, "anchor", "left")
        placed = runs.join(firsts, key).filter("new and doc_id > lo or open and doc_id = lo")
        placed = stored(placed.select("doc_id", "tk", "start", "n", (F.col("doc_id") > F.col("lo")).alias("equal")), "placed")
        release(self.spark, path)
        self.files.append(new)
        if len(self.files) >= self.fan_out:
            self.compact()
        return placed.filter("equal").drop("equal"), placed.filter("not equal").drop("equal")

    def compact(self) -> None:
        """One sorted file in place of all: the first document of each distinct run."""
        merged = self._read(self.files).groupBy("anchor", "f1", "f2").agg(F.min(F.struct("doc_id", "tk", "start", "n")).alias("s")).select("anchor", "f1", "f2", "s.*")
        old, self.files = self.files, [self._write(merged)]
        release(self.spark, *old)

    def drop(self) -> None:
        """Delete the index's files."""
        release(self.spark, *self.files)
        self.files = []


def repeated_windows(texts: DataFrame, runs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows (doc_id, tk, start, n = 1) of the runs that also start in a run of a document with a smaller id; texts is read once."""
    per_doc = runs.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    windows = stored(opened(texts.join(per_doc, ["doc_id", "tk"]).select("doc_id", "tk", "text", "runs"), window), "windows")
    release(texts.sparkSession)
    first_of = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("w1", "w2", "lo")
    return windows.join(first_of, ["w1", "w2"]).filter("doc_id > lo").select("doc_id", "tk", F.col("pos").alias("start"), F.lit(1).alias("n"))


def dedup(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of every row, the corpus indexed in ascending batches."""
    index = FingerprintIndex(docs.sparkSession, window=window)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), F.coalesce("text", F.lit("")).alias("text"))
    known = base.filter("doc_id is not null")
    lo, hi = (int(x or 0) for x in known.agg(F.min("doc_id"), F.max("doc_id")).first())
    cuts = [lo + (hi + 1 - lo) * i // batches for i in range(batches + 1)]
    found = to_open = docs.sparkSession.createDataFrame([], OPEN)
    for a, b in zip(cuts, cuts[1:], strict=False):
        equal, several = index.add(known.filter((F.col("doc_id") >= a) & (F.col("doc_id") < b)))
        found, to_open = found.unionByName(equal), to_open.unionByName(several)
    index.drop()  # what add has found is stored
    found = found.unionByName(repeated_windows(known, to_open, window))
    per_doc = found.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return cut_out(base.join(per_doc, ["doc_id", "tk"], "left").select("doc_id", "text", "runs"), window)


def cut_out(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove the covered words of (doc_id, text, runs)."""
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"

    def run(batches):
        for b in batches:
            n_words, n_removed, shas, kept = [], [], [], []
            for text, r in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("runs").to_pylist(), strict=True):
                words = text.split()
                gone = 0
                n_words.append(len(words))
                if r:
                    cover = np.zeros(len(words) + 1, np.int64)
                    for x in r:
                        cover[x["start"]] += 1
                        cover[x["start"] + x["n"] + window - 1] -= 1
                    keep = np.cumsum(cover[:-1]) == 0
                    gone, words = int((~keep).sum()), [words[i] for i in np.flatnonzero(keep)]
                out = b" ".join(words)
                n_removed.append(gone)
                shas.append(hashlib.sha256(out).hexdigest())
                kept.append(out.decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas), pa.array(kept)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(run, schema)

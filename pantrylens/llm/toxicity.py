"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words and their first bytes hash to a fixed number of embedding rows, and a
word is embedded as the sum of both, so that inflected forms share a part; filters of widths 1 to 3 run
over the whole text, each is max-pooled, and a logistic layer gives the
probability.  Everything is trained in numpy from all labelled rows outside the
held-out fold.  Their words are hashed once; the rows are dealt into groups by
a hash and stored by group, once, so that no pass moves them again.  Every group
takes Adam's steps over its rows, and after each pass the states of all groups
are averaged, weighted by rows: first those of a lane, whose groups one task
takes in turn, then those of the lanes.  Word
counts come from all rows, too, and so do the decision thresholds, which are
calibrated per language on a fine grid of logits; the language is found from
function words of the text itself, never from a column.

Defined cases: null and empty texts, and texts without a word, get the
score of a logit of -4; texts of any length are read whole; repeated rows get
equal scores; a null id is not held out; with no usable labels of both classes
every score is 0.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import IS_ALNUM, U64, Words, byte_hashes, chunks
from .shared import fold, new_path, release

#: A row for each hash of a word, then one for each hash of its beginning.
BUCKETS, PREFIX_BYTES, DIM, WIDTHS, FILTERS = 1 << 15, 5, 12, (1, 2, 3), 8
#: Bounds of op6's training sample: rows of class 0 and 1, and bytes of all its texts; a text that would exceed them is passed over.
SAMPLE_ROWS, SAMPLE_BYTES = (2500, 1500), 16 << 20
#: Rows and words of a training group, about; passes over the rows; values of a state that are averaged together.
GROUP_ROWS, GROUP_WORDS, EPOCHS, BLOCK = 4096, 1 << 22, 6, 1 << 14
#: Lanes that groups are dealt to, at least if there are so many groups, and groups of a lane if there are more lanes.
LANES, LANE_GROUPS = 8, 4
#: Most labels that are broadcast to the texts; of more, only this many bits are, in blocks of so many.
BROADCAST_ROWS, BITS, BLOCK_BITS = 1 << 18, 1 << 27, 1 << 16
#: Steps of a logit in which thresholds are sought.
GRID = 1024
#: Pull of an embedding towards where it started.
DECAY = 0.01
#: Embedding rows met in fewer training texts stay at zero: they could only be learned by heart.
LEAST_TEXTS = 8
#: Function words that tell the languages apart (fixed values).
LANGUAGES = {
    "en": "the of and to is that for with this was are",
    "de": "der die und den von mit das ist nicht ein für",
    "fr": "les et des une dans est pour que pas sur avec",
    "es": "los y que del las con una para no por el",
}


def _hash(word: str) -> int:
    b = word.encode()
    return int(Words(np.frombuffer(b, np.uint8), np.array([0, len(b)])).hashes()[0])


class Languages:
    """Index of the language whose function words a text has most of; len(LANGUAGES) if it has none."""

    def __init__(self) -> None:
        pairs = sorted((_hash(w), i) for i, words in enumerate(LANGUAGES.values()) for w in words.split())
        self.keys, self.of = np.array([k for k, _ in pairs], U64), np.array([i for _, i in pairs])

    def __call__(self, hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        counts = np.zeros((n, len(LANGUAGES)), np.int64)
        low, high = np.searchsorted(self.keys, hashes, "left"), np.searchsorted(self.keys, hashes, "right")
        for step in range(3):  # a word may belong to several languages
            hit = np.flatnonzero(low + step < high)
            np.add.at(counts, (owner[hit], self.of[low[hit] + step]), 1)
        return np.where(counts.max(1) > 0, counts.argmax(1), len(LANGUAGES))


@dataclass
class Model:
    embed: np.ndarray  # 2 BUCKETS x DIM; row PAD stands for what lies beyond a text
    filters: list[np.ndarray]  # per width: width x DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: np.ndarray  # per language: the logit of its threshold

    def tables(self) -> list[np.ndarray]:
        """Response of each filter position to each embedding row."""
        return [(self.embed @ w).astype(np.float32) for w in self.filters]


PAD = BUCKETS - 1


def bucketed(words: Words) -> np.ndarray:
    """Two embedding rows for every word."""
    cut = lambda h: (h >> U64(64 - 15)).astype(np.int64) % PAD
    heads = byte_hashes(words.buf, words.starts, np.minimum(words.ends, words.starts + PREFIX_BYTES))
    return np.stack([cut(words.hashes()), BUCKETS + cut(heads)], 1)


def pooled(tables: list[np.ndarray], ids: np.ndarray, first: np.ndarray, argmax: bool = False, pad: int = PAD):
    """Maximum of every filter over each text with words; windows reach over the end into padding."""
    have = np.flatnonzero(np.diff(first))
    starts, n = first[have], len(ids)
    left = np.repeat(first[have + 1], np.diff(first)[have]) - np.arange(n)  # words from here to the text's end
    best, at = [], []
    for t in tables:
        x = t[0][ids[:, 0]] + t[0][ids[:, 1]]
        for j in range(1, len(t)):
            nxt = np.full((n, 2), pad)
            nxt[: n - j] = ids[j:]
            nxt[left <= j] = pad
            x += t[j][nxt[:, 0]]
            x += t[j][nxt[:, 1]]
        m = np.maximum.reduceat(x, starts, axis=0)
        best.append(m)
        if argmax:
            rows = np.repeat(np.arange(len(have)), np.diff(first)[have])
            where = np.zeros(m.shape, np.int64)
            hit, f = np.nonzero(x == m[rows])
            where[rows[hit][::-1], f[::-1]] = hit[::-1]
            at.append(where)
    return have, np.concatenate(best, 1), (np.concatenate(at, 1) if argmax else None)


def logits(model: Model, tables: list[np.ndarray], ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    z = np.full(len(first) - 1, -4.0)  # nothing to read, nothing toxic
    if len(ids):
        have, m, _ = pooled(tables, ids, first)
        z[have] = np.maximum(m + model.bias, 0) @ model.out + model.out_bias
    return z


def initial(per: np.ndarray, n: np.ndarray, seed: int = 7) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Parameters before the first step, and the place of each embedding row among those that are learned; 0 stands for all that stay at zero.

    per: for both classes, the training texts that each row is met in; n: the texts of both classes.
    """
    rng, k = np.random.default_rng(seed), len(WIDTHS) * FILTERS
    live = per.sum(0) >= LEAST_TEXTS
    live[PAD] = False
    # embeddings start from the smoothed log-odds of their bucket, beside noise
    odds = np.log((per[1] + 0.5) / (n[1] + 1)) - np.log((per[0] + 0.5) / (n[0] + 1))
    embed = rng.normal(0, 0.02, (1 + int(live.sum()), DIM))
    embed[1:, 0] += odds[live] / 4
    embed[0] = 0
    p = {"embed": embed, "bias": np.zeros(k), "out": np.full(k, 0.3) + rng.normal(0, 0.05, k), "out_bias": np.array([-1.5])}
    for i, w in enumerate(WIDTHS):
        p[f"w{i}"] = rng.normal(0, 0.1, (w, DIM, FILTERS))
        p[f"w{i}"][:, 0] += 0.5
    return p, np.where(live, np.cumsum(live), 0)


def as_model(p: dict[str, np.ndarray]) -> Model:
    return Model(p["embed"], [p[f"w{i}"] for i in range(len(WIDTHS))], p["bias"], p["out"], float(p["out_bias"][0]), np.zeros(len(LANGUAGES) + 1))


def one_pass(p: dict, m: dict, v: dict, t: int, start: np.ndarray, ids: np.ndarray, first: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> tuple[dict, dict, dict, int]:
    """Adam on logistic loss, once over all texts; gradients reach only the windows that won their maximum. Row 0 of the embeddings stays at zero."""
    p, m, v = dict(p), dict(m), dict(v)
    for part in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 128)):
        sizes = np.diff(first)[part]
        own = np.concatenate([ids[first[d] : first[d + 1]] for d in part]) if sizes.sum() else ids[:0]
        if not len(own):
            continue
        f = np.concatenate([[0], np.cumsum(sizes)])
        have, pool, at = pooled(as_model(p).tables(), own, f, True, 0)
        hid = np.maximum(pool + p["bias"], 0)
        z = hid @ p["out"] + p["out_bias"][0]
        err = (1 / (1 + np.exp(-z)) - labels[part][have]) / len(have)
        g = {a: np.zeros_like(x) for a, x in p.items()}
        g["out"], g["out_bias"] = hid.T @ err + 1e-4 * p["out"], np.array([err.sum()])
        dh = err[:, None] * p["out"] * (hid > 0)
        g["bias"] = dh.sum(0)
        ends = f[have + 1]
        for i, w in enumerate(WIDTHS):
            d, a = dh[:, i * FILTERS : (i + 1) * FILTERS], at[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(w):
                inside = a + j < ends[:, None]
                for part_of_word in (0, 1):
                    b = np.where(inside, own[np.minimum(a + j, len(own) - 1), part_of_word], 0)
                    g[f"w{i}"][j] += np.einsum("nfd,nf->df", p["embed"][b], d)
                    np.add.at(g["embed"], b.ravel(), (d[:, :, None] * p[f"w{i}"][j].T[None]).reshape(-1, DIM))
        g["embed"][0] = 0
        touched = np.flatnonzero(g["embed"].any(1))
        g["embed"][touched] += DECAY * (p["embed"][touched] - start[touched])
        t += 1
        for a in p:
            m[a] = 0.9 * m[a] + 0.1 * g[a]
            v[a] = 0.999 * v[a] + 0.001 * g[a] ** 2
            p[a] = p[a] - 0.01 * (m[a] / (1 - 0.9**t)) / (np.sqrt(v[a] / (1 - 0.999**t)) + 1e-7)
    return p, m, v, t


def flat(*parts: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x[a].ravel() for x in parts for a in sorted(x)]).astype(np.float32)


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> list[dict[str, np.ndarray]]:
    """The dictionaries that flat() joined, each shaped as `like`."""
    out, at = [], 0
    while at < len(values):
        out.append({})
        for a in sorted(like):
            out[-1][a] = values[at : at + like[a].size].reshape(like[a].shape).astype(float)
            at += like[a].size
    return out


def encoded(rows: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """The columns of rows beside `text` (and `at`), then lang, n, ids: language, number of words, and the embedding rows of each word. bits: only rows whose bit `at` is set."""
    carried = [c for c in rows.columns if c not in ("text", "at")]

    def run(batches):
        languages = Languages()
        for b in batches:
            if bits is not None:
                at = b.column("at").to_numpy()
                b = b.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
                if not b.num_rows:
                    continue
            for at, end, words in chunks(b.column("text"), True, IS_ALNUM):
                ids = bucketed(words).astype("<u2").tobytes()
                lang = languages(words.hashes(), words.owner(), end - at)
                cuts = (4 * words.first).tolist()
                part = b.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, carried), pa.array(lang.astype(np.int32)), pa.array(words.counts.astype(np.int64)), pa.array([ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())],
                    names=[*carried, "lang", "n", "ids"],
                )

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.select(*carried, *(["at"] if bits is not None else []), "text").mapInArrow(run, f"{schema}, lang int, n bigint, ids binary")


def unpacked(b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of all words, first word of each text (and the end), labels."""
    ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), "<u2").reshape(-1, 2)
    return ids, np.concatenate([[0], np.cumsum(b.column("n").to_numpy())]).astype(np.int64), b.column("y").to_numpy()


def pieces(b: pa.RecordBatch, words: int = 1 << 18):
    """The batch in parts of about so many words."""
    upto = np.cumsum(b.column("n").to_numpy())
    cuts = [0, *(np.flatnonzero(np.diff(upto // words)) + 1).tolist(), b.num_rows]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i < j:
            yield b.slice(i, j - i)


def text_counts(rows: DataFrame) -> np.ndarray:
    """For both classes, the texts that each embedding row is met in."""

    def run(batches):
        per = np.zeros((2, 2 * BUCKETS), np.int64)
        for b in batches:
            for part in pieces(b):
                ids, first, y = unpacked(part)
                seen = np.unique(np.repeat(np.arange(len(y)), np.diff(first))[:, None] * (2 * BUCKETS) + ids)
                for c in (0, 1):
                    per[c] += np.bincount(seen[y[seen // (2 * BUCKETS)] == c] % (2 * BUCKETS), minlength=2 * BUCKETS)
        at = np.flatnonzero(per.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(per[0, at]), pa.array(per[1, at])], names=["i", "n0", "n1"])

    got = rows.select("y", "n", "ids").mapInArrow(run, "i bigint, n0 bigint, n1 bigint").groupBy("i").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    per = np.zeros((2, 2 * BUCKETS), np.int64)
    per[:, got.column("i").to_numpy()] = got.column("n0").to_numpy(), got.column("n1").to_numpy()
    return per


def lane_keys(spark: SparkSession, lanes: int) -> list[int]:
    """A number for each lane, which Spark's hash puts into a bucket of its own."""
    found = spark.range(64 * lanes).groupBy(F.pmod(F.hash("id"), F.lit(lanes)).alias("bucket")).agg(F.min("id").alias("id")).collect()
    return sorted(r.id for r in found)


def stored_by_group(rows: DataFrame, groups: int) -> tuple[DataFrame, str, str]:
    """rows with their group g and its lane, in a bucket for each lane; the table's name and its folder, for forget().

    What reads it by lane and group needs no shuffle. Where buckets are not used, it takes one and gives the same, up to rounding.
    """
    spark, path, name = rows.sparkSession, new_path(rows.sparkSession, "groups"), f"groups_{uuid.uuid4().hex}"
    keys = lane_keys(spark, min(groups, max(LANES, -(-groups // LANE_GROUPS))))
    g = F.pmod("o", F.lit(groups))
    lane = F.element_at(F.array(*map(F.lit, keys)), (g % len(keys)).cast("int") + 1).cast("bigint")
    rows.withColumn("g", g).withColumn("lane", lane).repartition(len(keys), "lane").write.bucketBy(len(keys), "lane").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name), name, path


def forget(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"DROP TABLE {name}")
    release(spark, path)


def averaged_pass(rows: DataFrame, state: tuple, start: np.ndarray, place: np.ndarray, epoch: int) -> tuple:
    """The state (p, m, v, t) after every group of rows (lane, g, o, y, n, ids) has taken its steps from it: the mean over groups, weighted by rows."""
    p, values = state[0], flat(*state[:3])
    like, t0 = {a: np.empty(x.shape, np.bool_) for a, x in p.items()}, state[3]
    first_state, pulled = values, start.astype(np.float32)

    def steps(key, table):
        table = table.sort_by([("o", "ascending"), ("ids", "ascending"), ("y", "ascending")])
        ids, first, y = unpacked(table)
        lane, g = (k.as_py() for k in key)
        *after, t = one_pass(*unflat(first_state, like), t0, pulled.astype(float), place[ids].astype(np.int32), first, y, np.random.default_rng([7, epoch, g]))
        out = flat(*after)
        cuts = range(0, len(out), BLOCK)
        n = len(cuts)
        whole = lambda x: pa.array(np.full(n, x, np.int64))
        return pa.table({"k": pa.array(np.arange(n, dtype=np.int32)), "lane": whole(lane), "g": whole(g), "rows": whole(len(y)), "t": whole(t * len(y)), "part": pa.array([out[i : i + BLOCK].tobytes() for i in cuts], pa.binary())})

    def by_lane(batches):
        """Of the states, which come lane by lane: the mean of each lane, with its first g, its rows and the sum of their t."""
        lane, head, sums = None, 0, {}

        def means():
            ks = sorted(sums)
            whole = lambda i: pa.array([sums[k][i] for k in ks], pa.int64())
            parts = pa.array([(sums[k][2] / sums[k][0]).astype(np.float32).tobytes() for k in ks], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array([head] * len(ks), pa.int64()), whole(0), whole(1), parts], names=["k", "g", "rows", "t", "part"])

        for b in batches:
            for k, here, g, n, t, part in zip(*(b.column(c).to_pylist() for c in ("k", "lane", "g", "rows", "t")), b.column("part"), strict=True):
                if here != lane:
                    if sums:
                        yield means()
                    lane, head, sums = here, g, {}
                x = n * np.frombuffer(part.as_buffer(), np.float32).astype(float)
                had = sums.get(k, (0, 0, 0.0))
                sums[k] = had[0] + n, had[1] + t, had[2] + x
        if sums:
            yield means()

    def mean(table):
        table = table.sort_by("g")
        w = table.column("rows").to_numpy()
        x = sum(n * np.frombuffer(b.as_buffer(), np.float32).astype(float) for n, b in zip(w.tolist(), table.column("part"), strict=True)) / w.sum()
        return pa.table({"k": table.column("k").slice(0, 1), "t": pa.array([int(round(table.column("t").to_numpy().sum() / w.sum()))], pa.int64()), "part": pa.array([x.astype(np.float32).tobytes()], pa.binary())})

    taken = rows.select("lane", "g", "o", "y", "n", "ids").groupBy("lane", "g").applyInArrow(steps, "k int, lane bigint, g bigint, rows bigint, t bigint, part binary")
    lanes = taken.mapInArrow(by_lane, "k int, g bigint, rows bigint, t bigint, part binary")
    done = lanes.groupBy("k").applyInArrow(mean, "k int, t bigint, part binary").toArrow().sort_by("k")
    out = np.frombuffer(b"".join(done.column("part").to_pylist()), np.float32)
    return (*unflat(out, p), int(done.column("t")[0].as_py()))


def thresholds(rows: DataFrame, model: Model) -> np.ndarray:
    """The threshold of each language, from the logits of all rows."""

    def run(batches):
        tables = model.tables()
        for b in batches:
            for part in pieces(b):
                ids, first, y = unpacked(part)
                z = np.rint(logits(model, tables, ids.astype(np.int32), first) * GRID).astype(np.int64)
                found, n = np.unique(np.stack([part.column("lang").to_numpy().astype(np.int64), z, y.astype(np.int64)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(n)], names=["lang", "z", "y", "n"])

    got = rows.select("lang", "y", "n", "ids").mapInArrow(run, "lang bigint, z bigint, y bigint, n bigint").groupBy("lang", "z", "y").agg(F.sum("n").alias("n")).toArrow()
    lang, z, y, n = (got.column(c).to_numpy() for c in ("lang", "z", "y", "n"))
    return np.array([threshold(z[lang == i] / GRID, y[lang == i], n[lang == i]) for i in range(len(LANGUAGES) + 1)])


def threshold(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """Middle of the widest gap among cuts with the best balanced accuracy; 0 without both classes. n: how often each pair of z and y occurs."""
    z, at = np.unique(z, return_inverse=True)
    n = np.ones(len(y)) if n is None else n
    one, zero = np.bincount(at, n * y, len(z)), np.bincount(at, n * (1 - y), len(z))
    if min(one.sum(), zero.sum()) < 5 or len(z) < 2:
        return 0.0
    good = (np.cumsum(zero) / zero.sum() + 1 - np.cumsum(one) / one.sum())[:-1]
    best = np.flatnonzero(good >= good.max() - 1e-9)
    i = best[np.argmax(np.diff(z)[best])]
    return float((z[i] + z[i + 1]) / 2)


def scorer(model: Model | None):
    """A column function: text -> calibrated probability."""
    tables: list[np.ndarray] = []

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.zeros(len(text)))
        if not tables:
            tables.extend(model.tables())
        out, languages = np.zeros(len(text)), Languages()
        for a, b, words in chunks(text, True, IS_ALNUM):
            z = logits(model, tables, bucketed(words), words.first)
            z -= np.where(words.counts > 0, model.shift[languages(words.hashes(), words.owner(), b - a)], 0)
            out[a:b] = 1 / (1 + np.exp(-z))
        return pa.array(out)

    return score


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(y, o, doc_id, text): at most SAMPLE_ROWS[class] labelled rows of each class outside the held-out fold, in the order of a hash of the id.

    An id that is labelled more than once takes its largest label; ids without a text are passed over.
    """
    marks = labels.filter(F.col(label).isin(0, 1)).filter(fold(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    marks = marks.withColumn("o", F.xxhash64(F.lit(label), "doc_id"))
    # more ids than rows are taken, as some have no text; their number is what is bounded
    picked = [marks.filter(F.col("y") == c).orderBy("o", "doc_id").limit(2 * SAMPLE_ROWS[c]) for c in (0, 1)]
    rows = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    return rows.filter("y = 0").orderBy("o", "doc_id", "text").limit(SAMPLE_ROWS[0]).unionByName(rows.filter("y = 1").orderBy("o", "doc_id", "text").limit(SAMPLE_ROWS[1]))


def bounded(rows: Iterable[tuple[int, float, str]], limit: int = 0) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the rows (o, y, text), in the order of o and as long as they fit in `limit` bytes."""
    texts, y, left = [], [], limit or SAMPLE_BYTES
    for _, label, text in sorted(rows):
        n = len(text.encode())
        if n <= left:
            texts.append(text)
            y.append(label)
            left -= n
    return texts, np.array(y, float)


def in_one_task(rows: DataFrame, train) -> object | None:
    """train(texts, y) over op6's sample rows, in one task; None without both classes.

    The sample is bounded, and a lost executor only means that the task runs again.
    """

    def run(batches):
        got = [(y, o, t) for b in batches for y, o, t in zip(b.column("y").to_pylist(), b.column("o").to_pylist(), b.column("text").to_pylist(), strict=True)]
        texts, y = bounded([(o, label, t) for label, o, t in got])
        if len(set(y)) == 2:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, y))], pa.binary())], names=["model"])

    found = rows.select("y", "o", "text").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def place_of_bit(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(BITS))


def bitmap(marks: DataFrame) -> np.ndarray:
    """BITS bits, in bytes; those of all ids in marks are set."""

    def block(key, table):
        bits = np.zeros(BLOCK_BITS, np.uint8)
        bits[table.column("at").to_numpy() % BLOCK_BITS] = 1
        return pa.table({"b": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    got = marks.select(place_of_bit("doc_id").alias("at")).withColumn("b", F.floor(F.col("at") / BLOCK_BITS)).groupBy("b").applyInArrow(block, "b bigint, bits binary").toArrow()
    out = np.zeros((BITS // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for b, bits in zip(got.column("b").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[b] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(o, y, lang, n, ids): every row with a text and a label, outside the held-out fold, encoded; o is a hash that deals them into groups.

    An id that is labelled more than once takes its largest label. Where the labels are too many
    to be broadcast, no text is shuffled: rows that a bitmap of the labelled ids excludes are
    passed over, and the others meet their labels as embedding rows.
    """
    marks = labels.filter(F.col(label).isin(0, 1)).filter(fold(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    texts, o = docs.filter("text is not null").select("doc_id", "text"), F.xxhash64(F.lit(label), "doc_id", "text").alias("o")
    if marks.count() <= BROADCAST_ROWS:
        return encoded(texts.join(F.broadcast(marks), "doc_id").select(o, "y", "text"))
    perhaps = texts.filter("doc_id is not null").select("doc_id", o, place_of_bit("doc_id").alias("at"), "text")
    return encoded(perhaps, bitmap(marks)).join(marks, "doc_id").select("o", "y", "lang", "n", "ids")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0) -> Model | None:
    """The model that all labelled rows outside the held-out fold give; None without both classes."""
    spark = docs.sparkSession
    path = new_path(spark, "train")
    kept = labelled(docs, labels, label, folds, held_out)
    kept.write.option("compression", "zstd").parquet(path)
    release(spark)
    rows = spark.read.schema(kept.schema).parquet(path)
    sums = {int(r.y): r for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.sum("n").alias("words")).collect()}
    if len(sums) < 2:
        release(spark, path)
        return None
    groups = max(1, -(-sum(r.n for r in sums.values()) // GROUP_ROWS), -(-sum(r.words for r in sums.values()) // GROUP_WORDS))
    rows, *where = stored_by_group(rows, groups)
    release(spark, path)
    p, place = initial(text_counts(rows), np.array([sums[0].n, sums[1].n]))
    state = (p, {a: np.zeros_like(x) for a, x in p.items()}, {a: np.zeros_like(x) for a, x in p.items()}, 0)
    for epoch in range(EPOCHS):
        state = averaged_pass(rows, state, p["embed"], place, epoch)
        release(spark)  # the pass's shuffle of states
    model = as_model(state[0])
    model.embed = model.embed.astype(np.float32)[place]
    model.shift = thresholds(rows, model)
    forget(spark, *where)
    return model


def toxicity(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    return scorer(model)(F.col(text))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    x = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), toxicity(docs, fit(docs, labels)).alias("score"))
    return x.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone, arrow_rows, blocks, components, fresh, remember, settle

#: Words of a shingle and the weighted Jaccard similarity that links two texts.
SHINGLE, SIMILAR = 5, 0.8
#: Bands and samples in each: texts at 0.8 meet in a band but for (1 - 0.8**5)**16 = 0.2 %.
BANDS, ROWS = 16, 5
#: The idf is level up to this part of the classes, or two of them, and falls beyond it (see Weights).
COMMON = 1 / 32
#: Table of distinct counts: rows of it, places in a row, registers of a place, and registers of the count of all classes.
TABLES, PLACES, REGISTERS, ALL_REGISTERS = 2, 1 << 16, 64, 1 << 12
#: Bytes of the table that travel together, and tasks whose tables are merged at once.
SLICE, FAN_IN = 1 << 16, 64
#: Rows and bytes of vectors on one side of a bucket's comparison, columns of it at a time, and ids that are broadcast at most.
CHUNK, CHUNK_BYTES, COLUMNS, BROADCAST_IDS = 1024, 4 << 20, 2048, 500_000
#: A text with more than one of so many rows is hot: fewer than HOT texts can be.
HOT = 1024

_MIX = np.random.default_rng(20_240_501)
_ODD = _MIX.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _MIX.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_POOL = 1 << 16


def _pool() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ln c, r, beta) of the sampling scheme, sorted by what they give a shingle of weight one:
    for those the least sample is then simply the least hash."""
    rng = np.random.default_rng(7)
    r, c, beta = rng.gamma(2, 1, _POOL), rng.gamma(2, 1, _POOL), rng.random(_POOL)
    order = np.argsort(np.log(c) + r * beta - r, kind="stable")
    return np.log(c)[order], r[order], beta[order]


LOG_C, R, BETA = _pool()
UNIT = LOG_C + R * BETA - R


#: Words whose hashes a worker remembers.
MEMORY_WORDS = 100_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(word) <= 48:
            if len(self) > MEMORY_WORDS:
                self.clear()
            self[word] = value
        return value


_WORDS = _Hashes()
remember("minhash", _WORDS.clear)


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def shingles(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of a text's distinct shingles, sorted; fewer words than five are one shingle."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out, return_counts=True)


def places(hashes: np.ndarray) -> list[np.ndarray]:
    """Where the shingles lie in each row of the table of distinct counts."""
    return [((hashes >> np.uint64(shift)) & np.uint64(PLACES - 1)).astype(np.int64) for shift in (0, 40)]


def estimated(registers: np.ndarray) -> np.ndarray:
    """HyperLogLog: distinct values of each row of registers, by linear counting where they are few."""
    m = registers.shape[1]
    alpha = 0.709 if m == 64 else 0.7213 / (1 + 1.079 / m)
    raw = alpha * m * m / np.exp2(-registers.astype(np.float32)).sum(axis=1, dtype=float)
    empty = (registers == 0).sum(axis=1)
    return np.where((raw <= 2.5 * m) & (empty > 0), m * np.log(m / np.maximum(empty, 1)), raw)


class Distinct:
    """How many classes of documents hold a shingle, for all shingles at once, in memory of one size.

    Each place has HyperLogLog registers of the classes whose shingles lie there; a shingle has a place in each
    row, and the lesser count is its df. Registers are maxima, so the table of a corpus is the maximum of
    its parts' tables whatever they are: it depends neither on how rows lie in tasks nor on repeated rows.
    """

    def __init__(self) -> None:
        self.table = np.zeros((TABLES, PLACES * REGISTERS), np.uint8)
        self.all = np.zeros(ALL_REGISTERS, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Count a text's shingles for its class."""
        value = class_of(hashes)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            value = (value ^ value >> shift) * factor & 0xFFFF_FFFF_FFFF_FFFF
        rank = 53 - (value >> 12).bit_length()  # zeros before the first one of 52 bits, and one
        at = value % ALL_REGISTERS
        self.all[at] = max(self.all[at], rank)
        for row, place in zip(self.table, places(hashes), strict=True):
            where = place * REGISTERS + value % REGISTERS
            row[where] = np.maximum(row[where], rank)

    def slices(self) -> list[tuple[int, bytes]]:
        """The registers that are not all empty, as (slice, bytes); slice -1 is the count of all classes."""
        parts = self.table.reshape(-1, SLICE)
        return [(-1, self.all.tobytes()), *((int(i), parts[i].tobytes()) for i in np.flatnonzero(parts.any(axis=1)))]

    def take(self, number: int, data: bytes) -> None:
        part = self.all if number < 0 else self.table.reshape(-1, SLICE)[number]
        np.maximum(part, np.frombuffer(data, np.uint8), out=part)


class Weights:
    """TF-IDF: (1 + ln count) * idf, idf = min(1, ln(1 + N / df) / ln(1 + 1 / COMMON)), and 1 for a df of one or two.

    df counts classes of documents, not documents (see common_shingles), so that a large group
    of copies does not make its own text worthless beside its edits; the idf falls for what
    more than one class of 32 holds: licenses, headers, passages that many texts share. The idf is held by
    place, TABLES * PLACES numbers at every size of the corpus; places that hold no shingle have 1.
    """

    def __init__(self, counts: Distinct):
        classes = float(estimated(counts.all[None])[0])
        df = np.stack([estimated(row.reshape(PLACES, REGISTERS)) for row in counts.table])
        self.classes = classes
        self.idf = np.where(df < 2.5, 1.0, np.minimum(1, np.log1p(classes / np.maximum(df, 1)) / np.log1p(1 / COMMON))).astype(np.float32)

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        one, two = places(hashes)
        return (1 + np.log(counts)) * np.maximum(self.idf[0][one], self.idf[1][two])  # the greater idf is that of the lesser df


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted hashes, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    del both
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def samples(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One 64-bit sample (shingle and step) for each of BANDS * ROWS draws."""
    out = np.empty(len(_ODD), np.uint64)
    unit = weights == 1.0
    plain, odd = hashes[unit], hashes[~unit]
    least = np.full(len(_ODD), 1 << 32, np.uint64)
    for at in range(0, len(plain), 1024):
        u = (plain[None, at : at + 1024] * _ODD[:, None] + _ADD[:, None]) >> np.uint64(32)
        np.minimum(least, u.min(axis=1), out=least)
    out[:] = least
    if len(odd):
        value = np.where(least < 1 << 32, UNIT[np.minimum(least >> np.uint64(16), _POOL - 1).astype(np.int64)], np.inf)
        log_w = np.log(weights[~unit])
        for at in range(0, len(odd), 512):
            u = (odd[None, at : at + 512] * _ODD[:, None] + _ADD[:, None]) >> np.uint64(32)
            p = (u >> np.uint64(16)).astype(np.int64)
            r, beta = R[p], BETA[p]
            step = np.floor(log_w[None, at : at + 512] / r + beta)
            a = LOG_C[p] - r * (step - beta) - r
            best = a.argmin(axis=1)
            rows = np.arange(len(_ODD))
            better = a[rows, best] < value
            value = np.where(better, a[rows, best], value)
            chosen = u[rows, best] + (step[rows, best].astype(np.int64).astype(np.uint64) << np.uint64(40))
            out = np.where(better, chosen, out)
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    s = signature.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ s[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def class_of(hashes: np.ndarray) -> int:
    """One sample of a text's shingles: texts of similarity s are of one class with probability s."""
    return int((hashes * _ODD[0] + _ADD[0]).min())


def merged(parts: pa.Table) -> pa.Table:
    """The maximum of the same slice of several tables."""
    rows = parts.column("registers").to_pylist()
    out = np.frombuffer(rows[0], np.uint8).copy()
    for row in rows[1:]:
        np.maximum(out, np.frombuffer(row, np.uint8), out=out)
    return pa.table({"part": parts.column("part").slice(0, 1), "slice": parts.column("slice").slice(0, 1), "registers": pa.array([out.tobytes()], pa.binary())})


def common_shingles(docs: DataFrame) -> Weights:
    """The idf of all documents, in one pass over the texts.

    Each task counts its texts in a table of distinct counts (8 MB); tables are merged slice by slice, FAN_IN tasks at once, in as many
    steps as that takes, and the driver gets the one table that is left. A class is documents of one sample (class_of), wherever they lie.
    A df is an estimate: HyperLogLog's error (13 % of the df; a passage's shingles, held by the same classes, share it), and what else
    lies in both of its places: an average document's shingles / PLACES of all classes, which is far below COMMON unless documents have
    thousands of words; with longer ones the idf falls for all shingles alike. No class or shingle is left out.
    """
    arrow_rows(docs.sparkSession)
    schema = "part int, slice int, registers binary"

    def counted(batches):
        alone("minhash")
        seen, part = Distinct(), None
        for batch, texts in blocks(batches):
            part = batch.column("part")[0].as_py()
            for text in texts:
                h = shingles(words_of(text))[0]
                if len(h):
                    seen.add(h)
        for number, data in seen.slices() if part is not None else ():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([data], pa.binary())], ["part", "slice", "registers"])

    tables = settle(docs.select("text", F.spark_partition_id().alias("part")).mapInArrow(counted, schema))
    last = tables.agg(F.max("part")).first()[0] or 0
    while last:
        tables = tables.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part", "slice").applyInArrow(merged, schema)
        last //= FAN_IN
    counts = Distinct()
    for row in tables.select("slice", "registers").toLocalIterator():  # one table: its size is fixed
        counts.take(row["slice"], row["registers"])
    return Weights(counts)


def key_of(words: list[str]) -> bytes:
    """128 bits of a text's words: equal for equal texts, and the text's name in all steps."""
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """A row a row of docs: doc_id, key and bands; the last two are null for texts without a word and rows without an id."""

    def signed(batches):
        alone("minhash")
        for batch, texts in blocks(batches):
            keys, bands = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                words = words_of(text)
                if words and doc is not None:
                    h, n = shingles(words)
                    keys.append(key_of(words))
                    bands.append(bands_of(samples(h, weights(h, n))).view(np.int64).tolist())
                else:
                    keys.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "bands"])

    return docs.select("doc_id", "text").mapInArrow(signed, "doc_id long, key binary, bands array<long>")


def vectors_of(docs: DataFrame, ids: DataFrame, weights: Weights) -> DataFrame:
    """(id, h, w): key and weighted shingles, as bytes (w empty: all 1), of the documents named in ids (rep).

    ids are broadcast if they are few, and shuffle-joined otherwise. A task sends a text once."""
    texts = docs.select("doc_id", "text")
    few = ids.count() <= BROADCAST_IDS
    mine = texts.join(F.broadcast(ids) if few else ids, texts["doc_id"] == ids["rep"], "left_semi")

    def made(batches):
        alone("minhash")
        sent = set()
        for _, part in blocks(batches):
            out = []
            for text in part:
                words = words_of(text)
                key = key_of(words)
                if words and key not in sent:
                    sent.add(key)
                    h, n = shingles(words)
                    w = weights(h, n)
                    out.append((key, h.tobytes(), b"" if (w == 1).all() else w.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary()) for i in range(3)], ["id", "h", "w"])

    return mine.mapInArrow(made, "id binary, h binary, w binary")


def vector(h: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(h, np.uint64)
    return keys, np.frombuffer(w, np.float32).astype(float) if w else np.ones(len(keys))


def verified(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, sim) of the pairs (a, b), exactly. A hub's vector is joined last, so that a skewed join can be split."""
    left = vectors.select(F.col("id").alias("a"), F.col("h").alias("ha"), F.col("w").alias("wa"))
    right = vectors.select(F.col("id").alias("b"), F.col("h").alias("hb"), F.col("w").alias("wb"))

    def compared(batches):
        alone("minhash")
        for batch in batches:
            sims = []
            for at in range(0, batch.num_rows, 64):
                c = batch.slice(at, 64).to_pydict()
                sims += [similarity(vector(ha, wa), vector(hb, wb)) for ha, wa, hb, wb in zip(c["ha"], c["wa"], c["hb"], c["wb"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(compared, "a binary, b binary, sim double")


def shared_at_most(one: list, two: list) -> np.ndarray:
    """For each vector of one and each of two: no less than what they share, the sum of min(w, v), as
    sqrt(w * v) is never below min(w, v). Products of columns, COLUMNS at a time, of the shingles that two vectors have."""
    every, n = np.unique(np.concatenate([h for h, _ in (*one, *two)]), return_counts=True)
    every = every[n > 1]
    out = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, len(every), COLUMNS):
        part = every[at : at + COLUMNS]
        sides = []
        for side in (one, two):
            x = np.zeros((len(side), len(part)), np.float32)
            for row, (h, w) in zip(x, side, strict=True):
                place = np.minimum(np.searchsorted(part, h), len(part) - 1)
                hit = part[place] == h
                row[place[hit]] = np.sqrt(w[hit])
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out


def torn_links(table: pa.Table) -> pa.Table:
    """Of one chunk of a bucket: links (a, b) between left and right rows of different components, enough to join
    all components that its links join. Every pair counts: what may share enough is compared exactly."""
    out: tuple = ([], [])
    if table.num_rows:
        alone("minhash")
        ids = table.column("id").to_pylist()
        comp = table.column("component").to_pylist()
        vectors = [vector(h, w) for h, w in zip(table.column("h").to_pylist(), table.column("w").to_pylist(), strict=True)]
        one, two = (np.flatnonzero(table.column(x).to_numpy(zero_copy_only=False)) for x in ("left", "right"))
        if len(one) and len(two):
            total = np.array([w.sum() for _, w in vectors])
            most = shared_at_most([vectors[i] for i in one], [vectors[i] for i in two])
            need = SIMILAR / (1 + SIMILAR) * (total[one][:, None] + total[two][None, :])
            root: dict[bytes, bytes] = {}

            def find(c: bytes) -> bytes:
                while root.setdefault(c, c) != c:
                    root[c] = c = root[root[c]]
                return c

            for x, y in zip(*np.nonzero(most >= need * (1 - 1e-4)), strict=True):
                i, j = int(one[x]), int(two[y])
                a, b = find(comp[i]), find(comp[j])
                if a != b and similarity(vectors[i], vectors[j]) >= SIMILAR:
                    root[max(a, b)] = min(a, b)
                    out[0].append(ids[i])
                    out[1].append(ids[j])
    return pa.table({"a": pa.array(out[0], pa.binary()), "b": pa.array(out[1], pa.binary())})


def torn_buckets(named: DataFrame, vectors: DataFrame) -> DataFrame:
    """Links (a, b) within buckets that are not of one component.

    named: id, band, hash, component. Rows outside the leader's component (minor) are
    compared with all others of the bucket, chunk by chunk; a row goes to as many chunks as
    the other side has. Vectors come along, so that only links leave a task.
    """
    key = ["band", "hash"]
    state = named.groupBy(*key).agg(
        F.min_by("component", "id").alias("major"), F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")
    )
    torn = settle(state.where("x <> y and n > 2").select(*key, "major"))
    rows = settle(named.join(torn, key).withColumn("minor", F.col("component") != F.col("major")).drop("major"))
    weighed = rows.join(vectors.select("id", (F.octet_length("h") + F.octet_length("w")).alias("_n")), "id")
    chunks = lambda n, size: F.greatest(F.ceil(n / CHUNK), F.ceil(size / CHUNK_BYTES), F.lit(1)).cast("int")
    sizes = settle(
        weighed.groupBy(*key).agg(
            chunks(F.count_if("minor"), F.coalesce(F.sum(F.when(F.col("minor"), F.col("_n"))), F.lit(0))).alias("lefts"), chunks(F.count(F.lit(1)), F.sum("_n")).alias("rights")
        )
    )
    rows = rows.join(sizes, key).withColumn("li", F.pmod(F.xxhash64("id"), F.col("lefts")).cast("int")).withColumn("rj", F.pmod(F.xxhash64("id", F.lit(1)), F.col("rights")).cast("int"))
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    part = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    as_left = F.transform(count("rights"), lambda j: part(F.col("li"), j, F.col("minor"), F.col("minor") & (j == F.col("rj"))))
    as_right = F.transform(count("lefts"), lambda i: part(i, F.col("rj"), F.lit(False), ~F.col("minor") | (i != F.col("li"))))
    # where a minor row is on both sides of a chunk, its left entry serves for both
    rows = rows.withColumn("_p", F.explode(F.concat(as_left, as_right))).select("id", *key, "component", "_p.*").where("left or right")
    return rows.join(vectors, "id").groupBy(*key, "i", "j").applyInArrow(torn_links, "a binary, b binary").distinct()


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, key, class_id, class_key of every row of docs: class_key is the text of class_id whose row stands for the class; see near_duplicates."""
    weights = common_shingles(docs)
    signed = settle(signatures(docs, weights))
    first = signed.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("m"), F.count(F.lit(1)).alias("n"))
    classes = settle(first.select(F.col("key").alias("id"), F.col("m.doc_id").alias("rep"), "m.bands", "n"))
    members = classes.select("id", "rep", F.posexplode("bands").alias("band", "hash"))
    leaders = settle(members.groupBy("band", "hash").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    met = settle(members.join(leaders, ["band", "hash"]))
    vectors = settle(vectors_of(docs, settle(met.select("rep").distinct()), weights))
    star = met.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = settle(verified(star, vectors).where(F.col("sim") >= SIMILAR).select("a", "b"))
    label = components(links)
    named = settle(met.select("id", "band", "hash").join(label, "id", "left").withColumn("component", F.coalesce("component", "id")))
    more = settle(torn_buckets(named, vectors))
    if not more.isEmpty():
        label = components(links.unionByName(more))
    inside = label.join(classes.select("id", "rep"), "id")
    best = inside.groupBy("component").agg(F.min(F.struct("rep", "id")).alias("m"))
    inside = inside.join(best, "component").select("id", F.col("m.rep").alias("class_id"), F.col("m.id").alias("class_key"))
    final = settle(
        classes.select("id", "rep", "n").join(inside, "id", "left")
        .select(F.col("id").alias("key"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("class_key", "id").alias("class_key"), "n")
    )
    every = classes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(final.where(F.col("n") * HOT > every).drop("n"))  # rows of a hot text stay where they are
    rows = signed.where("key is not null").select("doc_id", "key")
    rest = rows.join(hot.select("key"), "key", "left_anti").join(final.drop("n"), "key")
    found = rows.join(hot, "key").unionByName(rest).select("doc_id", "key", "class_id", "class_key")
    return found.unionByName(signed.where("key is null").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.col("key").alias("class_key")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept of every row of docs (doc_id, text; other columns are not read).

    class_id is the least doc_id reachable by links: equal texts (as lower-case words), and
    texts of weighted Jaccard >= 0.8 over TF-IDF shingles of five words that meet in a band;
    every link is verified exactly, on whole texts. kept: the row stands for its class, the one of class_id
    (its repeated rows, if there are any, share the mark; of different texts under that id the one with the
    least key). Texts that are null or have no word link with nothing and are kept; rows without an id are kept, class
    null. An empty table gives no rows.

    1. Equal texts collapse. 2. In every bucket (band, hash) all members
    are compared with its leader. 3. In buckets whose members are not all connected then,
    those outside the leader's component are compared with all others, in
    chunks of bounded rows and bytes. Nothing caps buckets or candidates, and no task or driver holds one whole.
    """
    kept = F.coalesce((F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("class_key")), F.lit(True))
    return classified(docs).select("doc_id", "class_id", kept.alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, as they are (any further columns included), of one text of each class: of equal rows under one id one
    stays, any of them; different texts under one id are judged apart. Rows without an id, text or word stay."""
    rows = settle(classified(docs))
    kept = rows.where((F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("class_key")))
    once = settle(kept.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")))
    again = not rows.where("key is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    wordless = rows.where("key is null and doc_id is not null").select("doc_id").distinct()
    if not again and wordless.join(once, "doc_id", "left_semi").isEmpty():  # an id is a text
        ids = settle(once.select("doc_id").unionByName(wordless))
        few = ids.count() <= BROADCAST_IDS
        return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)
    mark = fresh("_key", docs.columns)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(mark, T.BinaryType())])

    def keyed(batches):
        for batch, part in blocks(batches):
            keys = [key_of(w) if (w := words_of(t)) else None for t in part]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(keys, pa.binary())], [*names, mark])

    named = docs.mapInArrow(keyed, schema)
    told = named.join(once.select(F.col("doc_id"), F.col("key").alias(mark)), ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    rest = named.where(F.col("doc_id").isNull() | F.col(mark).isNull())
    return told.select(*names).unionByName(rest.select(*names))

"""Near-duplicate documents: min-max hashing, banding, and links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.graphs import components

#: 90 permutations give 90 minima and 90 maxima: at 0.85 30 bands of 6, at 0.80 36 of 5. A pair at the threshold is in no common
#: band with probability 7e-7 and 6e-7. Another 90 sharpen the estimate by which the pairs of a band are screened before their
#: full sets are compared.
PERMUTATIONS, EXTRA, MISSED = 90, 90, 1e-6
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rows_of_band(per_cent: int, permutations: int) -> int:
    """The most rows of a band by which a pair at the threshold shares none of the bands with probability ``MISSED`` at most."""
    fit = [r for r in range(1, permutations + 1) if permutations % r == 0 and (1 - (per_cent / 100) ** r) ** (2 * permutations // r) <= MISSED]
    return max(fit, default=1)


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes. Words are what lies between ASCII white space, with A-Z lower-cased."""

    def __init__(self, width: int = 5, cache_size: int = 100_000):
        import xxhash

        self.width, self.cache_size, self.cache, self.digest = width, cache_size, {}, xxhash.xxh3_64_intdigest

    def words(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        cache, digest = self.cache, self.digest
        for w in set(words).difference(cache):
            cache[w] = digest(w)
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        w = self.words(text or "")
        if not len(w):
            return w
        k = min(self.width, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = h * _MULTIPLIER + w[i : len(w) - k + 1 + i]
        return np.unique(_mix(h))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_601)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation x -> a*x + b: two values for one hash evaluation."""
    low, high = np.full(len(a), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(a), np.uint64)
    for at in range(0, len(shingles), 4096):
        h = shingles[None, at : at + 4096] * a[:, None] + b[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = sig.reshape(-1, rows)
    h = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for i in range(rows):
        h = _mix(h * _MULTIPLIER + bands[:, i])
    return h.view(np.int64)


def planes(sig: np.ndarray) -> np.ndarray:
    """Four bits of each value, as four rows of bits, 64 values to a number: enough to estimate a similarity."""
    groups = -(-len(sig) // 64)
    four = np.zeros(groups * 64, np.uint64)
    four[: len(sig)] = _mix(sig)
    shift = np.arange(64, dtype=np.uint64)
    return np.concatenate([((four.reshape(-1, 64) >> np.uint64(k) & np.uint64(1)) << shift).sum(axis=1, dtype=np.uint64) for k in range(4)]).view(np.int64)


def _flat(df: DataFrame, name: str, values: int, prefix: str) -> DataFrame:
    """The numbers of an array column as columns of their own: an expression over them stays small enough to be compiled."""
    return df.select(*(c for c in df.columns if c != name), *(F.col(name)[i].alias(f"{prefix}{i}") for i in range(4 * -(-values // 64))))


def _agreeing(left: str, right: str, values: int) -> Column:
    """How many of the signature's values agree, as far as their four bits tell."""
    groups = -(-values // 64)
    apart = F.lit(0)
    for g in range(groups):
        x = [F.col(f"{left}{k * groups + g}").bitwiseXOR(F.col(f"{right}{k * groups + g}")) for k in range(4)]
        apart = apart + F.bit_count(x[0].bitwiseOR(x[1]).bitwiseOR(x[2].bitwiseOR(x[3])))
    return F.lit(values) - apart


def _level(values: int, per_cent: int) -> int:
    """The agreement that a pair at the threshold stays below once in millions of times."""
    p = per_cent / 100 + (1 - per_cent / 100) / 16
    return int(values * p - 5.1 * (values * p * (1 - p)) ** 0.5)


def _sketch(schema: T.StructType, width: int, permutations: int, extra: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        s, (a, b) = Shingler(width), _permutations(permutations + extra)
        n_bands = 2 * permutations // rows
        for batch in batches:
            sizes, prints, keys, bits, offsets = [], [], [], [], [0]
            for text in batch.column(1).to_pylist():
                x = s.shingles(text)
                sizes.append(len(x))
                prints.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                if len(x):
                    sig = signature(x, a, b)
                    keys.append(band_keys(np.concatenate([sig[:permutations], sig[permutations + extra :][:permutations]]), rows))
                bits.append(planes(sig) if len(x) else None)
                offsets.append(offsets[-1] + (n_bands if len(x) else 0))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            cols = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return run


def _sets(schema: T.StructType, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingler(width)
        for batch in batches:
            cols = [batch.column(0), pa.array([s.shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return run


def _similar(x: np.ndarray, y: np.ndarray, per_cent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= per_cent * (len(x) + len(y) - common)


def _tested(schema: T.StructType, per_cent: int):
    """Rows sorted by tile, a tile's sets before its pairs: the pairs whose sets are similar enough. Holds one tile's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sets = None, {}
        for batch in batches:
            key, x, y, id_, blob, v = (c.to_pylist() for c in batch.columns)
            found = []
            for *at, u, data, w in zip(key, x, y, id_, blob, v, strict=True):
                if at != tile:
                    tile, sets = at, {}
                if data is not None:
                    sets.setdefault(u, []).append(np.frombuffer(data, np.uint64))
                elif any(_similar(s, t, per_cent) for s in sets[u] for t in sets[w]):
                    found.append((u, w))
            cols = [pa.array([pair[i] for pair in found], field.type) for i, field in enumerate(schema)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, per_cent: int, tile_bytes: int) -> DataFrame:
    """The pairs (key, weight, u, v) whose full sets are similar enough, as rows (u, v).

    A bucket whose sets take ``weight`` bytes is cut in parts of about ``tile_bytes`` by a hash of the id; two parts make a
    tile. A set is sent once to each tile that asks for it, however many pairs it has there, and a task holds one tile.
    """
    parts = F.ceil(F.col("weight") / tile_bytes)
    asked = pairs.select("key", *(F.pmod(F.xxhash64(c), parts).alias(f"part_{c}") for c in ("u", "v")), "u", "v")
    tile = ["key", "part_u", "part_v"]
    needed = asked.select(*tile, F.explode(F.array("u", "v")).alias("id")).distinct().join(sets, "id")
    kind = sets.schema["id"].dataType
    rows = needed.select(*tile, "id", "set", F.lit(None).cast(kind).alias("v")).unionByName(asked.select(*tile, F.col("u").alias("id"), F.lit(None).cast("binary").alias("set"), "v"))
    shape = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])
    sorted_rows = rows.repartition(*tile).sortWithinPartitions(*tile, F.col("set").isNull())
    return sorted_rows.mapInArrow(_tested(to_arrow_schema(shape), per_cent), shape)


class Tile:
    """Rows (part, id, component, keys, bits, n, set) of one tile (key, a, b) of a bucket."""

    def __init__(self, tile: tuple, rows: list, per_cent: int, values: int, level: int):
        part, self.ids, names, keys, bits, n, self.blobs = zip(*rows, strict=True)
        codes = {c: i for i, c in enumerate(dict.fromkeys(names))}
        self.tile, self.per_cent, self.values, self.level, self.crossing = tile, per_cent, values, level, tile[1] != tile[2]
        self.label, self.part, self.n, self.keys = np.array([codes[c] for c in names]), np.array(part), np.array(n), np.stack(keys)
        self.bits = np.stack(bits).view(np.uint64).reshape(len(rows), 4, -1)
        self.band = np.argmax((self.keys == tile[0]).any(axis=0))

    def partners(self, i: int) -> np.ndarray:
        """Rows after ``i`` that its signature and size leave as possible links to another component, likeliest first."""
        m = self.n[i + 1 :]
        maybe = (self.label[i + 1 :] != self.label[i]) & (100 * np.minimum(m, self.n[i]) >= self.per_cent * np.maximum(m, self.n[i]))
        if self.crossing:
            maybe &= self.part[i + 1 :] != self.part[i]
        at = i + 1 + np.flatnonzero(maybe)
        agree = self.values - np.bitwise_count(np.bitwise_or.reduce(self.bits[at] ^ self.bits[i], axis=1)).sum(axis=1, dtype=np.int64)
        at, agree = at[agree >= self.level], agree[agree >= self.level]
        # of the buckets that two share only the first compares them; if one of them is the hub there, that has been done
        first = (self.keys[at] == self.keys[i]).argmax(axis=1) == self.band
        return at[first][np.argsort(-agree[first], kind="stable")]

    def wanted(self) -> list:
        """Rows (key, a, b, part, id) that have a possible link."""
        some = np.zeros(len(self.ids), bool)
        for i in range(len(self.ids) - 1):
            at = self.partners(i)
            some[at] = True
            some[i] |= len(at) > 0
        return [(*self.tile, int(self.part[i]), self.ids[i]) for i in np.flatnonzero(some)]

    def links(self) -> list:
        """Links (u, v) that join components. Holds no list of pairs."""
        sets, found = [np.frombuffer(x, np.uint64) for x in self.blobs], []
        for i in range(len(sets) - 1):
            for j in self.partners(i):
                if self.label[i] != self.label[j] and _similar(sets[i], sets[j], self.per_cent):
                    found.append((self.ids[i], self.ids[j]))
                    self.label[self.label == self.label[j]] = self.label[i]
        return found


def _by_tile(schema: T.StructType, result: str, per_cent: int, values: int, level: int):
    """What the method ``result`` of each tile gives; rows come sorted by tile, and one tile is held at a time."""
    arrow = to_arrow_schema(schema)

    def made(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], field.type) for i, field in enumerate(arrow)], names=arrow.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, found = None, [], []
        for batch in batches:
            lists = {c: batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("keys", "bits")}
            plain = [batch.column(c).to_pylist() for c in ("key", "a", "b", "part", "rep", "component", "n")]
            blobs = batch.column("set").to_pylist() if "set" in batch.schema.names else [None] * batch.num_rows
            for i, (key, a, b, part, rep, component, n, blob) in enumerate(zip(*plain, blobs, strict=True)):
                if (key, a, b) != tile:
                    if len(rows) > 1:
                        found += getattr(Tile(tile, rows, per_cent, values, level), result)()
                    tile, rows = (key, a, b), []
                rows.append((part, rep, component, lists["keys"][i], lists["bits"][i], n if blob is None else len(blob) // 8, blob))
            yield made(found)
            found = []
        if len(rows) > 1:
            yield made(getattr(Tile(tile, rows, per_cent, values, level), result)())

    return run


def near_duplicates(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    per_cent: int = 85,
    permutations: int = PERMUTATIONS,
    rows: int | None = None,
    extra: int = EXTRA,
    tile_bytes: int = 8 << 20,
) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept): near-duplicate groups over whole texts.

    Two documents are linked if 100 * intersection >= ``per_cent`` * union of their shingle sets; component_id is the
    smallest id that links reach, and kept marks the document that bears it. A text without words (or null) has no
    shingles and is linked with nothing; one with fewer words than ``width`` has its whole sequence as its one shingle.

    * Documents with equal sets are one class, stood for by its smallest id, so that copies never meet in pairs.
    * Classes that share a band form a bucket. In each, all are compared with one hub, drawn by one of four hashes, so that a group
      has up to four hubs over all its bands. Components of the confirmed links follow. Then buckets whose rows are still apart meet themselves in
      tiles of about twice ``tile_bytes``, so that no task holds the whole of a large one (p parts make p * (p + 1) / 2 tiles, so what
      is sent grows with the square of such a bucket, the only step that does): first their signatures, then
      the full sets of rows whose signatures leave a possible link. A tile gives links only, never
      its pairs, and skips pairs that links join already; so no link that joins two groups is lost.
      Only pairs whose sizes forbid a link, or whose signatures agree five standard deviations too rarely, are left out.
    * All links are confirmed on the full sets.

    Rows with a null id link with nothing and keep a null component_id; kept is true. Rows that share an id are one node:
    what one links with, all do. Other columns are not read. Needs a checkpoint directory.
    """
    rows = rows or rows_of_band(per_cent, permutations)
    kind = df.schema[id_col].dataType
    sketch = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))])
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketches = texts.mapInArrow(_sketch(sketch, width, permutations, extra, rows), sketch).checkpoint()
    # most steps look at these three numbers only
    docs = sketches.select("id", "n", "print").checkpoint()
    sketched = sketches.filter("n > 0 and id is not null").groupBy("print", "n").agg(F.min("id").alias("rep"), F.first(F.struct("keys", "bits")).alias("s"))
    reps = sketched.select("rep", "n", "s.keys", "s.bits").checkpoint()
    used = docs.filter("n > 0 and id is not null")
    total = used.count()
    classes = used.groupBy("print", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).checkpoint()
    values = 2 * (permutations + extra)
    level = _level(values, per_cent)
    agreeing = _agreeing("x", "y", values)
    keyed = reps.select("rep", "n", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.pmod("key", F.lit(4)), "rep").alias("h"), "rep")).alias("hub"), F.count("*").alias("size"), F.sum(8 * F.col("n") + 800).alias("weight")).filter("size > 1").select("key", "weight", F.col("hub.rep").alias("hub"))
    members = keyed.join(hubs, "key").checkpoint()

    pairs = members.filter("rep <> hub").groupBy(F.greatest("rep", "hub").alias("u"), F.least("rep", "hub").alias("v")).agg(F.min(F.struct("key", "weight")).alias("at"))
    u, v = (_flat(reps.select(F.col("rep").alias(name), "bits"), "bits", values, prefix) for name, prefix in (("u", "x"), ("v", "y")))
    pairs = pairs.join(u, "u").join(v, "v").filter(agreeing >= level).select("at.key", "at.weight", "u", "v")
    wanted = members.select(F.col("rep").alias("id")).distinct()
    shape = T.StructType([T.StructField("id", kind), T.StructField("set", T.BinaryType())])
    kept_texts = texts.join(wanted, "id", "left_semi")
    sets = kept_texts.mapInArrow(_sets(shape, width), shape).filter("octet_length(set) > 0").checkpoint()
    repeated = docs.filter("id is not null").groupBy("id").count().filter("count > 1").select("id")
    shared = docs.join(repeated, "id").join(classes.select("print", "n", "rep"), ["print", "n"]).filter("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    links = _confirm(pairs, sets, per_cent, tile_bytes).unionByName(shared).checkpoint()

    found = components(links)
    placed = members.filter("rep <> hub").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = F.ceil(F.first("weight") / tile_bytes).alias("parts")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), parts).filter("lo <> hi").select("key", "parts")
    apart = placed.join(open_keys, "key").withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))
    apart = apart.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tiled = apart.select("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "rep", "component").checkpoint()
    at = ["key", "a", "b"]
    rep_sketches = reps.select("rep", "keys", "bits", "n")
    place = T.StructType([*(T.StructField(c, T.LongType()) for c in [*at, "part"]), T.StructField("rep", kind)])
    screened = tiled.join(rep_sketches, "rep").repartition(*at).sortWithinPartitions(*at)
    screened = screened.mapInArrow(_by_tile(place, "wanted", per_cent, values, level), place).distinct().checkpoint()
    pair = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])
    compared = tiled.join(screened, place.names, "left_semi").join(rep_sketches, "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
    compared = compared.repartition(*at).sortWithinPartitions(*at)
    more = compared.mapInArrow(_by_tile(pair, "links", per_cent, values, level), pair).checkpoint()
    if not more.isEmpty():
        found = components(links.unionByName(more))

    # classes of a hundredth of a per cent of all rows or more are ten thousand at most: they are broadcast, so that the others' rows
    # spread over the join's tasks; rows without words or id need no class
    heavy = classes.filter(F.col("copies") * 10_000 >= total)
    by_class = heavy.select(F.col("print").alias("h_print"), F.col("n").alias("h_n"), F.col("rep").alias("h_rep"))
    tagged = used.join(F.broadcast(by_class), (F.col("print") == F.col("h_print")) & (F.col("n") == F.col("h_n")), "left")
    of_heavy = tagged.filter("h_rep is not null").select("id", "n", F.col("h_rep").alias("rep"))
    light = classes.filter(F.col("copies") * 10_000 < total).select("print", "n", "rep")
    of_light = tagged.filter("h_rep is null").select("id", "n", "print").join(light, ["print", "n"]).select("id", "n", "rep")
    # the components of the heavy classes are as few; the others' classes have few rows each
    by_rep = found.join(F.broadcast(heavy.select(F.col("rep").alias("node"))), "node", "left_semi").select(F.col("node").alias("rep"), "component")
    of_heavy = of_heavy.join(F.broadcast(by_rep), "rep", "left")
    of_light = of_light.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    own = found.join(repeated, found.node == repeated.id).select("id", F.col("component").alias("own"))
    out = of_heavy.unionByName(of_light).join(own, "id", "left")
    rest = docs.filter("id is null or n = 0").join(own, "id", "left").select("id", "n", F.lit(None).cast(kind).alias("rep"), F.lit(None).cast(kind).alias("component"), "own")
    out = out.select("id", "n", "rep", "component", "own").unionByName(rest)
    component = F.coalesce("own", "component", F.when(F.col("id").isNotNull(), F.col("rep")), "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(df: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` whose document stands for its group; all columns stay. Rows with a null id stay too."""
    gone = near_duplicates(df, id_col=id_col, **options).filter("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return df.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")

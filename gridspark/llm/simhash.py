"""SimHash near-duplicates (operator 6): tiled exact comparison with numpy exclusive-or and bit counts.

Two fingerprints that differ in r bits have population counts that differ by r at most. That holds for each segment of
the 64 bits, summed over the segments, so a tile is the fingerprints with equal counts in each of `segments` segments,
and tile pairs whose counts differ by more than the radius in sum are never met. Within a pair, blocks of BLOCK rows
are skipped in the same way by the ranges of their counts in the eight bytes. What is left is compared exactly.

Only distinct fingerprints are compared, so exact copies cost nothing. A task returns the links of its tiles as a
spanning forest, never as all pairs. Components of the forest's edges are found on DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm._common import field, sieved, written
from gridspark.llm.components import components

SEED = 42
BLOCK = 1024  # rows of a block within a tile
TILE_ROWS = 65_536  # rows that the fullest tile should have: more segments are taken where there are more fingerprints
CHUNK_ROWS = 65_536  # a tile of more rows is divided
PART_BYTES = 1 << 20  # of a text hashed at a time
WORDS = 4  # 64-bit words of a wide fingerprint
MINIMA = 6  # of two texts that share 0.8 of their shingles, all minima differ in 1 of 15,000 cases
WIDE_RADIUS = 72  # of 256 bits; sets that share 0.8 differ in 39 bits, give or take 6 (4 of 5 shingles: 48): it only proposes
ALIKE = (4, 5)  # what two texts share of their distinct shingles, as a fraction
SET_ROWS, SET_BYTES = 4096, 16 << 20  # proposed groups of more texts, or more bytes of shingle hashes, are compared in parts

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_COUNTS = _BITS.sum(axis=1).astype(np.int16)


def _parts(text: bytes, width: int) -> Iterator[list[bytes]]:
    """Words in runs of bounded bytes; each run but the first begins with the last width - 1 words of the one before."""
    at, tail = 0, []
    while at < len(text):
        end = at + PART_BYTES
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = text[at:end].split()
        yield tail + words
        tail = (tail + words)[-(width - 1) :] if width > 1 else []
        at = end


def _hashes(text: bytes | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, of fewer words than `width` the whole sequence, none without words; in bounded runs."""
    from xxhash import xxh64_intdigest

    few, some = [], False
    for words in _parts((text or b"").lower(), width):  # of bytes: A-Z alone
        if len(words) < width:
            few = words
            continue
        some = True
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
        yield np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - width + 1)
    if few and not some:
        yield np.array([xxh64_intdigest(b" ".join(few), SEED)], np.uint64)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit: 8 bytes by 8 bits."""
    byte = h.view(np.uint8).reshape(-1, 8)
    return np.array([np.bincount(byte[:, k], minlength=256) @ _BITS for k in range(8)])


def _packed(ones: np.ndarray, total: int) -> bytes:
    return np.packbits((2 * ones > total).astype(np.uint8), axis=1, bitorder="little").tobytes()


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of the XXH64 hashes of all word shingles, unsigned; 0 without words."""
    ones, total = np.zeros((8, 8), np.int64), 0
    for h in _hashes(text, width):
        ones += _ones(h)
        total += len(h)
    return int.from_bytes(_packed(ones, total), "little")


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of the same shingles."""
    x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The distinct hashes of the word shingles, ascending."""
    parts = [np.unique(h) for h in _hashes(text, width)]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint64)


def wide_fingerprint(h: np.ndarray) -> tuple[bytes, list[int]]:
    """Of a set of hashes: SimHash of 64 * WORDS bits, and the least of the hashes in each of MINIMA orders."""
    ones = [_ones(h), *(_ones(_mixed(h, k)) for k in range(1, WORDS))]
    least = np.array([_mixed(h, 100 + k).min(initial=np.uint64(0xFFFFFFFFFFFFFFFF)) for k in range(MINIMA)], np.uint64)
    return b"".join(_packed(o, len(h)) for o in ones), least.view(np.int64).tolist()


def alike(sets: list[np.ndarray], home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all pairs of the sets whose Jaccard similarity is ALIKE or more, each checked exactly; with `home`
    (booleans), all such pairs of one set at home and one elsewhere. Pairs already joined are not looked at again."""
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.zeros(0, np.int64)
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    label, mark, (p, q) = np.arange(n), np.zeros(len(number) + 1, bool), ALIKE
    most = max(1, (1 << 22) // max(1, int(size.max(initial=1))))  # sets gathered at a time
    left, right = [], []
    for a in range(n) if home is None else np.flatnonzero(home):
        mine = number[start[a] : start[a + 1]]
        other = np.arange(a + 1, n) if home is None else np.flatnonzero(~home)
        other = other[(label[other] != label[a]) & (q * np.minimum(size[other], size[a]) >= p * np.maximum(size[other], size[a])) & (size[other] > 0)]
        mark[mine] = True
        for i in range(0, len(other), most):
            b = other[i : i + most]
            b = b[label[b] != label[a]]
            if not len(b):
                continue
            first = np.cumsum(size[b]) - size[b]
            at = np.arange(int(size[b].sum())) + np.repeat(start[b] - first, size[b])
            both = np.add.reduceat(mark[number[at]], first, dtype=np.int64)
            b = b[(p + q) * both >= p * (size[a] + size[b])]
            if len(b):
                classes, one = np.unique(label[b], return_index=True)
                left += [a] * len(one)
                right += b[one].tolist()
                label[np.isin(label, classes)] = label[a]
        mark[mine] = False
    return np.array(left, np.int64), np.array(right, np.int64)


def _node(h: np.ndarray) -> int:
    """Number of a set of shingles: the hash of its hashes, as a signed long."""
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(h.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, text_hash, print) of each row: print is the fingerprint as a signed long. No shuffle."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(prints.view(np.int64))], ["id", "text_hash", "print"])

    schema = T.StructType([field(docs, id_col, "id"), T.StructField("text_hash", T.LongType()), T.StructField("print", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")).mapInArrow(made, schema)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label[i] is the root of i; joins the classes of a[k] and b[k] for all k."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def _blocks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Order by the bytes' counts, the sorted values, the blocks, the least and greatest counts in each block."""
    counts = _COUNTS[x.view(np.uint8).reshape(len(x), -1)]
    order = np.lexsort(counts.T)
    counts = counts[order]
    cut = [(i, min(i + BLOCK, len(x))) for i in range(0, len(x), BLOCK)]
    return order, x[order], cut, np.array([counts[i:j].min(axis=0) for i, j in cut]), np.array([counts[i:j].max(axis=0) for i, j in cut])


def forest(home: np.ndarray, guests: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within home and between home and guests (rows of 64-bit words), as edges from each linked row's number, home
    first, to its class's root."""
    label = np.arange(len(home) + len(guests))
    if not len(home):
        return label[:0], label[:0]
    order, mine, cut, low, high = _blocks(home)
    sides = [(order, mine, cut, low, high, True)]
    if len(guests):
        o, g, c, lo, hi = _blocks(guests)
        sides.append((o + len(home), g, c, lo, hi, False))
    for i, (s, e) in enumerate(cut):
        for o, other, c, lo, hi, own in sides:
            apart = np.maximum(0, np.maximum(lo - high[i], low[i] - hi)).sum(axis=1)
            for j in np.flatnonzero(apart <= radius):
                if own and j < i:
                    continue
                p, q = c[j]
                bits = np.bitwise_count(mine[s:e, None, 0] ^ other[None, p:q, 0])
                for w in range(1, mine.shape[1]):
                    bits = np.add(bits, np.bitwise_count(mine[s:e, None, w] ^ other[None, p:q, w]), dtype=np.uint16)
                near = bits <= radius
                if own and i == j:
                    near = np.triu(near, 1)
                a, b = np.nonzero(near)
                label = merge(label, order[a + s], o[b + p])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def segments_for(n: int) -> int:
    """4, 8 or 16 segments: the fewest for which the fullest tile of n random fingerprints has TILE_ROWS rows (4 up to 40
    million fingerprints, 8 up to two billion). It decides how much is compared, never what is found."""
    from math import comb

    return next((k for k in (4, 8) if n * (comb(64 // k, 32 // k) / 2 ** (64 // k)) ** k <= TILE_ROWS), 16)


def _tile(x: Column, k: int) -> list[Column]:
    w = 64 // k
    return [F.bit_count(F.shiftrightunsigned(x, w * i).bitwiseAND(F.lit((1 << w) - 1))).cast("int") for i in range(k)]


def links(prints: DataFrame, n: int, radius: int = 2, *, segments: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Edges (a, b) that join all of the n distinct fingerprints (column print) that differ in radius bits or fewer."""
    k = segments or segments_for(n)
    base = 64 // k + 1 + 2 * radius  # so no neighbour's number is another tile's
    number = lambda digits: sum((d * base**i for i, d in enumerate(digits)), 0)
    ahead = [number(d) for d in _ball(k, radius) if d > (0,) * k]  # of two tiles, one visits the other
    tile = F.lit(0).cast("long")
    for i, c in enumerate(_tile(F.col("print"), k)):
        tile = tile + (c + radius).cast("long") * F.lit(base**i)
    rows = prints.select("print", tile.alias("tile"))
    full = rows.groupBy("tile").count().where(F.col("count") > chunk_rows).select("tile", F.ceil(F.col("count") / chunk_rows).cast("int").alias("chunks"))
    steps = F.array(*[F.lit(x).cast("long") for x in [0, *ahead]])
    visits = rows.select(F.col("print").alias("node"), F.col("print").alias("bits"), F.posexplode(F.transform(steps, lambda x: x + F.col("tile"))).alias("pos", "tile"))
    return compared(visits, full, radius)


def compared(visits: DataFrame, full: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between nodes that meet in a tile and differ in radius bits or fewer. visits: node, bits (long or binary),
    tile, pos (0: at home there; others only meet those at home). full: tiles that are divided, and into how many chunks."""
    dealt = visits.join(full, "tile", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    first = F.when(F.col("pos") == 0, own).otherwise(F.lit(0))
    dealt = dealt.select("node", "bits", "tile", F.posexplode(F.sequence(first, F.col("chunks") - 1)).alias("k", "chunk"), (F.col("pos") == 0).alias("here"))
    dealt = dealt.select("tile", "chunk", "node", "bits", (F.col("here") & (F.col("k") == 0)).alias("home"))

    def linked(group: pa.Table) -> pa.Table:
        node, home = group.column("node").to_numpy().astype(np.int64), group.column("home").to_numpy().astype(bool)
        bits = group.column("bits").combine_chunks()
        if len(node) < 2:
            return pa.table({"a": node[:0], "b": node[:0]})
        rows = np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(len(node), -1) if pa.types.is_binary(bits.type) else np.array(bits, np.int64).view(np.uint64)[:, None]
        order = np.concatenate([np.flatnonzero(home), np.flatnonzero(~home)])
        n = int(home.sum())
        a, b = forest(np.ascontiguousarray(rows[order[:n]]), np.ascontiguousarray(rows[order[n:]]), radius)
        return pa.table({"a": node[order[a]], "b": node[order[b]]})

    return dealt.groupBy("tile", "chunk").applyInArrow(linked, "a long, b long")


def _ball(k: int, radius: int) -> list[tuple[int, ...]]:
    """Integer vectors of length k whose absolute values sum to radius or less."""
    out = [(0,) * k]
    for _ in range(radius):
        out = list(dict.fromkeys(out + [v[:i] + (v[i] + s,) + v[i + 1 :] for v in out for i in range(k) for s in (-1, 1)]))
    return [v for v in out if sum(map(abs, v)) <= radius]


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of docs: id, text_hash, print (signed long), group (of linked fingerprints), component_id.

    component_id is the smallest id in the group, null only if all its ids are null. A null text and one without words
    have fingerprint zero and link as any other; rows repeated or with one id are rows of their own; an empty table
    gives no rows. Other columns of docs are not read. Any two different fingerprints within the radius end in one
    group."""
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "prints")
    nodes = written(prints.groupBy("print").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes.select("print"), nodes.count(), radius))
    nodes = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("group"))
    lowest = nodes.groupBy("group").agg(F.min("least").alias("component_id"))
    return prints.join(nodes.select("print", "group").join(lowest, "group"), "print").select("id", "text_hash", "print", "group", "component_id")


def verified(sets: DataFrame, *, set_rows: int = SET_ROWS, set_bytes: int = SET_BYTES) -> DataFrame:
    """Edges (a, b) that join all nodes of one root whose shingle sets are ALIKE. sets: node, root, shingles.

    The nodes of a root are dealt to chunks of bounded rows and bytes, and each pair of chunks is a task's."""
    sizes = sets.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / set_rows), F.ceil(F.sum(F.octet_length("shingles")) / set_bytes)).cast("int").alias("chunks"))
    dealt = sets.join(sizes.where("chunks > 1"), "root", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.select("root", "node", "shingles", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "shingles")

    def linked(group: pa.Table) -> pa.Table:
        node, own = group.column("node").to_numpy(), group.column("own").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        a, b = alike(sets, None if low == high else own == low)
        return pa.table({"a": node[a].astype(np.int64), "b": node[b].astype(np.int64)})

    return dealt.groupBy("root", "low", "high").applyInArrow(linked, "a long, b long")


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = WIDE_RADIUS, chunk_rows: int = CHUNK_ROWS, set_rows: int = SET_ROWS, set_bytes: int = SET_BYTES) -> DataFrame:
    """One row per row of docs: id, text_hash, group. In a group are texts linked by pairs that share 0.8 or more of their
    distinct shingles (exact Jaccard similarity of the sets of their 64-bit hashes). Cases as in `near_groups`.

    A node is a set of shingles. Wide fingerprints propose: a tile is the nodes that share one of MINIMA least hashes, in a
    tile those radius bits or fewer apart are found as in `near_groups`. Within the components of what is proposed, the
    sets themselves decide. A pair at 0.8 shares no minimum in 1 of 15,000 cases, and is seldom more than radius bits apart.

    Sets take more room than the texts, so only those of proposed nodes are kept: they are made anew from one text of each,
    and no other text is moved."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column("text").cast(pa.binary()), []
            for t in texts:
                h = shingle_set(t.as_py(), width)
                out.append((*wide_fingerprint(h), _node(h)))
            bits, minima, nodes = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), b.column("key"), pa.array(bits, pa.binary()), pa.array(minima, pa.list_(pa.int64())), pa.array(nodes, pa.int64())], [f.name for f in schema])

    def remade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at, held, sets = b.column("text").cast(pa.binary()), 0, 0, []
            for i in range(b.num_rows):
                sets.append(shingle_set(texts[i].as_py(), width))
                held += sets[-1].nbytes
                if held >= SET_BYTES or i + 1 == b.num_rows:  # results in batches of bounded bytes
                    own = pa.array([_node(h) for h in sets], pa.int64())
                    out = pa.RecordBatch.from_arrays([b.column("node")[at : i + 1], b.column("root")[at : i + 1], pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "root", "shingles"])
                    yield out.filter(pc.equal(own, out.column("node")))
                    at, held, sets = i + 1, 0, []

    long = T.LongType()
    schema = T.StructType([field(docs, id_col, "id"), T.StructField("text_hash", long), T.StructField("key", long), T.StructField("bits", T.BinaryType()), T.StructField("minima", T.ArrayType(long)), T.StructField("node", long)])
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"), F.xxhash64(id_col, text_col).alias("key"))
    prints = written(slim.mapInArrow(made, schema), "wide-prints")
    nodes = prints.groupBy("node").agg(F.min("bits").alias("bits"), F.min("minima").alias("minima"), F.min("key").alias("key"))
    nodes = written(nodes, "wide-nodes")
    visits = nodes.select("node", "bits", F.posexplode("minima").alias("order", "least")).select("node", "bits", F.lit(0).alias("pos"), F.xxhash64("order", "least").alias("tile"))
    visits = written(visits, "visits")
    sizes = visits.groupBy("tile").count()
    visits = visits.join(sizes.where("count > 1").select("tile"), "tile", "left_semi")
    full = sizes.where(F.col("count") > chunk_rows).select("tile", F.ceil(F.col("count") / chunk_rows).cast("int").alias("chunks"))
    proposed = components(compared(visits, full, radius))
    few = written(nodes.select("node", "key").join(proposed, "node").select("key", "node", "root"), "proposed")
    maybe, _ = sieved(slim.select("key", "text"), F.col("key"), few.select("key"))
    texts = maybe.groupBy("key").agg(F.min("text").alias("text")).join(few, "key").select("node", "root", "text")
    sets = written(texts.mapInArrow(remade, "node long, root long, shingles binary"), "sets")
    roots = components(verified(sets, set_rows=set_rows, set_bytes=set_bytes)).withColumnRenamed("node", "linked")
    return prints.join(roots, F.col("node") == F.col("linked"), "left").select("id", "text_hash", F.coalesce("root", "node").alias("group"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, of which one stays in each group of `similar_groups`: the one of smallest id, then
    text hash. Null ids come after all others. Of rows equal in id and text one stays. An empty table stays empty."""
    found = written(similar_groups(docs, id_col=id_col, text_col=text_col, **options), "groups")
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    stay = found.groupBy("group").agg(F.min(key).alias("k")).select(F.col("k.id").alias("id"), F.col("k.text_hash").alias("text_hash"))
    same = found.groupBy("id", "text_hash").agg(F.count("*").alias("copies"))
    on = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))
    gone = same.alias("s").join(stay.alias("k"), on("s", "k"), "left_anti").select(F.col("id").alias("__gone_id"), F.col("text_hash").alias("__gone_hash"))
    gone = written(gone, "gone")
    maybe, rest = sieved(docs, F.xxhash64(F.col(id_col), F.xxhash64(text_col)), gone.select(F.xxhash64("__gone_id", "__gone_hash").alias("key")))
    rows = maybe.join(gone, maybe[id_col].eqNullSafe(gone["__gone_id"]) & (F.xxhash64(maybe[text_col]) == gone["__gone_hash"]), "left_anti").unionByName(rest)
    # rows that stay and are equal in id and text: seldom any
    again = same.alias("s").where("copies > 1").join(stay.alias("k"), on("s", "k"), "left_semi").select(F.col("id").alias("__again_id"), F.col("text_hash").alias("__again_hash"))
    again = written(again, "again")
    if again.isEmpty():
        return rows
    match = rows[id_col].eqNullSafe(again["__again_id"]) & (F.xxhash64(rows[text_col]) == again["__again_hash"])
    more = rows.join(again, match).dropDuplicates(["__again_id", "__again_hash"]).select(docs.columns)
    return rows.join(again, match, "left_anti").unionByName(more)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")

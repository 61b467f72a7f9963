"""Near-duplicate detection by BagMinHash signatures, banding and exact verification of multiset overlap.

A text is a bag of word shingles whose weights are their multiplicities. Each
(shingle, weight octave) owns a Poisson process in time; the octaves cover the
discretised weights hierarchically, each twice as wide as the one before, with
a rate equal to its width, and every point carries a weight level and a
register. A text takes the points below its own weights, and a register's first
point agrees between two texts with probability equal to their weighted
Jaccard similarity. Points beyond a text's last needed time are not made.

Texts that share a band share its leader. The texts of a leader are compared
exactly by one product of shingle incidence matrices, and only a spanning forest
of the links leaves a task. A large group is first compared with its leader
alone; only texts that are not near to it go on to be compared with the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsloom.functions.spread import spread_join
from oddsloom.llm import text as T
from oddsloom.llm.common import one_row_each
from oddsloom.session import durable

#: Least neighbours of so many links at most are broadcast; those of more are met by a join that spreads hot nodes.
BROADCAST_LINKS = 200_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPLIT = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class NearDupConfig:
    """Shingle length in words, least weighted Jaccard similarity, bands x rows of the signature.

    With 24 bands of 4 rows a pair at similarity 0.8 shares no band with
    probability 3e-6. ``block`` and ``block_shingles`` bound what one task
    compares at a time; larger groups are dealt to several blocks.
    """

    shingle: int = 5
    threshold: float = 0.8
    bands: int = 24
    rows: int = 4
    block: int = 2048
    block_shingles: int = 3_000_000


def bags(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight, offsets): the bag of each whole lower-cased text, its shingles in ascending order."""
    data, at = T.utf8(texts, lower=True)
    words = T.Words(data, at)
    h, text = T.shingles(words, n, len(texts))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(first)
    weight = np.diff(np.append(start, len(h)))
    return h[start], weight, T.per_text(text[start], len(texts))


def _uniform(h: np.ndarray) -> np.ndarray:
    """(0, 1] from the upper 53 bits."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def bag_minhash(shingle: np.ndarray, weight: np.ndarray, at: np.ndarray, registers: int) -> np.ndarray:
    """(texts, registers) first point times; a text without shingles keeps infinity. Equal times are equal points."""
    texts = len(at) - 1
    owner = np.repeat(np.arange(texts), np.diff(at))
    mass = np.bincount(owner, weights=weight, minlength=texts)
    out = np.full((texts, registers), np.inf)
    # One entry for each octave that a weight reaches into: (0, 1], (1, 2], (2, 4], (4, 8], ...
    octave = np.zeros(len(weight), np.int64)
    parts = [(shingle, owner, weight, octave)]
    low = 1
    while (above := weight > low).any():
        k = parts[-1][3][0] + 1 if len(parts[-1][3]) else 1
        parts.append((shingle[above], owner[above], weight[above], np.full(int(above.sum()), k)))
        low *= 2
    h, owner, weight, octave = (np.concatenate(x) for x in zip(*parts, strict=True))
    base = np.where(octave > 0, 2.0 ** (octave - 1), 0.0)
    width = np.where(octave > 0, 2.0 ** (octave - 1), 1.0)
    seed = T.mix(h + octave.astype(np.uint64) * _SPLIT)
    until = registers * (np.log(registers) + 4.0) / np.maximum(mass, 1.0)
    todo = mass > 0
    while todo.any():
        live = np.flatnonzero(todo[owner])
        time, k = np.zeros(len(live)), 0
        while len(live):
            k += 1
            draw = T.mix(seed[live] + np.uint64(k * int(_STEP) % 2**64))
            time = time - np.log(_uniform(draw)) / width[live]
            keep = time <= until[owner[live]]
            live, time, draw = live[keep], time[keep], draw[keep]
            draw = T.mix(draw ^ _SPLIT)
            level = base[live] + (draw >> np.uint64(32)).astype(np.float64) * 2.0**-32 * width[live]
            taken = level < weight[live]
            register = ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(out.reshape(-1), owner[live[taken]] * registers + register[taken], time[taken])
        todo &= np.isinf(out).any(axis=1)
        out[todo] = np.inf
        until[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """(texts, bands) hashes of each band's registers, different between bands."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, -1)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _SPLIT, (len(signature), 1))
    for i in range(bits.shape[2]):
        key = T.mix(key * _STEP + bits[:, :, i])
    return key


def _sign(batches: Iterator[pa.RecordBatch], config: NearDupConfig) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in T.pieces(batch, "text"):
            shingle, weight, at = bags(part.column("text"), config.shingle)
            signature = bag_minhash(shingle, weight, at, config.bands * config.rows)
            keys = band_keys(signature, config.bands)
            has = np.diff(at) > 0
            both = np.stack([shingle, weight.astype(np.uint64)], 1)
            digest = [hashlib.blake2b(both[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
            ends = np.concatenate([[0], np.cumsum(has * config.bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[has].reshape(-1).view(np.int64)))
            total = np.concatenate([[0], np.cumsum(weight)])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(digest, pa.binary()), pa.array((total[at[1:]] - total[at[:-1]]).astype(np.int64)), lists],
                ["doc_id", "digest", "shingles", "bands"],
            )


def signatures(docs: DataFrame, config: NearDupConfig, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, digest of the bag, shingles, bands) of every row, over whole texts; a text without words has no bands."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _sign(b, config), f"doc_id {kind}, digest binary, shingles long, bands array<long>")


def overlap(shingle: np.ndarray, weight: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x texts multiset overlaps, bag sizes), exactly.

    The n-th copy of a shingle is an element of its own, so the overlap of bags
    is one of sets; elements of a single text are left out of the product.
    """
    texts = len(at) - 1
    owner = np.repeat(np.arange(texts), np.diff(at))
    size = np.bincount(owner, weights=weight, minlength=texts)
    copy = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    element = T.mix(np.repeat(shingle, weight) + copy.astype(np.uint64) * _SPLIT)
    owner = np.repeat(owner, weight)
    _, column, seen = np.unique(element, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    column, owner = column[shared], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    column = np.cumsum(np.concatenate([[0], np.diff(column) > 0])) if len(column) else column
    common = np.zeros((texts, texts), np.float32)
    n, step = int(column[-1]) + 1 if len(column) else 0, 2048
    for a in range(0, n, step):
        i, j = np.searchsorted(column, [a, a + step])
        dense = np.zeros((texts, min(step, n - a)), np.float32)
        dense[owner[i:j], column[i:j] - a] = 1
        common += dense @ dense.T
    return common, size


def forest(linked: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) names of the components of a symmetric boolean matrix; the root has the smallest name."""
    order = np.argsort(name, kind="stable")
    linked = linked[np.ix_(order, order)]
    label = np.arange(len(name))
    while True:
        reach = np.where(linked, label[None, :], len(name)).min(axis=1)
        new = np.minimum(label, reach)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(name))
    return name[order][moved], name[order][label[moved]]


def _compare(table: pa.Table, config: NearDupConfig) -> pa.Table:
    """Spanning links among the texts of one group or pair of blocks."""
    table = table.sort_by("rep")
    name = table["rep"].to_numpy()
    shingle, weight, at = bags(pa.concat_arrays(table["text"].chunks), config.shingle)
    common, size = overlap(shingle, weight, at)
    union = size[:, None] + size[None, :] - common
    member, root = forest(common >= config.threshold * union - 1e-6, name)
    return pa.table({"a": pa.array(member, pa.int64()), "b": pa.array(root, pa.int64())})


def _near_leader(table: pa.Table, config: NearDupConfig) -> pa.Table:
    """(leader, rep, shingles, near) of the texts of one block: whether each reaches the threshold with the leader."""
    table = table.sort_by("rep")
    name, leader = table["rep"].to_numpy(), table["leader"][0].as_py()
    shingle, weight, at = bags(pa.concat_arrays(table["text"].chunks), config.shingle)
    owner = np.repeat(np.arange(len(name)), np.diff(at))
    first = int(np.searchsorted(name, leader))
    own, times = shingle[at[first] : at[first + 1]], weight[at[first] : at[first + 1]]
    place = np.minimum(np.searchsorted(own, shingle), len(own) - 1)
    common = np.bincount(owner, weights=np.where(own[place] == shingle, np.minimum(weight, times[place]), 0), minlength=len(name))
    size = np.bincount(owner, weights=weight, minlength=len(name))
    near = common >= config.threshold * (size + size[first] - common) - 1e-6
    rest = name != leader
    return pa.table({"leader": table["leader"].filter(rest), "rep": table["rep"].filter(rest), "shingles": table["shingles"].filter(rest), "near": pa.array(near[rest])})


def _blocks(n: Column, mass: Column, config: NearDupConfig) -> Column:
    return F.greatest(F.ceil(n / config.block), F.ceil(mass / config.block_shingles), F.lit(1)).cast("int")


def _rest_of_large_groups(near: DataFrame, texts: DataFrame, config: NearDupConfig) -> DataFrame:
    """Links of the texts that are not near to their leader, with one another and with those that are.

    Both kinds are dealt to blocks; every block of the former meets every other
    block. Two texts near to the leader are linked through it already.
    """
    of = lambda c, flag: F.sum(F.when(F.col("near") == F.lit(flag), F.col(c)).otherwise(0))
    sizes = near.withColumn("one", F.lit(1)).groupBy("leader").agg(of("one", False).alias("n"), of("shingles", False).alias("mass"), of("one", True).alias("m"), of("shingles", True).alias("near_mass"))
    sizes = sizes.where("n > 0").select("leader", _blocks(F.col("n"), F.col("mass"), config).alias("far_blocks"), _blocks(F.col("m"), F.col("near_mass"), config).alias("near_blocks"))
    rows = spread_join(near, sizes, ["leader"], "rep")
    far, last = F.sequence(F.lit(0), F.col("far_blocks") - 1), F.col("far_blocks") + F.col("near_blocks") - 1
    hashed = F.xxhash64("rep")
    own = F.when(F.col("near"), F.col("far_blocks") + F.pmod(hashed, F.col("near_blocks"))).otherwise(F.pmod(hashed, F.col("far_blocks"))).cast("int")
    rows = rows.withColumn("own", own)
    # A block of texts that are not near meets itself in each of its tasks, as there is a block of the other kind, if an empty one.
    others = F.when(F.col("near"), far).otherwise(F.filter(F.sequence(F.lit(0), last), lambda x: x != F.col("own")))
    tasks = rows.select("leader", "rep", "own", F.explode(others).alias("other")).select("leader", "rep", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return tasks.join(texts, "rep").groupBy("leader", "i", "j").applyInArrow(lambda t: _compare(t, config), "a long, b long")


def linked_pairs(docs: DataFrame, reps: DataFrame, config: NearDupConfig, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(a, b) links that span every component of the pairs which share a band and reach the threshold.

    ``reps`` has (rep, shingles, bands), one row for each different bag; ``docs``
    has one row for each id and text. Two texts that share a band share its
    leader, the least id there, so the groups by leader hold all pairs; a text
    is sent once for each different leader. In a group of several blocks, texts
    are compared with the leader alone, and only those that are not near to it
    with the whole group.
    """
    rows = reps.select("rep", "shingles", F.explode("bands").alias("key"))
    leaders = rows.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    follow = durable(spread_join(rows, leaders, ["key"], "rep").select("leader", "rep", "shingles").distinct())
    sizes = follow.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("mass"))
    grouped = durable(spread_join(follow, sizes.select("leader", _blocks(F.col("n"), F.col("mass"), config).alias("blocks")), ["leader"], "rep"))
    texts = docs.select(F.col(id_col).alias("rep"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small = grouped.where("blocks = 1").select("leader", "rep").join(texts, "rep")
    links = small.groupBy("leader").applyInArrow(lambda t: _compare(t, config), "a long, b long")
    large = grouped.where("blocks > 1")
    if large.isEmpty():
        return links
    # The leader goes to every block of its group.
    block = F.when(F.col("rep") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    met = large.select("leader", "rep", "shingles", F.explode(block).alias("block")).join(texts, "rep")
    near = durable(met.groupBy("leader", "block").applyInArrow(lambda t: _near_leader(t, config), "leader long, rep long, shingles long, near boolean"))
    found = near.where("near").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    return links.unionByName(found).unionByName(_rest_of_large_groups(near, texts, config))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): the least node of its component.

    Alternating large-star and small-star rounds; each is a grouped minimum and
    a join, with its links checkpointed, until a round changes nothing. A round
    makes at most two links of one, so a count of the links bounds both joins.
    """

    def star(pairs: DataFrame, n: int) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(F.broadcast(least), "u") if n <= BROADCAST_LINKS else spread_join(pairs, least, ["u"], "v")

    links = durable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        now = links.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if (now["n"], now["x"]) == mark or not now["n"]:
            break
        mark = (now["n"], now["x"])
        both = links.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
        large = star(both, now["n"]).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = star(large.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), now["n"])
        small = small.select(F.inline(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))))
        links = durable(small.where("a <> b").distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_classes(docs: DataFrame, config: NearDupConfig | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, kept): the class of every row, named by its least id, which is the one kept.

    Classes are the components of the links at the threshold or above. Words are
    lower-cased runs without white space. Texts with the same bag are one class
    without being compared, as are all texts without words (null, empty, white
    space). A text of fewer words than a shingle has one shingle of all of
    them. Ids are whole numbers that identify a document: rows that repeat an id
    share a class. A null id takes the class of its bag and is never kept
    unless its class has no other.
    """
    config = config or NearDupConfig()
    signed = durable(signatures(docs, config, text_col, id_col))
    reps = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands"))
    reps = durable(reps)
    if not signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.select(id_col, text_col).distinct()
    roots = components(linked_pairs(docs, reps.where("rep is not null"), config, text_col, id_col))
    named = reps.select("digest", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("root", "rep").alias("class_id"))
    rows = spread_join(signed.select("doc_id", "digest"), named, ["digest"], "doc_id")
    return rows.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, config: NearDupConfig | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class, that of the least id, all columns kept.

    Rows that repeat the id that stays are copies too, and the first of them by
    its JSON text stays. Rows with a null id stay, as they have no key to be
    found by. Null, empty and wordless texts are one class; an empty table gives
    an empty result. Columns of any other name may be there.
    """
    classes = durable(near_classes(docs, config, text_col, id_col).where("doc_id is not null"))
    lost = classes.where("not kept").select(F.col("doc_id").alias("__lost")).distinct()
    left = docs.join(lost, docs[id_col] == F.col("__lost"), "left_anti")
    again = classes.where("kept").groupBy(F.col("doc_id").alias("__again")).count().where("count > 1").select("__again")
    if again.isEmpty():
        return left
    once = left.join(again, left[id_col] == F.col("__again"), "left_anti")
    return once.unionByName(one_row_each(left.join(again, left[id_col] == F.col("__again"), "left_semi"), [id_col]))

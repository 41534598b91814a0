"""Near duplicates by ProbMinHash, banding and verification.

A document is the set of its five-word shingles. Each shingle is a Poisson
process whose rate is its weight: its arrivals hit registers at random, a
register keeps the shingle that came first, and a shingle stops when its next
arrival is later than every register's first. Two documents agree in a register
with the probability Jaccard of their weighted sets. Every shingle weighs the
same here, however often it occurs: that Jaccard is then the one of the plain
sets, by which links are decided. Bands of registers make buckets; pairs from
buckets are verified on the whole texts.

A bucket never emits all its pairs. Texts equal up to case and white space are
one node. In each round a few nodes of a bucket, its hubs, are compared with the
bucket's nodes of other classes; linked nodes become one class, and a hub that
has met all others leaves the bucket. The first hubs are the most central nodes,
to which a group of copies links at once; later ones come from outside the
bucket's largest class, in growing numbers, so that what remains apart is settled
in few rounds. Two texts cannot share the shingles that either has alone among
all nodes, which bounds their overlap and leaves the comparison of many pairs
out. The bound is taken inside and outside a pivot, a hub that both have met: two
texts share at most what either has of the pivot and, beside it, what either has
in common with others. It ends when no bucket holds two classes: then every pair
of a bucket is of one class, or has been compared, or is below the threshold by
that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.bpe import chunks_of
from peakloom.llm.shared import SPACE_CLASS, id_key, one_row_each, text_of, text_rows
from peakloom.storage import removed, written

#: Words of a shingle.
SHINGLE = 5
#: Bits of a shingle's hash; the document's number in a batch stands above them.
BITS = 44
#: Bytes of text worked on at once; a task's memory is some 60 times that, or a longer text's.
CHUNK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    up, down = (np.multiply.accumulate(np.full(max(n, CHUNK), b, np.uint64)) for b in (_P, pow(_P, -1, 1 << 64)))
    if n <= CHUNK:  # those of a longer text go with it
        _powers[:] = up, down
    return up, down


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document << BITS | hash) of each different shingle, sorted, and how often it occurs.

    A document with fewer words than a shingle has them all as its one shingle; one without words has none.
    """
    n, docs = len(data), len(offsets) - 1
    space = _SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    ink = ~space
    starts = np.flatnonzero(ink & (np.append(True, space[:-1]) | first[:n])) if n else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = _power(n)
    with np.errstate(over="ignore"):
        word = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[:n] * ink, starts) * inverse[starts]
        word = _mix(word)
        upto = np.searchsorted(starts, offsets)
        count = np.diff(upto)
        of = np.repeat(np.arange(docs), count)
        place = np.arange(len(word)) - upto[:-1][of]
        whole = np.flatnonzero(place + width <= count[of])
        h = np.zeros(len(whole), np.uint64)
        for k in range(width):
            h = h * np.uint64(_P) + word[whole + k]
        owner = of[whole]
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            g = np.zeros(len(short), np.uint64)
            for k in range(width - 1):
                at = np.minimum(upto[short] + k, len(word) - 1)
                g = np.where(k < count[short], g * np.uint64(_P) + word[at], g)
            h, owner = np.concatenate((h, g + np.uint64(1))), np.concatenate((owner, short))
        keys = (owner.astype(np.uint64) << np.uint64(BITS)) | (_mix(h) >> np.uint64(64 - BITS))
    keys.sort()
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[new], np.diff(np.append(new, len(keys)))


def signatures(keys: np.ndarray, weights: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """ProbMinHash registers (document x register); 0 in documents without shingles."""
    reg_time, reg_key = np.full(docs * registers, np.inf), np.zeros(docs * registers, np.uint64)
    doc, h = (keys >> np.uint64(BITS)).astype(np.int64), keys & np.uint64((1 << BITS) - 1)
    time = np.zeros(len(keys))
    arrival = 0
    while len(h):
        arrival += 1
        with np.errstate(over="ignore"):
            x = _mix(h + np.uint64(arrival) * np.uint64(_P))
            slot = doc * registers + (_mix(x) >> np.uint64(33)).astype(np.int64) % registers
        time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weights
        np.minimum.at(reg_time, slot, time)
        won = time == reg_time[slot]
        reg_key[slot[won]] = h[won]
        last = reg_time.reshape(docs, registers).max(axis=1)
        on = time < last[doc]
        doc, h, time, weights = doc[on], h[on], time[on], weights[on]
    return reg_key.reshape(docs, registers)


def band_hashes(registers: np.ndarray, bands: int) -> np.ndarray:
    """One hash for each document and band, with the band's number in it."""
    docs, m = registers.shape
    part = registers.reshape(docs, bands, m // bands)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (docs, bands)) * np.uint64(_P)
        for k in range(part.shape[2]):
            h = _mix(h * np.uint64(3) + part[:, :, k])
    return h.view(np.int64)


def node_of(text: Column) -> Column:
    """The key that texts equal up to case and white space share."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(F.lower(text), SPACE_CLASS + "+", " ")).cast("binary")))


def sketch(docs: DataFrame, text_col: str = "text", bands: int = 24, rows: int = 5) -> DataFrame:
    """Per row: node, size (different shingles), bands (array of bucket keys, null without a word). Each shingle weighs 1, as in the comparison of whole texts."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks_of(batch.column(1), CHUNK):
                keys, _ = shingles(data, offsets)
                regs = signatures(keys, np.ones(len(keys)), j - i, bands * rows)
                size = np.bincount((keys >> np.uint64(BITS)).astype(np.int64), minlength=j - i)
                flat = pa.array(band_hashes(regs, bands).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), flat, mask=pa.array(size == 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size.astype(np.int64)), lists], ["node", "size", "bands"])

    text = text_of(F.col(text_col))
    return text_rows(docs).select(node_of(text).alias("node"), F.lower(text).alias("text")).mapInArrow(made, "node binary, size long, bands array<long>")


def overlaps(hubs: np.ndarray, nodes: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair: shingles of the hub, of the node, of both. Shingles of pair k are under document k on both sides."""
    hit = np.zeros(len(nodes), bool)
    if len(hubs):
        hit = hubs[np.minimum(np.searchsorted(hubs, nodes), len(hubs) - 1)] == nodes
    count = lambda keys: np.bincount((keys >> np.uint64(BITS)).astype(np.int64), minlength=pairs)
    return count(hubs), count(nodes), count(nodes[hit])


def _compared(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (hub, node) with both, the shingles that their whole texts share, and linked, whether they reach the threshold."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_numpy().astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CHUNK, "right")))
                some = batch.slice(lo, hi - lo)
                sides = []
                for c in (2, 3):
                    _, _, data, offsets = next(chunks_of(some.column(c), 1 << 62))
                    sides.append(shingles(data, offsets)[0])
                s_hub, s_node, both = overlaps(sides[0], sides[1], hi - lo)
                linked = both >= threshold * (s_hub + s_node - both)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(both), pa.array(linked)], ["hub", "node", "both", "linked"])
                lo = hi

    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in ("hub", "node"))
    joined = pairs.join(left, "hub").join(right, "node").select("hub", "node", "text_hub", "text_node")
    return joined.mapInArrow(checked, "hub binary, node binary, both long, linked boolean")


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after joining the classes that links (a, b: nodes) connect.

    Every label with a link to a smaller one hooks to the smallest such; chains of hooks are halved until they are
    flat; links inside a class go. The rounds are logarithmic in the longest chain, also where a class is a path.
    """
    while True:
        a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b"))
        open_ = links.join(a, "a").join(b, "b").where("label_a <> label_b")
        hooks = written(
            open_.groupBy(F.greatest("label_a", "label_b").alias("label")).agg(F.min(F.least("label_a", "label_b")).alias("to")), "hooks"
        )
        if hooks.isEmpty():
            return labels
        while True:
            next_ = hooks.select(F.col("label").alias("to"), F.col("to").alias("further"))
            far = hooks.join(next_, "to", "left")
            if far.where("further is not null").isEmpty():
                break
            flat = written(far.select("label", F.coalesce("further", "to").alias("to")), "hooks")
            removed(hooks)
            hooks = flat
        new = written(labels.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        removed(hooks)
        labels = new


def _shared_sizes(texts: DataFrame) -> DataFrame:
    """node, alone: how many of a node's different shingles no other node of texts has."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks_of(batch.column(1), CHUNK):
                keys, _ = shingles(data, offsets)
                ends = np.searchsorted(keys, np.arange(j - i + 1, dtype=np.uint64) << np.uint64(BITS)).astype(np.int32)
                values = pa.array((keys & np.uint64((1 << BITS) - 1)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), values)], ["node", "elements"])

    sets = texts.select("node", "text").mapInArrow(listed, "node binary, elements array<long>")
    rows = sets.select(F.xxhash64("node").alias("key"), F.explode("elements").alias("element"))
    by_element = rows.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    alone = by_element.where("n = 1").groupBy("key").agg(F.count(F.lit(1)).alias("alone"))
    return texts.select("node", F.xxhash64("node").alias("key")).join(alone, "key", "left").select("node", F.coalesce("alone", F.lit(0)).alias("alone"))


def _hubs(open_: DataFrame, turn: int) -> DataFrame:
    """bucket, hub, and its label, size, shared, bands, pivot and inside, of this turn's hubs: one for each slot of a bucket that has nodes to offer.

    The first two turns take the most central nodes, 1 and then 4 of a bucket. From the third on, hubs come from
    outside the bucket's largest class, up to 16, 128, 1024 and so on. Slots are dealt by hash and their hub is a
    maximum, so a bucket of any size is reduced where its rows are.
    """
    slots = 4**turn if turn < 2 else 16 * 8 ** (turn - 2)
    offered = open_
    if turn >= 2:
        sizes = open_.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label"))["label"].alias("largest"))
        offered = open_.join(largest, "bucket").where("label <> largest")
    slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(slots))
    best = offered.groupBy("bucket", slot.alias("slot")).agg(F.max(F.struct("centre", "node", "label", "size", "shared", "bands", "pivot", "inside")).alias("h"))
    of = {"hub": "node", "l_hub": "label", "s_hub": "size", "c_hub": "shared", "b_hub": "bands", "p_hub": "pivot", "i_hub": "inside"}
    return best.select("bucket", *[F.col(f"h.{v}").alias(k) for k, v in of.items()])


def near_classes(docs: DataFrame, text_col: str = "text", threshold: float = 0.8, bands: int = 24, rows: int = 5) -> DataFrame:
    """node, label of the nodes that share a bucket with another; other nodes are classes of their own."""
    sketches = sketch(docs, text_col, bands, rows).groupBy("node").agg(F.max("size").alias("size"), F.max("bands").alias("bands"))
    sketches = written(sketches, "sketches")
    spread = sketches.select("node", F.explode("bands").alias("bucket"))
    counts = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(spread.join(counts, "bucket"), "members")
    text = text_of(F.col(text_col))
    texts = docs.select(node_of(text).alias("node"), F.lower(text).alias("text"))
    nodes = written(members.groupBy("node").agg(F.sum("n").alias("centre"), F.collect_list("bucket").alias("bands")), "nodes")  # at most `bands` each
    texts = written(texts.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    labels = written(nodes.select("node", F.col("node").alias("label")), "labels")
    alone = written(_shared_sizes(texts), "alone")
    measured = nodes.join(alone, "node").join(sketches.select("node", "size"), "node").withColumn("shared", F.col("size") - F.col("alone"))
    measured = measured.where(F.col("shared") >= threshold * F.col("size") - 1e-6)
    measured = measured.withColumns({"pivot": F.lit(None).cast("binary"), "inside": F.lit(None).cast("long")})
    columns = ["bucket", "node", "centre", "size", "shared", "bands", "pivot", "inside"]
    alive = written(members.select("bucket", "node").join(measured, "node").select(columns), "alive")
    for made in (members, sketches, nodes, alone):
        removed(made)
    turn = 0
    while True:
        open_ = alive.join(labels, "node")
        several = open_.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
        open_ = written(open_.join(several, "bucket", "left_semi").select(*columns, "label"), "open")
        removed(alive)
        if open_.isEmpty():
            removed(open_)
            break
        hubs = written(_hubs(open_, turn), "hubs")
        beside = F.least("inside", "i_hub") + F.least(F.col("shared") - F.col("inside"), F.col("c_hub") - F.col("i_hub"))
        most = F.when(F.col("pivot") == F.col("p_hub"), beside).otherwise(F.least("shared", "c_hub"))
        possible = (1 + threshold) * most >= threshold * (F.col("size") + F.col("s_hub")) - 1e-6
        once = F.array_min(F.array_intersect("bands", "b_hub")) == F.col("bucket")  # of a pair's buckets one compares it
        marked = open_.join(hubs.select("bucket", F.col("hub").alias("node"), F.lit(True).alias("is_hub")), ["bucket", "node"], "left")
        marked = written(marked.withColumn("is_hub", F.coalesce("is_hub", F.lit(False))), "marked")
        removed(open_)
        one_way = ~F.col("is_hub") | (F.col("hub") < F.col("node"))  # two hubs meet once
        stars = marked.join(hubs, "bucket").where((F.col("label") != F.col("l_hub")) & one_way & possible & once)
        pairs = stars.select("hub", "node").distinct()
        links = written(_compared(pairs, texts, threshold), "links")
        labels = merged_labels(labels, links.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b")))
        rest = marked.where("not is_hub")
        if turn == 0:  # the nearest of the first hubs becomes the pivot
            pivots = links.groupBy("node").agg(F.max(F.struct("both", "hub")).alias("p")).select("node", F.col("p.hub").alias("pivot"), F.col("p.both").alias("inside"))
            rest = rest.drop("pivot", "inside").join(pivots, "node", "left")
        alive = written(rest.select(columns), "alive")
        for made in (marked, hubs, links):
            removed(made)
        turn += 1
    removed(texts)
    return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 24, rows: int = 5
) -> DataFrame:
    """One row per row of docs: id, class_id, class_size, kept.

    A class is a set of documents connected by links of Jaccard >= threshold between their sets of five-word
    shingles (words part at white space, case does not count), class_id its smallest id, and kept true for that
    id. Texts equal up to case and white space are one node, among them all null, empty and blank texts. Null ids
    have classes as others do; a class of null ids alone has a null class_id and keeps them. Repeated rows share
    a class. A pair at the threshold meets in no bucket once in 10,000 times at 24 bands of 5.
    """
    labels = near_classes(docs, text_col, threshold, bands, rows)
    members = docs.select(F.col(id_col).alias("id"), node_of(text_of(F.col(text_col))).alias("node"))
    nodes = members.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    nodes = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = nodes.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    of_node = written(nodes.select("node", "label").join(classes, "label").select("node", "class_id", "class_size"), "classes")
    return members.join(of_node, "node").select(
        F.col("id").alias(id_col), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class, one of those with its smallest id; columns and values as they were."""
    labels = near_classes(docs, text_col, **options)
    node = node_of(text_of(F.col(text_col)))
    members = docs.select(F.col(id_col).alias("id"), node.alias("node"))
    nodes = members.groupBy("node").agg(F.min("id").alias("id")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = nodes.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("best"))
    winners = written(best.select(id_key(F.col("best.id")).alias("__id"), F.col("best.node").alias("__node")), "near-winners")
    return one_row_each(docs, {"__id": id_key(F.col(id_col)), "__node": node}, winners)

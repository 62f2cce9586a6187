"""Near-duplicate documents by SimHash fingerprints and Golay-code fuzzy keys.

``fingerprint_classes`` links documents whose 64-bit fingerprints differ in few bits.
``near_copies`` links documents whose sets of word shingles are similar: wider fingerprints are cut
into Golay segments, each segment's keys are made selective by a least shingle hash, and the
candidates are verified on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowguard.llm import arrays, golay, hamming, xxh64
from windowguard.llm.components import components
from windowguard.session import stage

SHINGLE_WORDS = 3
#: First bit and width of the segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))

COPY_WORDS = 5
COPY_SIMILARITY = 0.8
LANES = 4
COPY_SEGMENTS = tuple((lane, first) for lane in range(LANES) for first in (0, 32))

SPREAD = np.array([sum((i >> b & 1) << (8 * b) for b in range(8)) for i in range(256)], np.uint64)


def joined_words(column: pa.Array):
    """Lower-cased (A-Z) words of each value joined by one space: bytes, starts, ends, first word."""
    data, offsets = arrays.text_bytes(column)
    starts, ends, first = arrays.spans(data, offsets, ~arrays.WHITE)
    length = ends - starts
    new_starts = np.cumsum(length + 1) - (length + 1)
    new_ends = new_starts + length
    out = np.full(int(length.sum()) + len(length), 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[new_ends] = False
    out[inside] = arrays.LOWER[data[~arrays.WHITE[data]]]
    return out, new_starts, new_ends, first


def shingle_hashes(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every k-word shingle, repeats included, and the first shingle of each value.

    A value of fewer words is one shingle, one without words has none.
    """
    data, starts, ends, first = joined_words(column)
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_first = np.concatenate(([0], np.cumsum(n)))
    value = np.repeat(np.arange(len(n)), n)
    at = first[:-1][value] + np.arange(len(value)) - out_first[:-1][value]
    last = at + np.minimum(k, count[value]) - 1
    return xxh64.hashes(data, starts[at], ends[last]), out_first


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each value the bits set in over half of its hashes; zero without any.

    Eight counters of eight bits are summed at a time, over stretches of at most 255 hashes.
    """
    count = np.diff(first)
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    n = -(-count[some] // 255)
    owner = np.repeat(np.arange(len(some)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    cuts = first[:-1][some][owner] + nth * 255
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    bytes_ = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        part = np.add.reduceat(SPREAD[bytes_[:, byte]], cuts)
        counters = part.view(np.uint8).reshape(-1, 8).astype(np.int64)
        totals = np.add.reduceat(counters, begin, axis=0)
        bits = (2 * totals > count[some][:, None]).astype(np.uint64)
        out[some] |= (bits << np.arange(8, dtype=np.uint64)).sum(1) << np.uint64(8 * byte)
    return out


def distinct_hashes(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each value, in order, and the first one of each value."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    by = np.lexsort((hashes, owner))
    hashes, owner = hashes[by], owner[by]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(first) - 1))))


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and the 64-bit fingerprint ``fp`` of its text (null: no words, fingerprint zero)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrays.pieces(batch, "text"):
                value = majority(*shingle_hashes(piece.column("text"), words))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(value.view(np.int64))], names=["doc_id", "fp"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(mark, f"doc_id {kind}, fp long")


def golay_keys(prints: DataFrame) -> DataFrame:
    """(key, fp) such that fingerprints at most two bits apart share a key.

    Two errors in three segments leave one segment exact, and the next one within two bits: the key
    is the exact segment with a Golay key of the next.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(i, 1 << 15) for i in range(0, batch.num_rows, 1 << 15)):
                fp = piece.column("fp").to_numpy().view(np.uint64)
                part = [(fp >> np.uint64(a)) & np.uint64((1 << n) - 1) for a, n in SEGMENTS]
                for s in range(len(SEGMENTS)):
                    row, near = golay.keys(part[(s + 1) % len(SEGMENTS)])
                    key = (np.uint64(s) << np.uint64(60)) | (part[s][row] << np.uint64(12)) | near.astype(np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(fp[row].view(np.int64))], names=["key", "fp"]
                    )

    return prints.select("fp").mapInArrow(emit, "key long, fp long")


def fingerprint_classes(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp and ``component_id``: the least doc_id reachable over fingerprint links.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and hashed in shingles; shorter
    texts are one shingle, texts without words (null, empty) have fingerprint zero and are linked
    like any other. Equal fingerprints are one node, so copies cost nothing. Rows with a null
    doc_id belong to their class, whose id is null only if all its ids are. Repeated rows come back
    repeated; no rows give no rows. Extra columns are left aside.
    """
    marked = stage(fingerprints(docs, words), "fingerprints")
    prints = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("own")), "prints")
    linked = components(hamming.links_within_two(golay_keys(prints)), "a", "b")
    roots = prints.join(linked, prints["fp"] == linked["node"], "left").select(
        "fp", "own", F.coalesce("root", "fp").alias("root")
    )
    roots = stage(roots, "roots")
    classes = roots.groupBy("root").agg(F.min("own").alias("component_id"))
    labels = stage(roots.join(classes, "root").select("fp", "component_id"), "labels")
    return marked.join(labels, "fp")


def hex64(value: Column | str) -> Column:
    """16 lowercase hex digits of a long."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


#: Candidates may differ in this many of the 256 fingerprint bits; a similarity of 0.8 means about
#: 39, and of pairs just above it one in a hundred differs in 51 or more.
COPY_BITS = 56
#: And in this many of the first 64, which the keys carry along: unrelated pairs hardly ever do.
FIRST_BITS = 20
#: Members of a bucket up to this size are compared pair by pair, those of a larger one with a few
#: in a first round, and after it by their shingles.
COPY_BUCKET, COPY_LEADS = 16, 3
#: Holders of one shingle are compared in blocks of about this many; every holder is sent to each block.
BLOCK = 4096
#: 64-bit words of a text's parity sketch, and texts whose sketches are made at a time.
SKETCH_WORDS, SKETCH_ROWS = 8, 4096


def parity_sketches(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text SKETCH_WORDS words in which every shingle has flipped one bit.

    Where two sketches differ in d bits, at least d shingles are in one text only: shingles in both
    cancel out, and every other one flips a single bit.
    """
    bits = 64 * SKETCH_WORDS
    place = (salted(hashes, LANES + len(COPY_SEGMENTS)) % np.uint64(bits)).astype(np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.zeros((len(first) - 1, SKETCH_WORDS), np.int64)
    for low in range(0, len(out), SKETCH_ROWS):
        high = min(low + SKETCH_ROWS, len(out))
        own = slice(first[low], first[high])
        flips = np.bincount((row[own] - low) * bits + place[own], minlength=(high - low) * bits) & 1
        out[low:high] = np.packbits(flips.astype(np.uint8), bitorder="little").view("<i8").reshape(-1, SKETCH_WORDS)
    return out


def may_be_similar(size: str, its_size: str, sketch: str, its_sketch: str, percent: int) -> Column:
    """False only where the sketches prove that two texts of these numbers of shingles are less similar."""
    unlike = sum(F.bit_count(F.get(sketch, F.lit(i)).bitwiseXOR(F.get(its_sketch, F.lit(i)))) for i in range(SKETCH_WORDS))
    return (100 + percent) * unlike <= (100 - percent) * (F.col(size) + F.col(its_size))


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, two hashes of its text (t1, t2), and what stands for the text.

    ``node`` is a 128-bit hash of the word sequence, ``prints`` four 64-bit SimHash fingerprints of
    the distinct shingles under different mixings, ``least`` the least shingle hash under eight others
    (empty without words), ``size`` the number of distinct shingles and ``sketch`` their parities.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrays.pieces(batch, "text"):
                hashes, first = distinct_hashes(*shingle_hashes(piece.column("text"), COPY_WORDS))
                count = np.diff(first)
                some = np.flatnonzero(count)
                prints = np.zeros((len(count), LANES), np.uint64)
                least = np.zeros((len(some), len(COPY_SEGMENTS)), np.uint64)
                for lane in range(LANES):
                    prints[:, lane] = majority(salted(hashes, lane), first)
                for s in range(len(COPY_SEGMENTS)):
                    if len(some):
                        least[:, s] = np.minimum.reduceat(salted(hashes, LANES + s), first[:-1][some])
                widths = np.zeros(len(count) + 1, np.int32)
                widths[1:][some] = len(COPY_SEGMENTS)
                columns = [
                    *(piece.column(c) for c in ("doc_id", "t1", "t2")),
                    pa.array(sequence_hashes(piece.column("text")), pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(count) + 1, dtype=np.int32) * LANES), pa.array(prints.view(np.int64).ravel())
                    ),
                    pa.ListArray.from_arrays(
                        pa.array(np.cumsum(widths, dtype=np.int32)), pa.array(least.view(np.int64).ravel())
                    ),
                    pa.array(count.astype(np.int32)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(count) + 1, dtype=np.int32) * SKETCH_WORDS), pa.array(parity_sketches(hashes, first).ravel())
                    ),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t1", "t2", "node", "prints", "least", "size", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, t1 long, t2 long, node binary, prints array<long>, least array<long>, size int, sketch array<long>"
    return docs.select("doc_id", *text_hashes(), "text").mapInArrow(mark, schema)


def text_hashes() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit("text")).alias("t2")]


def salted(hashes: np.ndarray, salt: int) -> np.ndarray:
    return arrays.mix(hashes ^ np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def sequence_hashes(column: pa.Array) -> list[bytes]:
    """A 128-bit hash of the lower-cased word sequence of each value."""
    data, starts, ends, first = joined_words(column)
    low = np.append(starts, len(data))[first[:-1]]
    high = np.where(np.diff(first) > 0, np.append(ends, 0)[np.maximum(first[1:], 1) - 1], low)
    lanes = [arrays.span_hashes(data, low, high, lane) for lane in range(2)]
    packed = np.stack(lanes, axis=1).astype(">u8").tobytes()
    return [packed[i : i + 16] for i in range(0, len(packed), 16)]


def copy_keys(nodes: DataFrame) -> DataFrame:
    """(key, mark): for each segment the Golay keys of its 23 bits, each with a least shingle hash.

    ``mark`` is a hash of the node that keeps the rows short, since most keys are held by one node only.

    Similar texts agree in a least shingle as often as they share shingles, which makes the short
    Golay keys selective; the keys in turn split the buckets of common shingles.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1 << 13) for i in range(0, batch.num_rows, 1 << 13)):
                prints = part.column("prints").flatten().to_numpy().view(np.uint64).reshape(-1, LANES)
                least = part.column("least").flatten().to_numpy().view(np.uint64).reshape(-1, len(COPY_SEGMENTS))
                for s, (lane, shift) in enumerate(COPY_SEGMENTS):
                    word = (prints[:, lane] >> np.uint64(shift)) & np.uint64((1 << golay.BITS) - 1)
                    row, near = golay.keys(word)
                    key = arrays.pair(least[row, s], (near << 4 | s).astype(np.uint64))
                    columns = [pa.array(key.view(np.int64)), part.column("mark").take(pa.array(row))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "mark"])

    usable = nodes.where(F.size("least") > 0).select("prints", "least", F.xxhash64("node").alias("mark"))
    return usable.mapInArrow(emit, "key long, mark long")


def copy_buckets(nodes: DataFrame) -> DataFrame:
    """(key, n, node, first, size, sketch): the nodes of every key that n > 1 nodes have.

    ``first`` is the first of the node's fingerprints; size and sketch are the node's. Nodes of one
    mark have each other's keys too, which adds candidates and takes none away.
    """
    # Counted and met where one shuffle has brought the rows of a key together: both sides read the same columns of it.
    keyed = copy_keys(nodes).repartition("key")
    sizes = keyed.groupBy("key").agg(F.count("mark").alias("n")).where("n > 1")
    buckets = stage(keyed.join(sizes.hint("merge"), "key"), "copy-sized")
    own = nodes.select(F.xxhash64("node").alias("mark"), "node", F.col("prints")[0].alias("first"), "size", "sketch")
    return stage(buckets.join(own, "mark").drop("mark"), "copy-buckets")


def candidate_copies(buckets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of nodes that share a key and are near in their fingerprints and sketches.

    In a small bucket every pair is taken. In a larger one every member is paired with the few that
    a hash of bucket and member puts first; ``crowded_links`` finds what these do not.
    """
    near = (hamming.apart("first", "other") <= FIRST_BITS) & may_be_similar("size", "its_size", "sketch", "its_sketch", percent)
    own = ["node", "first", "size", "sketch"]
    its = dict(zip(own, ["mate", "other", "its_size", "its_sketch"], strict=True))
    small = buckets.where(F.col("n") <= COPY_BUCKET).select("key", *own)
    twin = small.select("key", *[F.col(c).alias(n) for c, n in its.items()])
    within = small.join(twin, (small["key"] == twin["key"]) & (F.col("node") < F.col("mate")) & near)
    crowded = buckets.where(F.col("n") > COPY_BUCKET).select("key", *own)
    picks = [F.struct(F.xxhash64("key", "node", F.lit(i)).alias("dice"), *own) for i in range(COPY_LEADS)]
    leads = crowded.groupBy("key").agg(*[F.min(p).alias(f"lead{i}") for i, p in enumerate(picks)])
    ends = F.array(*[F.struct(*[F.col(f"lead{i}.{c}").alias(n) for c, n in its.items()]) for i in range(COPY_LEADS)])
    leads = stage(leads.select("key", F.inline(F.array_distinct(ends))), "leads")
    star = crowded.join(leads, (crowded["key"] == leads["key"]) & (F.col("node") != F.col("mate")) & near)
    ordered = [F.least("node", "mate").alias("a"), F.greatest("node", "mate").alias("b")]
    pairs = within.select(*ordered).unionByName(star.select(*ordered))
    prints = nodes.select("node", "prints")
    both = (
        pairs.distinct()
        .join(prints.select(F.col("node").alias("a"), F.col("prints").alias("x")), "a")
        .join(prints.select(F.col("node").alias("b"), F.col("prints").alias("y")), "b")
    )
    distance = sum(F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(LANES))
    return both.where(distance <= COPY_BITS).select("a", "b")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of each row's text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in arrays.pieces(batch, "text"):
                hashes, first = distinct_hashes(*shingle_hashes(piece.column("text"), COPY_WORDS))
                signed = hashes.view(np.int64)
                sets = [signed[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
                node = pa.array(sequence_hashes(piece.column("text")), pa.binary())
                yield pa.RecordBatch.from_arrays([node, pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.select("text").mapInArrow(emit, "node binary, shingles array<long>")


def sets_of(wanted: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``wanted``, one per node, with the node's ``shingles``; the texts are read again."""
    homes = stage(nodes.join(wanted, "node").select(*wanted.columns, F.col("doc_id").alias("owner")), "copy-homes")
    again = docs.join(homes.select("owner").distinct(), F.col("doc_id").eqNullSafe(F.col("owner")), "left_semi")
    sets = shingle_sets(again).join(homes, "node").groupBy(*wanted.columns).agg(F.first("shingles").alias("shingles"))
    return stage(sets, "copy-sets")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose shingle sets have at least that Jaccard similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return both.where(100 * common >= percent * union).select("a", "b")


def rare_shingles(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(shingle, node, root, size, weight, sketch): the shingles by which texts of different classes can be similar.

    Similar texts x, y of two classes share ``percent`` of the shingles of either, all of them held
    by more than one class. So a text with fewer such shingles has no partner, and of those of any
    other, put in one order for all texts, the first ones up to what it may lack and one more hold a
    shingle of each partner (prefix filter). Rare shingles come first. ``weight`` is high for texts
    whose shingles many others have.
    """
    each = sets.select("node", "root", F.explode("shingles").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high"))
    # What belongs to a node joins its list of shingles, not each of them.
    across = each.select("node", "shingle").join(held.where("low != high").select("shingle", "df"), "shingle")
    lists = across.groupBy("node").agg(F.sum("df").alias("total"), F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("list"))
    known = sets.select("node", "root", F.size("shingles").alias("size")).join(nodes.select("node", "sketch"), "node")
    spare = F.size("list") - F.ceil(percent * F.col("size") / 100).cast("int") + 1
    weight = (F.col("total") / F.col("size")).alias("weight")
    first = lists.join(known, "node").withColumn("spare", spare).where("spare > 0")
    return first.select(F.explode(F.slice("list", 1, F.col("spare"))).alias("at"), "node", "root", "size", weight, "sketch").select(
        "at.shingle", "node", "root", "size", "weight", "sketch"
    )


def _other_class(percent: int) -> Column:
    """Of rows (node, root, size, sketch) and the same of a mate: different classes that may hold similar texts."""
    sizes = 100 * F.least("size", "its_size") >= percent * F.greatest("size", "its_size")
    return (F.col("root") != F.col("its_root")) & sizes & may_be_similar("size", "its_size", "sketch", "its_sketch", percent)


def lead_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """Each holder of a shingle with the holder of most weight: an original meets its copies here."""
    lead = rare.groupBy("shingle").agg(F.max(F.struct("weight", "node", "root", "size", "sketch")).alias("lead"))
    its = {"node": "mate", "root": "its_root", "size": "its_size", "sketch": "its_sketch"}
    lead = lead.select("shingle", *[F.col(f"lead.{c}").alias(n) for c, n in its.items()])
    pairs = rare.join(lead, "shingle").where(_other_class(percent))
    return pairs.select(F.least("node", "mate").alias("a"), F.greatest("node", "mate").alias("b")).distinct()


def all_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """All holders of a shingle with each other, where their classes differ; block by block."""
    sizes = rare.groupBy("shingle").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high"))
    sizes = stage(sizes.where("low != high").select("shingle", "blocks"), "copy-blocks")
    rows = rare.join(sizes, "shingle")
    left = rows.select("shingle", "node", "root", "size", "sketch", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = rows.select(
        "shingle",
        F.col("node").alias("mate"),
        F.col("root").alias("its_root"),
        F.col("size").alias("its_size"),
        F.col("sketch").alias("its_sketch"),
        F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
    )
    pairs = left.join(right, ["shingle", "block"]).where((F.col("node") < F.col("mate")) & _other_class(percent))
    return pairs.select(F.col("node").alias("a"), F.col("mate").alias("b")).distinct()


def crowded_links(links: DataFrame, crowded: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``links`` and what it takes to connect all similar texts of ``crowded``, however many share a key.

    Texts of one class need no further link. First the texts meet one each per rare shingle, which
    leaves few classes; then all pairs of different classes are compared that the prefix filter
    allows, so none is left out.
    """
    sets = None
    for propose in (lead_pairs, all_pairs):
        links = stage(components(links, "a", "b").select(F.col("node").alias("a"), F.col("root").alias("b")), "copy-contracted")
        roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        wanted = (crowded if sets is None else sets).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        classed = sets_of(wanted, docs, nodes) if sets is None else wanted
        sets = classed.drop("root") if sets is None else sets
        rare = stage(rare_shingles(classed, nodes, percent), "copy-rare")
        pairs = stage(propose(rare, percent), "copy-pairs")
        links = stage(links.unionByName(similar(pairs, sets, percent)), "copy-links")
    return links


def near_copies(docs: DataFrame, percent: int = round(100 * COPY_SIMILARITY)) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text) of each row, and ``keep``: the row its group keeps.

    Texts with equal word sequences (lower case, white space aside) are copies; texts whose sets of
    five-word shingles are ``percent`` similar are linked when they meet in a key, or both have a key
    that many share, and groups are the connected components. The kept row is the one with the least doc_id, nulls first, ties by
    text. Shorter texts are one shingle; texts without words are copies of each other. Repeated rows
    have the same entry. Extra columns are left aside.
    """
    rows = docs.select("doc_id", "text")
    marked = stage(signatures(rows), "signatures")
    nodes = stage(marked.groupBy("node").agg(F.min(F.struct("doc_id", "t1", "t2", "prints", "least", "size", "sketch")).alias("own")), "copy-nodes")
    nodes = nodes.select("node", "own.*")
    buckets = copy_buckets(nodes)
    pairs = stage(candidate_copies(buckets, nodes, percent), "copy-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = stage(similar(pairs, sets_of(wanted, rows, nodes), percent), "copy-links")
    crowded = stage(buckets.where(F.col("n") > COPY_BUCKET).select("node").distinct(), "copy-crowded")
    if not crowded.isEmpty():
        links = crowded_links(links, crowded, rows, nodes, percent)
    linked = components(links, "a", "b")
    rooted = nodes.join(linked, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), F.struct("doc_id", "t1", "t2").alias("own")
    )
    rooted = stage(rooted, "copy-roots")
    best = rooted.groupBy("root").agg(F.min("own").alias("keep"))
    classes = stage(rooted.join(best, "root").select("node", "keep"), "copy-classes")
    return marked.join(classes, "node").select("doc_id", "t1", "t2", "keep")


def drop_copies(docs: DataFrame, percent: int = round(100 * COPY_SIMILARITY)) -> DataFrame:
    """One document of each group of near copies, with its own columns."""
    marked = stage(near_copies(docs, percent), "copy-marks")
    kept = marked.where(F.struct("doc_id", "t1", "t2") == F.col("keep")).groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("n"))
    kept = stage(kept.select(F.col("doc_id").alias("id"), F.col("t1").alias("h1"), F.col("t2").alias("h2"), "n"), "copy-kept")
    names = docs.columns
    boxed = docs.select(F.struct(*names).alias("row"), "doc_id", *text_hashes())
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2"))
    chosen = boxed.join(kept, same, "left_semi")
    if kept.where("n > 1").limit(1).count():  # rows that repeat in id and text: one of them stays
        chosen = chosen.dropDuplicates(["doc_id", "t1", "t2"])
    return chosen.select("row.*")

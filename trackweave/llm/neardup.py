"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set is its distinct SHINGLE-word shingles. A sketch has BINS coordinates. In round i every
element falls into one bin by a hash of the round and bids a value that grows with i; the bin keeps its
least bid, and rounds go on until all bins are filled. From round BINS on, round i puts all elements in
bin i - BINS, so 2 BINS rounds fill every coordinate. Coordinates of two sets agree with probability
their similarity, and the share that agrees is concentrated about it. A band joins ROWS coordinates: two
sets with similarity 0.75 share no band with probability (1 - 0.75^6)^84, below 1e-7.

Copies are one node. Nodes that share a band are candidates. First each node is held against the least
node of all its buckets; then, where a bucket still holds several classes of connected nodes, those outside
its largest class against one of that class. So nodes that link to a large group mostly do so for the rows
of the buckets, not their pairs. What is still in different classes of a bucket is all compared, so that no
link between classes is lost: pair by pair in small buckets, in blocks on the full sets in large ones.
Candidates whose sketches agree too little (six standard
deviations below the threshold) go; the rest is confirmed on the full sets of both texts. Components
come from repeated minimum labels and shortcuts; every round is a written table.

Defined results: null or wordless texts have 0 shingles and are linked with nothing. Repeated rows of an
id are each reported; `near_dedup` keeps one. Null ids take part, but never name a component: one with
null ids only has a null name, and its rows are kept. Ties cannot occur, links being unordered. An empty
table gives an empty one. Extra columns are ignored by the report and kept by the filter. Shingles and
sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ragged

SHINGLE = 5
PERCENT = 75
ROWS, BANDS = 6, 84
BINS = ROWS * BANDS
#: Coordinates of which a byte each is kept for the first look at a pair, and how many must agree.
LOOK, AGREE = 256, 150
#: Buckets of up to SMALL members are taken pair by pair, larger ones in blocks of so many nodes and shingles.
SMALL = 16
BLOCK_NODES, BLOCK_SHINGLES = 512, 1 << 20
MATRIX_COLUMNS = 4096
EMPTY = np.uint64(2**64 - 1)


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle hash) sorted and distinct, and the set size of each text."""
    hashes, counts = ragged.words(texts, ragged.SPACED)
    owner, found = [], []
    for k in range(1, SHINGLE + 1):
        spots, own = ragged.gram_starts(counts, k)
        fit = counts[own] >= SHINGLE if k == SHINGLE else counts[own] == k
        owner.append(own[fit])
        found.append(ragged.grams(hashes, k)[spots[fit]])
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    owner, found = owner[new], found[new]
    return owner, found, np.bincount(owner, minlength=len(texts))


def sketch(owner: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """n x BINS coordinates; texts without elements stay EMPTY."""
    out = np.full(n * BINS, EMPTY, np.uint64)
    for i in range(2 * BINS):
        if not len(owner):
            break
        z = ragged.mix(found + np.uint64((int(ragged.BASE) * (2 * i + 1)) % 2**64))
        spot = (((z & np.uint64(0xFFFFFFFF)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64) if i < BINS else i - BINS
        bid = np.uint64(i << 53) | (z >> np.uint64(11))
        np.minimum.at(out, owner * BINS + spot, bid)
        if i % 8 == 7 or i < 8:
            own = owner[np.r_[True, owner[1:] != owner[:-1]]]
            full = np.zeros(n, bool)
            full[own] = (out.reshape(n, BINS)[own] != EMPTY).all(axis=1)
            stay = ~full[owner]
            owner, found = owner[stay], found[stay]
    return out.reshape(n, BINS)


def band_hashes(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates.reshape(len(coordinates), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        out = ragged.mix((out + rows[:, :, r]) * ragged.BASE)
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n, node, bands, look): th hashes the text, node the set (null: empty)."""
    common.importable(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(at, 500)
                owner, found, sizes = shingle_sets(part.column(2).to_pylist())
                coordinates = sketch(owner, found, len(sizes))
                total = np.zeros(len(sizes), np.uint64)
                np.add.at(total, owner, ragged.mix(found ^ ragged.BASE))
                node = ragged.mix(total + sizes.astype(np.uint64)).view(np.int64)
                bands = pa.FixedSizeListArray.from_arrays(pa.array(band_hashes(coordinates).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
                look = pa.array([row.tobytes() for row in coordinates[:, :LOOK].astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes.astype(np.int64)), pa.array(node, mask=sizes == 0), bands, look], names=["doc_id", "th", "n", "node", "bands", "look"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(rows, f"doc_id {kind}, th long, n long, node long, bands array<long>, look binary")


def similar(texts: list[str | None], others: list[str | None]) -> np.ndarray:
    """Whether the full sets of each pair of texts meet the threshold."""
    n = len(texts)
    owner, found, sizes = shingle_sets([*texts, *others])
    owner = owner % n
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    both = np.flatnonzero((owner[1:] == owner[:-1]) & (found[1:] == found[:-1]))
    shared = np.bincount(owner[both], minlength=n)
    union = sizes[:n] + sizes[n:] - shared
    return (100 * shared >= PERCENT * union) & (union > 0)


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the nodes wanted; a node's text is that of its first document."""
    keys = common.written(nodes.join(wanted, "node", "left_semi").select("node", F.col("rep.doc_id").alias("k_id"), F.col("rep.th").alias("k_th")), "wanted-nodes")
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return own.join(common.small(keys), own["doc_id"].eqNullSafe(keys["k_id"]) & (own["th"] == keys["k_th"])).select("node", "text").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar; written."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, LOOK) for k in (2, 3))
            stay = pa.array((a == b).sum(axis=1) >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(stay) for k in (0, 1)], names=["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                stay = pa.array(similar(part.column(2).to_pylist(), part.column(3).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(k).filter(stay) for k in (0, 1)], names=["a", "b"])

    def side(table: DataFrame, end: str, *fields: str) -> DataFrame:
        return table.select(F.col("node").alias(end), *[F.col(f).alias(f"{f}_{end}") for f in fields])

    close = pairs.join(side(nodes, "a", "look"), "a").join(side(nodes, "b", "look"), "b")
    close = common.written(close.select("a", "b", "look_a", "look_b").mapInArrow(agree, "a long, b long"), "close-pairs")
    texts = texts_of(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs)
    full = close.join(side(texts, "a", "text"), "a").join(side(texts, "b", "text"), "b")
    return common.written(full.select("a", "b", "text_a", "text_b").mapInArrow(meet, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node with a link: the least node reachable. Least labels of neighbours, then of labels, until nothing changes."""
    ends = common.written(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = common.written(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = ends.join(labels, ends["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("new"))
        better = common.written(better, "labels")
        of = better.select(F.col("node").alias("at"), F.col("new").alias("further"))
        after = better.join(of, better["new"] == of["at"], "left").select("node", "label", F.least("new", "further").alias("new"))
        after = common.written(after, "labels")
        if not after.where("new != label").limit(1).count():
            return labels
        labels = after.select("node", F.col("new").alias("label"))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels with the classes that links connect made one; only the classes themselves are walked."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
    between = links.join(of("a"), "a").join(of("b"), "b").where("label_a != label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
    new = components(between).select(F.col("node").alias("old"), F.col("label").alias("new"))
    return common.written(labels.join(new, labels["label"] == new["old"], "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, node, n, label, main, total, others, weight) of the buckets that hold several classes.

    main is the class with most members there, others counts the members outside it, weight sums n."""
    own = members.select("h", "node", "n").join(labels, "node")
    sizes = own.groupBy("h", "label").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    several = sizes.groupBy("h").agg(F.max(F.struct("size", "label")).alias("top"), F.count("*").alias("classes"), F.sum("size").alias("total"), F.sum("weight").alias("weight")).where("classes > 1")
    several = several.select("h", F.col("top.label").alias("main"), "total", (F.col("total") - F.col("top.size")).alias("others"), "weight")
    return common.written(own.join(several, "h"), "open-members")


def fitting(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b), a > b, of pairs (node, n, other, other_n) whose sizes allow the threshold."""
    fit = pairs.where(100 * F.least("n", "other_n") >= PERCENT * F.greatest("n", "other_n"))
    return fit.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def to_center(still: DataFrame) -> DataFrame:
    """Members outside their bucket's main class with one of its members."""
    center = still.where("label = main").groupBy("h").agg(F.min(F.struct(F.col("node").alias("other"), F.col("n").alias("other_n"))).alias("c"))
    return fitting(still.where("label != main").join(center.select("h", "c.other", "c.other_n"), "h"))


def small_pairs(still: DataFrame) -> DataFrame:
    """Members of different classes of a bucket of SMALL members at most."""
    few = still.where(F.col("total") <= SMALL)
    other = few.select(F.col("h").alias("other_h"), F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("label").alias("other_label"))
    return fitting(few.join(other, (F.col("h") == F.col("other_h")) & (F.col("label") < F.col("other_label"))))


def block_links(still: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between classes of the buckets of over SMALL members; written.

    A bucket's members outside the main class meet all others there, block by block of bounded size: a task
    holds two blocks' full sets and counts what all their pairs share by a matrix product. No pair is a row;
    one link for two classes of a block is enough."""
    big = still.where(F.col("total") > SMALL)
    per = F.greatest(F.lit(1 / BLOCK_NODES), F.col("weight") / F.col("total") / BLOCK_SHINGLES)
    count = lambda c: F.greatest(F.lit(1), F.ceil(c * per)).cast("int")
    parts = big.withColumns({"o": count(F.col("others")), "m": count(F.col("total") - F.col("others"))})
    lot, whole = F.xxhash64("node"), F.col("total") * per <= 1
    out, main = F.pmod(lot, F.col("o")).cast("int"), F.pmod(lot, F.col("m")).cast("int")
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    outside = F.concat(upto(F.col("m"), lambda j: cell(out, j)), upto(F.col("o"), lambda q: cell(F.least(out, q), F.col("m") + F.greatest(out, q))))
    cells = F.when(whole, F.array(cell(F.lit(0), F.lit(0)))).when(F.col("label") != F.col("main"), outside).otherwise(upto(F.col("o"), lambda i: cell(i, main)))
    placed = parts.select("h", "node", "label", F.explode(cells).alias("at")).select("h", "node", "label", "at.i", "at.j")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found, sizes = shingle_sets(batch.column(1).to_pylist())
            ends = pa.array(np.cumsum(np.r_[0, sizes]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(found.view(np.int64)))], names=["node", "set"])

    def meet(table: pa.Table) -> pa.Table:
        nodes, labels = (table.column(c).to_numpy() for c in ("node", "label"))
        held = table.column("set").combine_chunks()
        sizes = np.diff(held.offsets.to_numpy())
        shared = shared_counts(np.repeat(np.arange(len(nodes)), sizes), held.flatten().to_numpy(), len(nodes))
        union = sizes[:, None] + sizes[None, :] - shared
        a, b = np.nonzero((100 * shared >= PERCENT * union) & (labels[:, None] < labels[None, :]))
        _, first = np.unique(np.stack([labels[a], labels[b]]), axis=1, return_index=True)
        return pa.table({"a": nodes[a[first]], "b": nodes[b[first]]})

    wanted = common.written(big.select("node").distinct(), "block-nodes")
    full = common.written(texts_of(wanted, nodes, docs).mapInArrow(sets, "node long, set array<long>"), "block-sets")
    return common.written(placed.join(full, "node").groupBy("h", "i", "j").applyInArrow(meet, "a long, b long"), "links")


def shared_counts(owner: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """n x n: how many elements each two of n sets share."""
    _, at, times = np.unique(found, return_inverse=True, return_counts=True)
    shared = np.zeros((n, n), np.int64)
    often = times > 1
    place = np.cumsum(often) - 1
    stay = often[at]
    owner, at = owner[stay], place[at[stay]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for start in range(0, int(often.sum()), MATRIX_COLUMNS):
        begin, end = np.searchsorted(at, [start, start + MATRIX_COLUMNS])
        dense = np.zeros((n, MATRIX_COLUMNS), np.float32)
        dense[owner[begin:end], at[begin:end] - start] = 1
        shared += (dense @ dense.T).astype(np.int64)
    return shared


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n, node) of every document, and (node, component) of every node with links or copies; both written."""
    rows = common.written(sketched(docs), "sketches")
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("look").alias("look"), F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("least"))
    nodes = common.written(nodes, "nodes")
    banded = nodes.select("node", "n", F.explode("bands").alias("h"))
    shared = banded.groupBy("h").agg(F.min(F.struct("node", "n")).alias("c"), F.max("node").alias("last")).where("c.node < last").select("h", F.col("c.node").alias("other"), F.col("c.n").alias("other_n"))
    members = common.written(banded.join(shared, "h"), "bucket-members")
    least = members.where("node != other").groupBy("node", "n").agg(F.min(F.struct("other", "other_n")).alias("c"))
    tried = common.written(fitting(least.select("node", "n", "c.other", "c.other_n")), "pairs")
    labels = members.select("node", F.col("node").alias("label")).distinct()
    labels = joined(labels, confirmed(tried, nodes, docs))
    pairs = to_center(open_members(members, labels)).join(tried, ["a", "b"], "left_anti")
    pairs = common.written(pairs, "pairs")
    labels = joined(labels, confirmed(pairs, nodes, docs))
    still = open_members(members, labels)
    rest = small_pairs(still).join(tried.unionByName(pairs), ["a", "b"], "left_anti")
    links = confirmed(common.written(rest, "pairs"), nodes, docs)
    if still.where(F.col("total") > SMALL).limit(1).count():
        links = links.unionByName(block_links(still, nodes, docs))
    labels = joined(labels, links)
    of = nodes.select("node", "least").join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    named = of.groupBy("label").agg(F.min("least").alias("component"))
    return rows.select("doc_id", "th", "n", "node"), common.written(of.join(named, "label").select(F.col("node").alias("k_node"), "component"), "components")


def near_dup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable), kept."""
    rows, of = classes(docs)
    both = rows.join(common.small(of), rows["node"] == of["k_node"], "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return both.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each component, with its own columns; all without words stay."""
    rows, of = classes(docs)
    both = rows.join(common.small(of), rows["node"] == of["k_node"])
    gone = common.written(both.where(~F.col("doc_id").eqNullSafe(F.col("component"))).select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")).distinct(), "near-duplicates")
    kept = docs.join(common.small(gone), docs["doc_id"].eqNullSafe(gone["k_id"]) & (F.xxhash64(docs["text"]) == gone["k_th"]), "left_anti")
    again = rows.where("node is not null").groupBy("doc_id", "th").count().where("count > 1")
    return kept.dropDuplicates(["doc_id", "text"]) if again.limit(1).count() else kept

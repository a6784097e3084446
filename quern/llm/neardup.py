"""Near-duplicate groups by SuperMinHash, banding, verification on full sets and union-find.

A document's set is its distinct five-word shingles over lower-cased (A-Z) words; with one to four
words the whole sequence is its one shingle.  Two documents are linked if their sets' Jaccard
similarity is at least 0.75; groups are the connected components of the links.

1. One pass makes, per document, the set's size, a 128-bit fingerprint of the set and the band keys of
   its SuperMinHash signature.  Documents with equal sets are one *class*, of which only the member
   with the smallest id (the representative) goes on, so that a group of copies, however large, is one
   row from here on.
2. Representatives that share a band key form a bucket.  Each member is paired with the bucket's hub,
   the member that shares most buckets with others, so pairs grow linearly with a bucket's size.
   Candidate pairs are verified on full sets; union-find on the verified links gives components.
3. Buckets whose members still lie in more than one component are joined completely, block against
   block (``BLOCK`` members each, an even share), within tasks, by prefixes of the rarest shingles; only verified links
   leave them.  Blocks of sizes too far apart do not meet.  The members of a bucket's largest component meet the
   others only, not one another, so a large group with a few strangers stays linear.  No pair of a bucket
   stays untested unless its two ends are already connected or cannot be alike.

Two sets of similarity 0.75 share no band with probability (1 - 0.75 ** 3) ** 32 = 2.4e-8 (at 0.8 with 1.6e-10).

Defined cases: null or wordless text has the empty set, is linked with nothing and is kept.  Rows with
equal ids and texts are one document: each row is returned, with the same component.  Rows of one id with different texts
are one document too, linked with whatever one of its texts is linked with.  A null id links with nothing (its component
is null) and is kept.  Very long texts are read whole, in pieces.  An empty table gives an empty result.  Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import common
from quern.llm.components import connected_components

WIDTH = 5
BANDS, ROWS = 32, 3
POSITIONS = BANDS * ROWS
#: Linked if SIM_NUM * union <= SIM_DEN * intersection.
SIM_NUM, SIM_DEN = 75, 100
#: Members of a bucket's block; so few members are compared pair by pair.
BLOCK, FEW = 1024, 24

_U = np.uint64
_SIGNATURE = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"


def shingle_hashes(run: common.Run) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a run's rows (repeats included) and the rows' bounds in them."""
    return shingles_of_words(*common.word_hashes(run))


def shingles_of_words(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(bounds)
    made = np.where(counts >= WIDTH, counts - WIDTH + 1, np.minimum(counts, 1))
    out_bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(made, out=out_bounds[1:])
    out = np.zeros(int(out_bounds[-1]), dtype=np.uint64)
    windows = common.chain(h, WIDTH)
    if len(windows):
        rows = np.repeat(np.arange(len(counts)), counts)[: len(windows)]
        inside = np.arange(len(windows)) + WIDTH <= bounds[1:][rows]
        long_rows = np.repeat(counts >= WIDTH, made)
        out[long_rows] = windows[inside]
    for width in range(1, WIDTH):
        at = np.flatnonzero(counts == width)
        if len(at):
            acc = h[bounds[at]].copy()
            for k in range(1, width):
                acc = acc * _U(0xD6E8FEB86659FD93) + h[bounds[at] + k]
            out[out_bounds[at]] = common.mix(acc + common.u64(width * 0xA24BAED4963EE407))
    return out, out_bounds


def superminhash(h: np.ndarray, bounds: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """The SuperMinHash signature of each row's elements, shape (rows, positions).

    Element ``x`` takes at step ``j`` the rank ``j + fraction(x, j)`` at the ``j``-th place of its own
    random permutation of the positions (a Fisher-Yates shuffle run one swap a step), and a position
    keeps its smallest rank.  The permutation makes an element's ranks differ in their whole parts, which
    lowers the variance against independent hashing.  A row stops as soon as all its positions hold
    ranks below ``j + 1``: later steps cannot lower them.  Ranks are held as integers (whole part in
    the upper 32 bits).
    """
    rows = len(bounds) - 1
    counts = np.diff(bounds)
    sig = np.full((rows, positions), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = sig.reshape(-1)
    row = np.repeat(np.arange(rows), counts)
    x, shuffle = h, None
    for j in range(positions):
        if len(x) == 0:
            break
        draw = common.mix(x + common.u64((j + 1) * 0x9E3779B97F4A7C15))
        place = j + (((draw & _U(0xFFFFFFFF)) * _U(positions - j)) >> _U(32)).astype(np.int64)
        rank = (_U(j) << _U(32)) | (draw >> _U(32))
        if shuffle is None:
            at = place
        else:
            every = np.arange(len(x))
            at = shuffle[every, place].astype(np.int64)
            shuffle[every, place] = shuffle[:, j]
            shuffle[:, j] = at
        np.minimum.at(flat, row * positions + at, rank)
        going = sig.max(axis=1) >= (_U(j + 1) << _U(32))
        keep = going[row]
        if j == 0 and keep.any():
            x, row, first = x[keep], row[keep], place[keep]
            shuffle = np.tile(np.arange(positions, dtype=np.uint8 if positions <= 256 else np.uint16), (len(x), 1))
            shuffle[np.arange(len(x)), first] = 0
            shuffle[:, 0] = first
        elif not keep.all():
            x, row = x[keep], row[keep]
            shuffle = shuffle[keep] if shuffle is not None else None
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS)
    acc = np.zeros((len(sig), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F)
    for k in range(ROWS):
        acc = common.mix(acc ^ parts[:, :, k])
    return acc


def distinct_sets(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bands", pa.list_(pa.int64()))])
    for batch in batches:
        ids = batch.column(0)
        for run in common.runs(batch.column(1)):
            h, bounds = shingle_hashes(run)
            sets = distinct_sets(h, bounds)
            sizes = np.fromiter(map(len, sets), dtype=np.int64, count=run.rows)
            every = np.concatenate(sets) if sets else h[:0]
            set_bounds = np.concatenate([[0], np.cumsum(sizes)])
            prints = []
            for salt in (0x8CB92BA72F3D8DD7, 0x52A9F3C1D5B7E94B):
                sums = np.concatenate([[_U(0)], np.cumsum(common.mix(every ^ _U(salt)))])
                prints.append(common.mix(sums[set_bounds[1:]] - sums[set_bounds[:-1]] + sizes.astype(np.uint64)).view(np.int64))
            keys = band_keys(superminhash(every, set_bounds)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, run.rows * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids.slice(run.first, run.rows), pa.array(sizes), pa.array(prints[0]), pa.array(prints[1]), lists], schema=schema)


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full set of each document as its sorted hashes, eight bytes each."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        for run in common.runs(batch.column(1)):
            sets = [s.tobytes() for s in distinct_sets(*shingle_hashes(run))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, run.rows), pa.array(sets, pa.binary())], schema=schema)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 75 * union, for two sorted sets."""
    small, large = (len(a), len(b)) if len(a) <= len(b) else (len(b), len(a))
    if small == 0 or SIM_DEN * small < SIM_NUM * large:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = b.searchsorted(a)
    at[at == large] = 0
    shared = int(np.count_nonzero(b[at] == a))
    return SIM_DEN * shared >= SIM_NUM * (small + large - shared)


def verify_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        left, right = (batch.column(k) for k in (2, 3))
        keep = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(left, right, strict=True)]
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=schema)


def prefix_length(n: int) -> int:
    """How many of a set's elements, rarest first, hold one of every set it is linked with: these share at least 0.75 of it."""
    return n - -(-SIM_NUM * n // SIM_DEN) + 1


def prefix_candidates(sets: list[np.ndarray], labels: np.ndarray) -> Iterator[list[int]]:
    """Groups of members of several components that share one of their rarest elements: all pairs that can be alike are in some group."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rarity = np.empty(len(counts), dtype=np.int64)
    rarity[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    order = np.lexsort((rarity[place], owner))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    nth = np.arange(len(owner)) - starts[owner]
    first = np.array([prefix_length(int(n)) for n in sizes], dtype=np.int64)
    held = nth < first[owner]
    posted, element = owner[held], rarity[place][order][held]
    turn = np.argsort(element, kind="stable")
    posted, element = posted[turn], element[turn]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(element)) + 1, [len(element)]])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        # Lists of one component only are most of a large group's: nothing is left to compare in them.
        if hi - lo > 1 and (labels[posted[lo:hi]] != labels[posted[lo]]).any():
            yield posted[lo:hi].tolist()


def link_cell(ids: list[int], labels: list[int], tags: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Verified links between different components among the members of two blocks of a bucket (or of one).

    Members that a link has joined are not compared any more, so a group gives a spanning tree.  Many members are joined by
    prefixes: elements are ordered by how few of them hold them, and only members that share one of their first
    elements are compared, on full sets; no pair that is alike is missed.
    """
    one_block = len(set(tags)) == 1
    sizes = [len(s) for s in sets]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    tried: set[tuple[int, int]] = set()
    found: list[tuple[int, int]] = []
    groups = [list(range(len(ids)))] if len(ids) <= FEW else prefix_candidates(sets, np.array(labels))
    for members in groups:
        members.sort(key=lambda i: (sizes[i], i))
        for n, i in enumerate(members):
            for k in members[n + 1 :]:
                if SIM_DEN * sizes[i] < SIM_NUM * sizes[k]:
                    break
                if not one_block and tags[i] == tags[k]:
                    continue
                p, q = find(labels[i]), find(labels[k])
                if p == q or (i, k) in tried:
                    continue
                tried.add((i, k))
                if alike(sets[i], sets[k]):
                    root[max(p, q)] = min(p, q)
                    found.append((ids[i], ids[k]))
    return found


def link_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``link_cell`` over rows of (cell's six numbers, block, rep, label, shingles) that come ordered by cell.

    A cell is held while its rows come: two blocks' sets at most.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    cell, held = None, ([], [], [], [])
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True))
        ids, labels, tags = (batch.column(k).to_pylist() for k in (7, 8, 6))
        # The sets' bytes are copied, so that no batch is kept for a few of its rows.
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(9)]
        found: list[tuple[int, int]] = []
        for key, *row in zip(keys, ids, labels, tags, sets, strict=True):
            if key != cell:
                found += link_cell(*held) if len(held[0]) > 1 else []
                cell, held = key, ([], [], [], [])
            for column, value in zip(held, row, strict=True):
                column.append(value)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], schema=schema)
    found = link_cell(*held) if len(held[0]) > 1 else []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], schema=schema)


def deal_blocks(members: DataFrame) -> DataFrame:
    """Members of open buckets (key, rep, label, n: their set's size), dealt to the cells in which blocks meet.

    Linked sets differ in size by a third at most, so members are dealt by bands of sizes (powers of 4/3) and blocks meet
    those of their own and the neighbouring bands only.  Kind 0: a block of the largest component's members meets a
    block of the others.  Kind 1: two blocks of the others meet, or one meets itself.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(SIM_DEN / SIM_NUM)) + 1e-9).cast("int")
    labels = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("top")).select("key", F.col("top.label").alias("major"))
    at = members.join(labels, "key").select("key", "rep", (F.col("label") == F.col("major")).alias("main"), "label", band.alias("g"))
    parts = lambda n: F.greatest(F.ceil(n / F.lit(BLOCK)), F.lit(1)).cast("int")
    counts = at.groupBy("key", "g").agg(F.count_if("main").alias("c0"), F.count_if(~F.col("main")).alias("c1"))
    counts = counts.select("key", F.col("g").alias("h"), "c0", parts(F.col("c0")).alias("n0"), "c1", parts(F.col("c1")).alias("n1"))
    near = at.select("*", F.explode(F.array(F.col("g") - 1, F.col("g"), F.col("g") + 1)).alias("h"))
    # The other side's blocks, and the member's own number among its band's.
    own = counts.select("key", F.col("h").alias("g"), F.when(F.col("c0") > 0, F.col("n0")).alias("own0"), F.when(F.col("c1") > 0, F.col("n1")).alias("own1"))
    met = near.join(counts, ["key", "h"]).join(own, ["key", "g"])
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("own0")).otherwise(F.col("own1"))).cast("int").alias("mine")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1)).alias("other")
    columns = ["key", "rep", "label", "main", "g", "h"]
    across = met.where(F.when(F.col("main"), F.col("c1")).otherwise(F.col("c0")) > 0).select(*columns, mine, every(F.when(F.col("main"), F.col("n1")).otherwise(F.col("n0"))))
    among = met.where((~F.col("main")) & (F.col("c1") > 0)).select(*columns, mine, every(F.col("n1")))
    cell = lambda df, kind, glo, ghi, lo, hi, block: df.select("key", F.lit(kind).alias("kind"), glo.alias("glo"), ghi.alias("ghi"), lo.alias("lo"), hi.alias("hi"), block.cast("int").alias("block"), "rep", "label")
    g, h, a, b, main = (F.col(c) for c in ("g", "h", "mine", "other", "main"))
    pick = lambda test, x, y: F.when(test, x).otherwise(y)
    first = cell(across, 0, pick(main, g, h), pick(main, h, g), pick(main, a, b), pick(main, b, a), pick(main, F.lit(0), F.lit(1)))
    level = among.where("g = h")
    second = cell(level, 1, g, g, F.least(a, b), F.greatest(a, b), a)
    slant = among.where("g <> h")
    third = cell(slant, 1, F.least(g, h), F.greatest(g, h), pick(g < h, a, b), pick(g < h, b, a), g)
    return first.union(second).union(third)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: see the module's text."""
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = texts.mapInArrow(signatures, _SIGNATURE).checkpoint()

    linked = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = linked.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")).checkpoint()

    keyed = classes.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = keyed.join(shared, "key").checkpoint()
    degree = members.groupBy("rep").agg(F.sum("members").alias("degree"))
    ranked = members.join(degree, "rep").select("key", "rep", "degree")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("minus"))).alias("top"))
    hubs = hubs.select("key", (-F.col("top.minus")).alias("hub"))
    pairs = members.join(hubs, "key").where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct().checkpoint()

    # A row a text: of rows with one id but different texts, every text's set stands for the id.
    needed = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = texts.join(needed, "doc_id", "left_semi").mapInArrow(shingle_sets, "doc_id long, shingles binary").dropDuplicates(["doc_id", "shingles"]).checkpoint()

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    links = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(verify_pairs, "a long, b long").checkpoint()
    labels = connected_components(links)

    # Buckets of three or more hold pairs that no hub took part in.
    placed = members.where("members > 2").join(labels, members.rep == labels.node, "left")
    placed = placed.select("key", "rep", "members", F.coalesce("root", "rep").alias("label"))
    open_keys = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    open_members = placed.join(open_keys, "key").checkpoint()
    if not open_members.isEmpty():
        sized = sets.select(F.col("doc_id").alias("rep"), (F.octet_length("shingles") / 8).cast("long").alias("n"), "shingles")
        dealt = deal_blocks(open_members.join(sized.select("rep", "n"), "rep")).distinct().join(sized.select("rep", "shingles"), "rep")
        cell = ["key", "kind", "glo", "ghi", "lo", "hi"]
        ordered = dealt.select(*cell, "block", "rep", "label", "shingles").repartition(*cell).sortWithinPartitions(*cell, "rep")
        more = ordered.mapInArrow(link_cells, "a long, b long").distinct().checkpoint()
        if not more.isEmpty():
            # Each node's edge to its root stands for the links found so far.
            labels = connected_components(labels.union(more))

    placed_classes = classes.select("fp1", "fp2", "rep").join(labels, classes.rep == labels.node, "left")
    placed_classes = placed_classes.select(F.col("fp1").alias("c1"), F.col("fp2").alias("c2"), F.coalesce("root", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "fp1", "fp2")
    out = out.join(placed_classes, (out.fp1 == placed_classes.c1) & (out.fp2 == placed_classes.c2) & (out.n_shingles > 0), "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, one document of each group; of equal rows one stays."""
    found = near_duplicates(docs, id_col, text_col)
    # A name that none of the caller's columns has.
    key = common.free_name(docs, "key")
    gone = found.where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    same = F.col(id_col) == F.col(key)
    left = docs.join(gone, same, "left_anti")
    twice = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(key)).groupBy(key).count().where("count > 1").select(key).checkpoint()
    if twice.isEmpty():
        return left
    return left.join(twice, same, "left_anti").union(left.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))

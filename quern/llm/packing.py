"""Conflict-constrained best-fit packing of documents into training sequences.

A document longer than ``CAPACITY`` tokens is cut into full pieces and a rest; every piece is one item.
Items go, longest first, into the bin with the least remaining room that they fit and that holds
neither a document of their source nor one of their duplicate cluster.  Bins stand ordered by residual;
each carries a bitmap of its sources and clusters.  The successor search starts at the item's length and
goes on until the tightest compatible bin is found; residuals that hold no bin without a given source
are remembered, so hot sources do not search them again.  Full pieces need no search: a bin each.

Packing runs in shards of about ``SHARD_ROWS`` documents, dealt by a hash of the whole row: an even share
whatever the sources' sizes, repeated ids or rows.  Then the bins that are left with a sixteenth of their room or more are
dissolved and their items packed once more, in shards that mix those of the first round.  The number of
shards follows the table's rows, and a shard's order is fixed, so a lost task is redone with the same result.

Duplicate clusters are near copies: equal words, or SuperMinHash signatures of the five-word shingles that agree like those of
sets of similarity 0.75 (three deviations of the estimate below it; a pair at 0.75 is taken for one with 0.998, and pairs
somewhat below it may conflict too, which costs a little room).  As only documents of one shard can meet in a bin, clusters
are found within shards, and again in the second round.  Verified components of the whole table can be given instead.

Lengths are tokens of the byte-pair vocabulary; a word's tokens are counted once a worker and looked up by its hash.

Defined cases: null or empty text is an item of length 0: it takes no room, but counts as its source's
document in its bin.  Null source or cluster conflicts with nothing.  Repeated rows are items of their
own (they share a cluster, so never a bin, but for texts without a word).  Very long texts are read whole, in pieces.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import bpe, common, neardup

#: Tokens of a sequence; documents of a shard; equal rows dealt at once.
CAPACITY = 1024
SHARD_ROWS, COPIES = 16_000, 64
#: Bins with at least one such part of the capacity left are dissolved once.
LOOSE = 16
#: Documents conflict if their signatures agree in such a share of the positions: three deviations below 0.75.
AGREE = 0.62

PACKED = "doc_id long, piece int, piece_start long, piece_tokens int, shard int, bin int, bin_offset int"


class Bins:
    """Open bins by residual room, with conflict bitmaps."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.by_room: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        #: Bit r is set if some bin has r tokens of room.
        self.rooms = 0
        #: By conflict bit of a source: rooms known to hold no bin without it.
        self.shut: dict[int, int] = {}
        self.used = 0

    def _put(self, at: int, room: int, bits: int) -> None:
        self.by_room[room].setdefault(bits, []).append(at)
        self.rooms |= 1 << room
        for source in self.shut:
            if not bits & source:
                self.shut[source] &= ~(1 << room)

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin and offset for an item; ``source`` and ``cluster`` are single bits or 0."""
        wanted = source | cluster
        open_rooms = self.rooms >> length << length
        if source:
            open_rooms &= ~self.shut.setdefault(source, 0)
        while open_rooms:
            low = open_rooms & -open_rooms
            room = low.bit_length() - 1
            groups = self.by_room[room]
            free_of_source = False
            for bits, members in groups.items():
                if bits & wanted:
                    free_of_source |= not bits & source
                    continue
                at = members.pop()
                if not members:
                    del groups[bits]
                    if not groups:
                        self.rooms &= ~low
                self._put(at, room - length, bits | wanted)
                return at, self.capacity - room
            if source and not free_of_source:
                self.shut[source] |= low
            open_rooms ^= low
        at = self.used
        self.used += 1
        self._put(at, self.capacity - length, wanted)
        return at, 0


def pack_shard(ids: list, lengths: np.ndarray, sources: list, clusters: list, capacity: int = CAPACITY) -> list[tuple]:
    """(row, piece, start, tokens, bin, offset) of every piece of the rows, in packing order."""
    source_bits = {s: 1 << k for k, s in enumerate(sorted({x for x in sources if x is not None}))}
    seen: dict = {}
    for c in clusters:
        if c is not None:
            seen[c] = seen.get(c, 0) + 1
    first = len(source_bits)
    cluster_bits = {c: 1 << (first + k) for k, c in enumerate(sorted(c for c, n in seen.items() if n > 1))}
    order = sorted(range(len(ids)), key=lambda i: (-(int(lengths[i]) % capacity), ids[i] is None, ids[i] or 0, str(sources[i]), str(clusters[i]), int(lengths[i])))
    bins, out = Bins(capacity), []
    for i in order:
        whole, rest = divmod(int(lengths[i]), capacity)
        for piece in range(whole):
            out.append((i, piece, piece * capacity, capacity, bins.used, 0))
            bins.used += 1
        if rest or not whole:
            at, offset = bins.place(rest, source_bits.get(sources[i], 0), cluster_bits.get(clusters[i], 0))
            out.append((i, whole, whole * capacity, rest, at, offset))
    return out


def _rooms(rows: list[tuple], capacity: int) -> dict[int, int]:
    """By bin, what is left of it at the end."""
    left: dict[int, int] = {}
    for _, _, _, tokens, at, _ in rows:
        left[at] = left.get(at, capacity) - tokens
    return left


def alike_clusters(same: list[str | None], signatures: list[bytes | None]) -> list[str | None]:
    """The cluster of each row: rows of equal words, or whose signatures agree in ``AGREE`` of their positions, directly or through others.

    Rows that share a band of their signatures are candidates.  Of a band's rows one after the other that no earlier
    one has taken leads: it is compared with all the others, so a large group of copies takes one comparison a row.
    A cluster is named after its least row, whatever the rows' order.
    """
    names = sorted({c for c in same if c is not None})
    number = {c: k for k, c in enumerate(names)}
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    held = {number[c]: s for c, s in zip(same, signatures, strict=True) if c is not None and s is not None}
    rows = np.array(sorted(held), dtype=np.int64)
    if len(rows) > 1:
        x = np.stack([np.frombuffer(held[k], np.uint32) for k in rows.tolist()])
        keys = neardup.band_keys(x.astype(np.uint64))
        for band in range(keys.shape[1]):
            order = np.argsort(keys[:, band], kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(keys[order, band]) != 0, [True]]))
            for lo in np.flatnonzero(np.diff(cuts) > 1):
                members = order[cuts[lo] : cuts[lo + 1]]
                open_rows = members
                while len(open_rows) > 1:
                    lead = open_rows[0]
                    alike = (x[members] == x[lead]).sum(axis=1) >= AGREE * x.shape[1]
                    for k in members[alike].tolist():
                        p, q = find(int(rows[lead])), find(int(rows[k]))
                        root[max(p, q)] = min(p, q)
                    open_rows = open_rows[1:][~np.isin(open_rows[1:], members[alike])]
    return [None if c is None else names[find(number[c])] for c in same]


def best_fit(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Packs rows of (doc_id, n_tokens, source, cluster), the two last of any kind that casts to string.

    If ``items`` has a column ``signature``, rows of a shard whose signatures are alike are one cluster too.
    """
    spark = items.sparkSession
    common.prepare(spark)
    total = items.count()
    shards = max(1, -(-total // shard_rows))
    signed = F.col("signature") if "signature" in items.columns else F.lit(None)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster")]
    # Equal rows, however many, are counted first and dealt some at a time.
    counted = items.select(*columns, signed.cast("binary").alias("signature")).groupBy("doc_id", "n_tokens", "source", "cluster", "signature").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(COPIES)).cast("long"))).alias("k"))
    dealt = counted.select("doc_id", "n_tokens", "source", "cluster", "signature", F.least(F.lit(COPIES), F.col("n") - F.col("k") * COPIES).cast("int").alias("copies"), F.pmod(F.xxhash64("doc_id", "n_tokens", "source", "cluster", "k"), F.lit(shards)).cast("int").alias("shard"))

    def pack(table: pa.Table) -> pa.Table:
        copies = table.column("copies").to_numpy()
        at = np.repeat(np.arange(len(copies)), copies)
        ids, sources, same, signatures = ([column[i] for i in at] for column in (table.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "signature")))
        rows = pack_shard(ids, table.column("n_tokens").to_numpy()[at], sources, alike_clusters(same, signatures), capacity)
        return _table(rows, ids, sources, same, signatures, np.zeros(len(ids), np.int64), table.column("shard")[0].as_py(), capacity)

    first = dealt.groupBy("shard").applyInArrow(pack, _LOOSE).checkpoint()
    if shards == 1:
        return first.select(*_columns())
    # What is left in loosely filled bins is dealt anew, to shards that mix those of the first round.
    loose = first.where(F.col("room") >= capacity // LOOSE)
    left = loose.count()
    again = max(1, -(-left // shard_rows))
    redealt = loose.withColumn("deal", F.pmod(F.xxhash64("shard", "bin", "bin_offset", "doc_id", "piece"), F.lit(again)).cast("int"))

    def repack(table: pa.Table) -> pa.Table:
        ids, sources, same, signatures = (table.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "signature"))
        rows = pack_shard(ids, table.column("piece_tokens").to_numpy().astype(np.int64), sources, alike_clusters(same, signatures), capacity)
        return _table(rows, ids, sources, same, signatures, table.column("piece").to_numpy().astype(np.int64), shards + table.column("deal")[0].as_py(), capacity)

    second = redealt.groupBy("deal").applyInArrow(repack, _LOOSE)
    return first.where(F.col("room") < capacity // LOOSE).select(*_columns()).union(second.select(*_columns()))


def _columns() -> list[str]:
    return [field.split()[0] for field in PACKED.split(", ")]


_LOOSE = f"{PACKED}, room int, source string, cluster string, signature binary"


def _table(rows: list[tuple], ids: list, sources: list, clusters: list, signatures: list, pieces: np.ndarray, shard: int, capacity: int) -> pa.Table:
    """Packed rows as a table; ``pieces`` are the numbers of the pieces that the items begin with.

    What packing an item once more needs goes along for items in loose bins only.
    """
    columns = list(zip(*rows, strict=True))
    row, piece = np.array(columns[0]), np.array(columns[1])
    left = _rooms(rows, capacity)
    number = pieces[row] + piece
    loose = [left[b] >= capacity // LOOSE for b in columns[4]]
    kept = lambda values: [values[i] if more else None for i, more in zip(columns[0], loose, strict=True)]
    return pa.table(
        {
            "doc_id": pa.array([ids[i] for i in columns[0]], pa.int64()),
            "piece": pa.array(number.astype(np.int32)),
            "piece_start": pa.array(number.astype(np.int64) * capacity),
            "piece_tokens": pa.array(columns[3], pa.int32()),
            "shard": pa.array([shard] * len(rows), pa.int32()),
            "bin": pa.array(columns[4], pa.int32()),
            "bin_offset": pa.array(columns[5], pa.int32()),
            "room": pa.array([left[b] for b in columns[4]], pa.int32()),
            "source": pa.array(kept(sources), pa.string()),
            "cluster": pa.array(kept(clusters), pa.string()),
            "signature": pa.array(kept(signatures), pa.binary()),
        }
    )


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def row_key(id_col: str, text_col: str) -> Column:
    """A document's id or, where that is null, a hash of its lower-cased words (made for such rows only)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lower(F.array_join(words_of(text), " "))))


def with_lengths(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Items of whole texts: key, doc_id, source, n_tokens (of the vocabulary), a hash of the words as cluster, and the SuperMinHash signature.

    Texts without a word have neither cluster nor signature.  The items stand after a checkpoint, as packing reads them twice.
    """
    shipped = bpe.ship(docs.sparkSession, vocabulary)
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64()), ("cluster", pa.string()), ("signature", pa.binary())])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.coder_of(shipped.value)
        for batch in batches:
            for run in common.runs(batch.column(3)):
                h, bounds = common.word_hashes(run)
                place = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(h + common.mix(place.astype(np.uint64))))])
                same = [str(v) if n else None for v, n in zip((sums[bounds[1:]] - sums[bounds[:-1]]).tolist(), np.diff(bounds).tolist(), strict=True)]
                shingles, cuts = neardup.shingles_of_words(h, bounds)
                sets = neardup.distinct_sets(shingles, cuts)
                marks = neardup.superminhash(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
                short = (common.mix(marks) >> np.uint64(32)).astype(np.uint32)
                signatures = [row.tobytes() if c is not None else None for row, c in zip(short, same, strict=True)]
                own = [batch.column(k).slice(run.first, run.rows) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(coder.count_rows(run)), pa.array(same, pa.string()), pa.array(signatures, pa.binary())], schema=schema)

    read = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(over, "key long, doc_id long, source string, n_tokens long, cluster string, signature binary").checkpoint()


def near_clusters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, near: the near-duplicate component of each document, keyed by ``row_key``.

    Rows of one id are one document, as in ``neardup``.
    """
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return neardup.near_duplicates(keyed, "key").groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").cast("string").alias("near"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, clusters: DataFrame | None = None, vocabulary: str | None = None) -> DataFrame:
    """Every document's pieces with their bins: ``PACKED``.

    ``clusters`` are rows of (key, near) as ``near_clusters`` makes them, verified components of the whole table; without them
    documents of a shard conflict whose signatures are alike.
    """
    items = with_lengths(docs, vocabulary)
    if clusters is not None:
        near = F.when(F.col("cluster").isNotNull(), F.coalesce("near", "cluster"))
        items = items.join(clusters, "key", "left").select("doc_id", "n_tokens", "source", near.alias("cluster")).checkpoint()
    return best_fit(items, capacity)

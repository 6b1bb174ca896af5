"""Groups of near-equal texts: MinHash bands propose, odd sketches sift, full shingle sets decide.

Only the groups are wanted, so no pairs within a bucket are ever listed:

1. Equal shingle sets are one node, whatever their number.
2. Nodes that share a band key form a bucket. Each bucket links its members to
   one hub, the member that meets most others over all bands; sketches sift
   these links, full sets confirm them, and confirmed ones make first groups.
3. Buckets whose members are all in one group are done. In the others, members
   of different groups are compared in blocks: the sketches of two blocks at
   a time, and the full sets of what they let through. What a task sends on stays in
   proportion to its members.

Blocks bound the memory of a task, and pairs of blocks within one group are left out, so
a bucket of many copies costs its size, not the square of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscus.llm.components import components
from fiscus.llm.marks import IdMarks
from fiscus.llm.signatures import Scheme, shingles, shingles_of_all, sketch_words
from fiscus.shared import scratch, small_batches, stored

BLOCK = 256
PAIRS_PER_MEMBER = 4


@dataclass(frozen=True)
class Units:
    """The units that are compared: rows (``id``, ``text``), or the parts that ``cut`` makes of them in the tasks.

    ``cut`` gives id and bytes of each part. Units of fewer words than ``least_words`` are left out.
    """

    rows: DataFrame | None
    cut: Callable[[int, bytes], Iterable[tuple[int, bytes]]] | None = None
    least_words: int = 0

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = (text or "").encode()
            yield from self.cut(number, data) if self.cut else ((number, data),)

    def for_tasks(self) -> Units:
        return replace(self, rows=None)


def signed(units: Units, scheme: Scheme) -> DataFrame:
    """``id``, ``n_shingles``, ``digest`` of the shingle set, ``keys`` of the bands and ``sketch``; nulls and no keys without words."""
    kind = units.for_tasks()

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []

            def words_of_units() -> Iterator[list[bytes]]:
                for number, data in kind.parts(batch):
                    words = data.lower().split()
                    if len(words) >= kind.least_words:
                        ids.append(number)
                        yield words

            at = 0
            for values, counts in shingles_of_all(words_of_units()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at : at + len(counts)], pa.int64()), *signed_sets(values, counts, scheme)],
                    names=["id", "n_shingles", "digest", "keys", "sketch"],
                )
                at += len(counts)

    return units.rows.select("id", "text").mapInArrow(
        signatures, "id long, n_shingles long, digest binary, keys array<long>, sketch binary"
    )


def signed_sets(values: np.ndarray, counts: np.ndarray, scheme: Scheme) -> list[pa.Array]:
    """Sizes, digests, band keys and sketches of many sets at once; empty sets have only a size."""
    filled = np.flatnonzero(counts)
    ends = np.cumsum(counts)
    samples = scheme.samples_of_all(values, counts[filled]) if len(filled) else np.empty((0, scheme.bands * scheme.rows), np.uint64)
    digests: list[bytes | None] = [None] * len(counts)
    sketches: list[bytes | None] = [None] * len(counts)
    for n, sketch in zip(filled.tolist(), scheme.sketches(samples)):
        digests[n] = xxhash.xxh3_128_digest(values[ends[n] - counts[n] : ends[n]].tobytes())
        sketches[n] = sketch
    keys = np.where(counts > 0, scheme.bands, 0)
    offsets = pa.array(np.concatenate([[0], np.cumsum(keys)]), pa.int32())
    return [
        pa.array(counts, pa.int64()),
        pa.array(digests, pa.binary()),
        pa.ListArray.from_arrays(offsets, pa.array(scheme.band_keys(samples).ravel(), pa.int64())),
        pa.array(sketches, pa.binary()),
    ]


def shingle_sets(units: Units, wanted: DataFrame) -> DataFrame:
    """``id`` and ``shingle_set`` of all units whose id is in ``wanted``, and of a few others; no text is shuffled."""
    marks = IdMarks(wanted)
    kind = units.for_tasks()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not kind.cut:
                batch = batch.filter(pa.array(marks.hits(batch.column(0).to_numpy(zero_copy_only=False))))
            parts = list(kind.parts(batch))
            ids = np.array([number for number, _ in parts], np.int64)
            chosen = np.flatnonzero(marks.hits(ids))
            found = [shingles(parts[n][1]).tobytes() for n in chosen.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[chosen]), pa.array(found, pa.binary())], names=["id", "shingle_set"]
            )

    return units.rows.select("id", "text").mapInArrow(sets, "id long, shingle_set binary")


def buckets(nodes: DataFrame, signatures: DataFrame) -> DataFrame:
    """``key`` and ``id`` of all buckets with at least two nodes; ``nodes`` maps each ``id`` to its ``node``.

    Most keys occur once; a bitmap of the shared ones leaves their rows out of the second shuffle.
    """
    rows = signatures.select("id", F.explode("keys").alias("key"))
    extremes = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    shared = stored(extremes.filter("low <> high").select("key"), "shared-keys")
    likely = rows.filter(IdMarks(shared, "key").column(F.col("key")))
    members = likely.join(shared, "key").join(nodes, "id").select("key", F.col("node").alias("id")).distinct()
    return stored(members, "buckets")


def hub_links(members: DataFrame) -> DataFrame:
    """Distinct links (``a``, ``b``) of bucket members to the hub of their bucket."""
    sizes = stored(members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "bucket-sizes")
    met = members.join(sizes, "key").groupBy("id").agg(F.sum("size").alias("met"))
    hubs = stored(
        members.join(met, "id")
        .groupBy("key")
        .agg(F.max(F.struct("met", (-F.col("id")).alias("minus"))).alias("best"))
        .select("key", (-F.col("best")["minus"]).alias("hub")),
        "hubs",
    )
    return (
        members.join(hubs, "key")
        .filter("id <> hub")
        .select(F.col("id").alias("a"), F.col("hub").alias("b"))
        .distinct()
    )


def sifted(links: DataFrame, signatures: DataFrame, scheme: Scheme) -> DataFrame:
    """Links whose set sizes and sketches allow the wanted similarity."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = ("n_a", "n_b", "sketch_a", "sketch_b")
            n_a, n_b, s_a, s_b = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)
            odd = np.bitwise_count(sketch_words(s_a) ^ sketch_words(s_b)).sum(axis=1)
            keep = scheme.sizes_agree(np.array(n_a), np.array(n_b)) & scheme.may_be_similar(odd)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    own = signatures.select("id", "n_shingles", "sketch")
    for end in "ab":
        side = own.select(F.col("id").alias(end), F.col("n_shingles").alias(f"n_{end}"),
                          F.col("sketch").alias(f"sketch_{end}"))
        links = links.join(side, end)
    return links.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(close, "a long, b long")


def confirmed(links: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """Links whose full shingle sets have the wanted similarity."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            keep = [scheme.similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for end in "ab":
        links = links.join(sets.select(F.col("id").alias(end), F.col("shingle_set").alias(f"set_{end}")), end)
    return links.select("a", "b", "set_a", "set_b").mapInArrow(similar, "a long, b long")


def open_blocks(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of buckets that hold several groups, dealt to pairs of blocks (``key``, ``i``, ``j``).

    Members outside the bucket's largest known group come in the first blocks, which meet all blocks;
    those inside it come in the later ones, which meet only the first. Buckets with the same members count once.
    """
    grouped = members.join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    several = stored(
        grouped.groupBy("key")
        .agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"),
            F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("print"), F.bit_xor(F.xxhash64("id")).alias("print_xor"),
        )
        # The only pair of a bucket of two has been tried as a link to its hub.
        .filter("low <> high and size > 2")
        .groupBy("size", "print", "print_xor")
        .agg(F.min("key").alias("key"))
        .select("key", "size"),
        "open-buckets",
    )
    counted = stored(
        grouped.join(several, "key")
        .groupBy("key", "component")
        .agg(F.count("*").alias("n"), F.first("size").alias("size"))
        .groupBy("key")
        .agg(F.max(F.struct("n", "component")).alias("main"), F.first("size").alias("size"))
        .select(
            "key",
            F.col("main")["component"].alias("main"),
            F.ceil((F.col("size") - F.col("main")["n"]) / BLOCK).cast("int").alias("outer"),
            F.ceil(F.col("main")["n"] / BLOCK).cast("int").alias("inner"),
        ),
        "counted-buckets",
    )
    return (
        grouped.join(counted, "key")
        .withColumn("inside", F.col("component") == F.col("main"))
        .withColumn("at", F.pmod(F.xxhash64("id"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))))
        .withColumn("at", (F.col("at") + F.when(F.col("inside"), F.col("outer")).otherwise(0)).cast("int"))
        .withColumn(
            "other",
            F.explode(
                F.sequence(F.lit(0), F.when(F.col("inside"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)
            ),
        )
        .select("key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "id", "component")
    )


@dataclass
class _Pair:
    """The members of a pair of blocks, as columns."""

    key: tuple[int, int, int]
    ids: np.ndarray
    parts: np.ndarray
    sizes: np.ndarray
    sketches: np.ndarray
    sets: list[bytes]

    def candidates(self, scheme: Scheme) -> np.ndarray:
        """Which members may be similar although their groups differ, as a square of booleans."""
        odd = np.zeros((len(self.ids), len(self.ids)), np.uint16)
        for word in self.sketches.T:
            odd += np.bitwise_count(word[:, None] ^ word[None, :])
        return (
            scheme.may_be_similar(odd)
            & (self.parts[:, None] != self.parts[None, :])
            & scheme.sizes_agree(self.sizes[:, None], self.sizes[None, :])
        )


PAIR_KEY = ("key", "i", "j")


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Pair]:
    """Pairs of blocks of a stream that is sorted by ``PAIR_KEY``; each is small, so many share a batch."""
    left: list[list] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in (*PAIR_KEY, "id", "component", "n_shingles")]
        columns.append(sketch_words(batch.column("sketch").to_pylist()))
        columns.append(batch.column("shingle_set").to_pylist() if "shingle_set" in batch.schema.names else [b""] * batch.num_rows)
        if left is not None:
            columns = [x + y if isinstance(y, list) else np.concatenate([x, y]) for x, y in zip(left, columns)]
        changes = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
        ends = [*(np.flatnonzero(changes) + 1).tolist()]
        start = 0
        for end in ends:
            yield _pair([c[start:end] for c in columns])
            start = end
        left = [c[start:] for c in columns]
    if left is not None:
        yield _pair(left)


def _pair(columns: list) -> _Pair:
    return _Pair(tuple(int(c[0]) for c in columns[:3]), *columns[3:])


def links_across_groups(units: Units, blocks: DataFrame, signatures: DataFrame, scheme: Scheme) -> DataFrame:
    """Confirmed links between members of different groups; enough of them to join whatever belongs together.

    Where sketches leave few pairs of two blocks, the pairs are sent: the same
    pair comes from many buckets and is confirmed once. Where they leave many,
    the members are sent and compared in place, so what is sent stays in proportion to the members.
    """
    most_pairs = PAIRS_PER_MEMBER

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for pair in _pairs_of_blocks(batches):
            candidates = pair.candidates(scheme)
            x, y = np.nonzero(np.triu(candidates))
            if not len(x):
                continue
            if len(x) <= most_pairs * len(pair.ids):
                ends = np.sort(np.stack([pair.ids[x], pair.ids[y]]), axis=0)
                rows += [(a, b, None, *pair.key) for a, b in zip(*ends.tolist())]
            else:
                kept = candidates.any(axis=1)
                rows += [(a, None, part, *pair.key) for a, part in zip(pair.ids[kept].tolist(), pair.parts[kept].tolist())]
            if len(rows) >= 10_000:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["a", "b", "component", *PAIR_KEY])

    def joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _pairs_of_blocks(batches):
            parts, ids, found = pair.parts.tolist(), pair.ids.tolist(), []
            sets = [np.frombuffer(s, np.uint64) for s in pair.sets]
            for x, y in np.argwhere(np.triu(pair.candidates(scheme))).tolist():
                if parts[x] != parts[y] and scheme.similar(sets[x], sets[y]):
                    found.append((ids[x], ids[y]))
                    old, new = parts[y], parts[x]
                    parts = [new if p == old else p for p in parts]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    def sorted_by_pair(frame: DataFrame) -> DataFrame:
        return frame.repartition(*PAIR_KEY).sortWithinPartitions(*PAIR_KEY)

    own = signatures.select("id", "n_shingles", "sketch")
    members = blocks.join(own, "id").select(*PAIR_KEY, "id", "component", "n_shingles", "sketch")
    left = stored(
        sorted_by_pair(members).mapInArrow(possible, "a long, b long, component long, key long, i int, j int"), "open-pairs"
    )
    if left.isEmpty():
        return left.select("a", "b")
    pairs = left.filter("b is not null").select("a", "b").distinct()
    dense = left.filter("b is null").withColumnRenamed("a", "id").drop("b")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(dense.select("id")).distinct()
    sets = stored(shingle_sets(units, wanted), "shingle-sets")
    links = confirmed(pairs, sets, scheme)
    if dense.isEmpty():
        return links
    return links.union(sorted_by_pair(dense.join(own, "id").join(sets, "id")).mapInArrow(joining, "a long, b long"))


def near_groups(units: DataFrame | Units, scheme: Scheme, unique_ids: bool = False) -> DataFrame:
    """``id``, ``n_shingles`` and ``component`` of every unit (``id`` not null, ``text``).

    ``component`` is the smallest id that confirmed links and equal sets
    reach; a unit without words is alone. Rows that repeat an id are one unit
    with the greatest of its texts, and there is one result row for each of
    them; ``unique_ids`` says that there are none. Tables in between are deleted.
    """
    units = units if isinstance(units, Units) else Units(units)
    spark = units.rows.sparkSession
    with scratch(spark), small_batches(spark):
        return stored(_grouped(units, scheme, unique_ids), "near-groups", outlives=True)


def _grouped(units: Units, scheme: Scheme, unique_ids: bool) -> DataFrame:
    rows = units.rows
    if not unique_ids and not rows.groupBy("id").count().filter("count > 1").isEmpty():
        single = stored(rows.groupBy("id").agg(F.max("text").alias("text")), "units")
        return rows.select("id").join(_grouped(replace(units, rows=single), scheme, unique_ids=True), "id")
    signatures = stored(signed(units, scheme), "signatures")
    # Joins with a hot key are split only if the other side is not grouped in the same stage, so it is stored first.
    equal = stored(
        signatures.filter("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("n"))
        .filter("n > 1").drop("n"),
        "equal-sets",
    )
    nodes = stored(
        signatures.select("id", "n_shingles", "digest").join(equal, "digest", "left")
        .select("id", "n_shingles", F.coalesce("node", "id").alias("node")),
        "nodes",
    )
    members = buckets(nodes, signatures)
    tried = stored(sifted(hub_links(members), signatures, scheme), "tried-links")
    ends = tried.select(F.col("a").alias("id")).union(tried.select("b"))
    sets = stored(shingle_sets(units, ends), "shingle-sets")
    links = stored(confirmed(tried, sets, scheme), "links")
    groups = components(links)
    across = stored(links_across_groups(units, open_blocks(members, groups), signatures, scheme), "more-links")
    if not across.isEmpty():
        groups = components(links.union(across))
    return nodes.join(groups.withColumnRenamed("id", "node"), "node", "left").select(
        "id", "n_shingles", F.coalesce("component", "node").alias("component")
    )

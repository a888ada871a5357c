"""Steps that several of these operators share: hashing, components, links inside buckets."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineferry import session
from lineferry.session import configure, drop

__all__ = [
    "Hashes", "arrow_map", "components", "link_buckets", "materialize", "mix", "named", "prepare", "read", "shingles", "unused", "word_hashes", "words",
]

#: Rows of an Arrow batch. Texts can be long, so batches are kept short rather than wide.
BATCH_ROWS = "512"
#: Pivots that each bucket takes in the first of its later rounds, and by how many times more in each next one.
PIVOTS, GROWTH = 4, 32


def prepare(spark: SparkSession) -> SparkSession:
    """Run-time settings of these operators."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` of a function that yields columns by name."""
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in (columns[n] for n in names)]
            yield from pa.table(arrays, names=names).to_batches()

    return df.mapInArrow(run, schema)


def unused(df: DataFrame, *names: str) -> dict[str, str]:
    """A working name for each of ``names`` that no column of ``df`` has, in upper or lower case."""
    taken, head = {c.lower() for c in df.columns}, "_"
    while any((head + n).lower() in taken for n in names):
        head += "_"
    return {n: head + n for n in names}


def named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def release(spark: SparkSession) -> None:
    """Lets go of what finished steps left on the executors' disks.

    Spark drops the shuffle files of plans that nobody holds any more when the driver collects its
    garbage, which a driver with little to do would rarely come to.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, and nothing else left of its making."""
    table = session.materialize(df)
    release(df.sparkSession)
    return table


# --- words and hashes -------------------------------------------------------------------------


def words(text: str | None) -> list[bytes]:
    """Runs of anything but space and the controls 9 to 13, A-Z in lower case."""
    return text.encode().lower().split() if text else []


class Hashes(dict):
    """64-bit hash by word; forgets everything when ``most`` words are held."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


#: Bytes by their small letter, and those that separate words.
SMALL = np.frombuffer(bytes(range(256)).lower(), np.uint8)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, as in :class:`Hashes`, of the :func:`words` of all texts, and where those of each text end; distinct words are hashed once."""
    filled = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    said = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = ~BLANK[said]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < len(said)]
    first[begins] = inside[begins]
    # Words one behind the other, without the blanks.
    bare = SMALL[said[inside]]
    cuts = np.r_[np.flatnonzero(first[inside]), len(bare)]
    each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(bare)]).dictionary_encode()
    distinct = each.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return hashes[each.indices.to_numpy()], np.r_[0, np.cumsum(first)][at[1:]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; of fewer words the whole sequence is one."""
    n = min(size, len(h))
    if n == 0:
        return h
    out = mix(h[: len(h) - n + 1] + np.uint64(n))
    for j in range(1, n):
        out = mix(out + h[j : len(h) - n + 1 + j])
    return out


# --- components -------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``links(a, b)``; a component is its smallest node.

    Each round moves every node's larger neighbours to the smallest node it sees, then every node
    to the smallest of its smaller neighbours, until nothing moves: a logarithmic number of rounds,
    each an aggregation and a join that can split hot nodes, written to the shared folder. The table
    of the round before is deleted.
    """
    links = links.where("a is not null and b is not null and a <> b")
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while seen != (now := _digest(edges)):
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        drop(before)
    roots = edges.select("v", F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def labelled(df: DataFrame, comps: DataFrame, node: str, out: str) -> DataFrame:
    """``df`` with each node's component, the node itself where it has no link."""
    named = comps.select(F.col("node").alias(node), F.col("component").alias("_c"))
    return df.join(named.hint("merge"), node, "left").withColumn(out, F.coalesce("_c", node)).drop("_c")


def link_buckets(
    members: DataFrame,
    details: DataFrame,
    contents: Callable[[DataFrame], DataFrame],
    compare: Callable[[DataFrame], DataFrame],
    reach: float,
    may: Callable[[str, str], Column],
    marks: tuple[str, ...] = (),
    close: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """Links ``a, b`` between members of common buckets, enough of them for the right components.

    ``members(key, id)`` has each bucket's members. ``contents(ids)`` gives what is compared, ``id`` and
    further columns, for the members of buckets that are shared; it is asked once and written.
    ``may`` is a condition on the columns that ``details`` has beside ``id``, of two members, that every
    link meets; only members of shared buckets are joined to them. ``close`` is another such condition, on
    the columns ``marks`` of the contents, which are not compared; only members that the rounds measure
    carry them. ``compare`` adds to pairs with the contents of both, as ``x_`` and ``y_`` columns, ``dist`` (a metric) and
    ``linked``, which holds only where dist <= reach.

    Not all pairs of a bucket are made. First each member is measured against the bucket's smallest
    id, which joins a group of copies whatever its size. Then only members that this left in another
    component than the smallest id's are measured against the members of other components, but for
    those that ``may`` and the triangle inequality rule out: where both distances to the smallest id
    are known, they differ by no more than ``reach`` if there is a link. A round takes a few such
    members of each bucket as pivots, drawn by a hash of their ids, so that members of the same buckets
    have the same pivots; what they join leaves fewer for the next round, which takes several times as
    many. Members that meet in several buckets are measured in the one of the smallest key. So rounds are a logarithm of the largest bucket's size, and no two members of a bucket that
    are linked end in different components. Joins exchange both sides at every size. A written table of
    ``members`` is deleted when it has been read.
    """
    # Most buckets have one member: they are told apart by two numbers each before more is moved.
    crowded = members.groupBy("key").agg(F.min("id").alias("x_id"), F.max("id").alias("_top")).where("x_id < _top").drop("_top")
    carried = [c for c in details.columns if c != "id"]
    shared = materialize(members.join(crowded.hint("merge"), "key").join(details.hint("merge"), "id"))
    drop(members)
    known = materialize(contents(shared.select("id").distinct()))

    def measure(pairs: DataFrame) -> DataFrame:
        """Pairs ``a, b`` and more columns, compared and written."""
        asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        part = known.join(asked.hint("merge"), "id", "left_semi")
        fields = [c for c in known.columns if c != "id" and c not in marks]
        x = part.select(F.col("id").alias("a"), *[F.col(c).alias(f"x_{c}") for c in fields])
        y = part.select(F.col("id").alias("b"), *[F.col(c).alias(f"y_{c}") for c in fields])
        return materialize(compare(pairs.hint("merge").join(x, "a").hint("merge").join(y, "b")).select(*pairs.columns, "dist", "linked"))

    low = shared.where("id = x_id").select("key", *[F.col(c).alias(f"x_{c}") for c in carried]).dropDuplicates(["key"])
    star = shared.where("id <> x_id").select("key", "x_id", *[F.col(c).alias(f"y_{c}") for c in ("id", *carried)]).join(low.hint("merge"), "key")
    pairs = materialize(star.where(may("x_", "y_")).select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct())
    first = measure(pairs)
    drop(pairs)
    links = [first.where("linked").select("a", "b")]
    comps = materialize(components(links[0]))
    # An id may have several contents; then its distance rules nothing out.
    dists = first.groupBy(F.col("a").alias("x_id"), F.col("b").alias("id")).agg(F.when(F.count("*") == 1, F.min("dist")).alias("dist"))
    far = shared.where("id <> x_id").join(dists.hint("merge"), ["x_id", "id"], "left").withColumn("used", F.lit(False))
    far = labelled(labelled(far, comps, "id", "comp"), comps, "x_id", "main").drop("x_id")
    before, pivots, own = [shared, comps], PIVOTS, []
    while True:
        # Buckets in which nothing is apart any more have been done with.
        apart = F.expr("comp <> main and not used")
        left = far.groupBy("key").agg(F.count_if(apart).alias("n_apart")).where("n_apart > 0")
        drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * F.col("n_apart") < F.lit(pivots << 20)
        now = materialize(far.join(left.hint("merge"), "key").withColumn("pivot", apart & drawn).drop("n_apart"))
        for table in before:
            drop(table)
        if now.isEmpty():
            break
        if not own:
            # A bucket that is done with joins all of its members: the others tell where two of them meet first.
            own, bare = ["_keys", *marks], now
            keys = bare.groupBy("id").agg(F.collect_set("key").alias("_keys"))
            now = bare.join(keys.hint("merge"), "id").join(known.select("id", *marks).distinct().hint("merge"), "id")
            now = materialize(now)
            drop(bare)
        fields = ["id", "comp", "dist", *carried, *own]
        x = now.where("pivot").select("key", *[F.col(c).alias(f"x_{c}") for c in fields])
        y = now.where("not used").select("key", *[F.col(c).alias(f"y_{c}") for c in fields])
        near = F.coalesce(F.abs(F.col("x_dist") - F.col("y_dist")) <= reach + 1e-9, F.lit(True))
        ends = [F.when(F.col("x_id") < F.col("y_id"), F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}")) for p, q in ("xy", "yx") for c in ("id", "comp")]
        wanted = F.expr("x_comp <> y_comp") & near & may("x_", "y_")
        if close is not None:
            wanted &= close("x_", "y_")
        rest = x.join(y.hint("merge"), "key").where(wanted & F.expr("key = array_min(array_intersect(x__keys, y__keys))"))
        rest = materialize(rest.select(*[e.alias(n) for e, n in zip(ends, ("a", "ca", "b", "cb"), strict=True)]).distinct())
        far = now.withColumn("used", F.expr("used or pivot")).drop("pivot")
        before = [now, rest]
        if not rest.isEmpty():
            done = measure(rest)
            links.append(done.where("linked").select("a", "b"))
            # Only what the new links join changes its component.
            moved = materialize(components(done.where("linked").select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
            far = labelled(labelled(far, moved, "comp", "_comp"), moved, "main", "_main")
            far = far.drop("comp", "main").withColumnsRenamed({"_comp": "comp", "_main": "main"})
            before.append(moved)
        pivots *= GROWTH
    drop(known)
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out

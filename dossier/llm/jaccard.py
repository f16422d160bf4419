"""N-gram Jaccard self-join by filtering under several global token orders.

Texts with equal shingle sets are one class.  A class's tokens are 64-bit
shingle hashes.  Two classes can only be similar if their prefixes share
tokens under *every* global order, so filters under several orders are
intersected before any pair is verified:

1.  Order by hash.  Prefixes lengthened by some tokens must share that many;
    a class whose prefix has fewer tokens in common with others is out.  This
    needs only a fifth of all tokens, and is where most texts end.
2.  Order by rarity among the classes left.  A class with more tokens of its
    own than a similar partner allows is out.
3.  Pairs come from the postings of the rarity order, with position and
    length filters, and must share a prefix token under two further orders.

Posting lists are never squared in rows.  In each list the most central class
is compared with the others; links join components, and what is left outside
the centre's component is compared again.  What is apart in the end is
compared exactly: in short lists by pairs, in long ones by blocks of BLOCK
classes, a task for two blocks, which returns a spanning forest of the links
that it finds.  So a group of near copies costs a few rows a member, and no
link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .shared import Membership, discard, salted_join, store
from .words import WHITE, blocks, gram_sets, mix

#: Fixed salts of the token orders.
SALT_A, SALT_B, SALT_SET, SALT_SET2 = 0x51ED270B, 0x2545F491, 0x9E6C63D0, 0x68E31DA4
#: Rounds in which lists are compared with their centres before what is left is paired.
CENTRE_ROUNDS = 3
#: Lists of more classes are compared by blocks of BLOCK classes.
SHORT_LIST, BLOCK, COLUMNS = 48, 1024, 2048


class Spec:
    """Shingle length and threshold: similar means 100 * intersection >= percent * union."""

    def __init__(self, n: int = 5, percent: int = 80):
        self.n, self.percent = n, percent

    def least(self, size):
        """The smallest overlap of a set of this size with a similar one; also the smallest similar set."""
        return -(-self.percent * size // 100)

    def extra(self, size):
        """Tokens by which a prefix is lengthened, and so must share at least (one more than a twentieth)."""
        return 1 + size // 20

    def prefix(self, size):
        return np.minimum(size, size - self.least(size) + self.extra(size))

    def least_col(self, size: Column) -> Column:
        return F.ceil(size * self.percent / 100).cast("int")


def _sets(batch: pa.RecordBatch, spec: Spec) -> Iterator[tuple[int, np.ndarray]]:
    for block in blocks(batch.column("text"), WHITE, True):
        yield from gram_sets(block, spec.n)


def _print(tokens: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set."""
    return tuple(int(mix(tokens, salt).sum(dtype=np.uint64).astype(np.int64)) for salt in (SALT_SET, SALT_SET2))


def signatures(docs: DataFrame, spec: Spec) -> DataFrame:
    """doc_id, set size and the set's fingerprint for every row."""

    def task(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[i], len(s), *_print(s)) for i, s in _sets(batch, spec)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int64(), pa.int64()])], names=["doc_id", "n_shingles", "fp", "fp2"])

    return store(docs.select("doc_id", "text").mapInArrow(task, "doc_id bigint, n_shingles int, fp bigint, fp2 bigint"), "jaccard-signatures")


def hash_prefixes(docs: DataFrame, spec: Spec) -> DataFrame:
    """token and class (first half of the fingerprint) of every lengthened prefix under the hash order."""

    def task(batches):
        seen = set()  # copies in a task are posted once
        for batch in batches:
            tokens, owners = [], []

            def flush():
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat([o for o, _ in owners], [k for _, k in owners]).astype(np.int64))], names=["token", "fp"])

            held = 0
            for _, s in _sets(batch, spec):
                if len(s) and (fp := _print(s)[0]) not in seen:
                    seen.add(fp)
                    k = int(spec.prefix(len(s)))
                    tokens.append(s[:k])  # sets are sorted by hash
                    owners.append((fp, k))
                    held += k
                    if held > 200_000:
                        yield flush()
                        tokens, owners, held = [], [], 0
            if owners:
                yield flush()

    return docs.select("text").mapInArrow(task, "token bigint, fp bigint")


def survivors(docs: DataFrame, spec: Spec) -> DataFrame:
    """fp of the classes that may have a similar one, by the first filter."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posted = hash_prefixes(docs, spec).repartition(parts, "token").groupBy("token", "fp").agg(F.lit(1).alias("one"))
    by_token = Window.partitionBy("token")
    shared = posted.withColumn("low", F.min("fp").over(by_token)).withColumn("high", F.max("fp").over(by_token)).where("low <> high")
    return store(shared.groupBy("fp").agg(F.count("*").alias("shared")), "jaccard-shared")


def class_sets(docs: DataFrame, keep: DataFrame, spec: Spec) -> DataFrame:
    """rep (smallest doc_id), fp, size and the whole sorted set of every class in keep (fp, rep); a task sends the set of copies once."""
    member = Membership(keep, "fp")

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["fp", "n", "tokens"])

    def task(batches):
        seen = set()
        for batch in batches:
            rows, held = [], 0
            for _, s in _sets(batch, spec):
                if len(s):
                    fp = _print(s)[0]
                    if fp not in seen and member.has(np.array([fp], np.int64))[0]:
                        seen.add(fp)
                        rows.append((fp, len(s), s.view(np.int64)))
                        held += len(s)
                if held > 500_000:
                    yield pack(rows)
                    rows, held = [], 0
            if rows:
                yield pack(rows)

    found = docs.select("text").mapInArrow(task, "fp bigint, n int, tokens array<bigint>")
    first = found.groupBy("fp").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    return store(first.join(keep, "fp"), "jaccard-sets")


def central(classes: DataFrame, spec: Spec) -> DataFrame:
    """The classes left by the second filter: rep, n, own (tokens no other class has) and the shared tokens, rarest first."""
    posted = classes.select("rep", "n", F.explode("tokens").alias("token"))
    by_token = Window.partitionBy("token")
    common = posted.withColumn("df", F.count("*").over(by_token)).where("df > 1")
    ordered = common.groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))
    left = ordered.select("rep", "n", (F.col("n") - F.size("s")).alias("own"), F.col("s.token").alias("tokens"))
    return store(left.where(F.size("tokens") >= spec.least_col(F.col("n"))), "jaccard-central")


def postings(classes: DataFrame, spec: Spec) -> DataFrame:
    """token, rep, n and pos of the prefixes under the rarity order, where a class's own tokens come first."""
    width = F.col("n") - spec.least_col(F.col("n")) + 1 - F.col("own")
    return store(classes.select("rep", "n", "own", F.posexplode(F.slice("tokens", 1, F.greatest(width, F.lit(0)))).alias("i", "token")).select("token", "rep", "n", (F.col("own") + F.col("i")).alias("pos")), "jaccard-postings")


def _possible(spec: Spec, a: str, b: str) -> Column:
    """Length and position filters for postings a and b of one token."""
    need = F.ceil(spec.percent * (F.col(f"{a}.n") + F.col(f"{b}.n")) / (100 + spec.percent))
    most = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos")) + F.least(F.col(f"{a}.pos"), F.col(f"{b}.pos"))
    return (100 * F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= spec.percent * F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))) & (most >= need)


def further_orders(classes: DataFrame, spec: Spec) -> DataFrame:
    """rep and the prefixes a and b of every class under two further orders, by 32 bits of their tokens, which is enough to rule a pair out."""

    def task(batches):
        for batch in batches:
            rep, n, own = (batch.column(c).to_numpy() for c in ("rep", "n", "own"))
            tokens = batch.column("tokens")
            prefixes = [[_prefix(tokens[i].values.to_numpy(), n[i], own[i], spec, salt).astype(np.uint32).view(np.int32) for i in range(len(rep))] for salt in (SALT_A, SALT_B)]
            yield pa.RecordBatch.from_arrays([pa.array(rep), *[pa.array(p, pa.list_(pa.int32())) for p in prefixes]], names=["rep", "a", "b"])

    return store(classes.select("rep", "n", "own", "tokens").mapInArrow(task, "rep bigint, a array<int>, b array<int>"), "jaccard-orders")


def verify(pairs: DataFrame, orders: DataFrame, classes: DataFrame, spec: Spec) -> DataFrame:
    """The pairs (a, b) that share a prefix token under both further orders too, and of these the similar ones; whole sets meet only for those."""
    prefix = lambda x: orders.select(F.col("rep").alias(x), F.col("a").alias(f"{x}1"), F.col("b").alias(f"{x}2"))
    candidates = pairs.join(prefix("a"), "a").join(prefix("b"), "b").where(F.arrays_overlap("a1", "b1") & F.arrays_overlap("a2", "b2")).select("a", "b")
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    both = candidates.join(side("a"), "a").join(side("b"), "b")

    def task(batches):
        for batch in batches:
            a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
            ta, tb = batch.column("ta"), batch.column("tb")
            common = np.array([len(np.intersect1d(ta[i].values.to_numpy(), tb[i].values.to_numpy(), True)) for i in range(len(a))], np.int64)
            good = 100 * common >= spec.percent * (na + nb - common)
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return both.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(task, "a bigint, b bigint")


def _prefix(tokens: np.ndarray, n: int, own: int, spec: Spec, salt: int) -> np.ndarray:
    """The tokens of the prefix under a further order, in which a class's own tokens come first too."""
    width = n - spec.least(n) + 1 - own
    if width <= 0:
        return tokens[:0]
    scrambled = mix(tokens.view(np.uint64), salt)
    return np.partition(scrambled, width - 1)[:width] if width < len(scrambled) else scrambled


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set on the left has in common with each on the right."""
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    values = [np.concatenate([np.empty(0, np.uint64), *[x.view(np.uint64) for x in side]]) for side in (left, right)]
    shared = np.intersect1d(values[0], values[1])
    out = np.zeros((len(left), len(right)), np.float32)
    placed = []
    for side, v in zip(sizes, values):
        at = np.searchsorted(shared, v)
        at[at == len(shared)] = 0
        here = np.flatnonzero(shared[at] == v) if len(shared) else np.empty(0, np.int64)
        placed.append((np.repeat(np.arange(len(side)), side)[here], at[here]))
    for first in range(0, len(shared), COLUMNS):
        part = []
        for side, (row, column) in zip(sizes, placed):
            some = (column >= first) & (column < first + COLUMNS)
            m = np.zeros((len(side), min(COLUMNS, len(shared) - first)), np.float32)
            m[row[some], column[some] - first] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that keep the components of a boolean matrix of links."""
    edges, rows, columns = [], np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool)
    for start in range(len(rows)):
        if not rows[start]:
            continue
        rows[start], queue = False, [(0, start)]
        while queue:
            side, i = queue.pop()
            near = np.flatnonzero((linked[i] & columns) if side == 0 else (linked[:, i] & rows))
            (columns if side == 0 else rows)[near] = False
            edges += [(i, int(j)) if side == 0 else (int(j), i) for j in near]
            queue += [(1 - side, int(j)) for j in near]
    return edges


def block_links(now: DataFrame, apart: DataFrame, classes: DataFrame, spec: Spec) -> DataFrame:
    """Links (a, b) of the classes apart in long lists with all classes of the list, found by blocks."""

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("token").orderBy("rep")) - 1) / BLOCK).cast("int"))

    left, right = numbered(apart), numbered(now.join(apart.select("token").distinct(), "token", "left_semi"))
    count = lambda rows, name: rows.groupBy("token").agg((F.max("block") + 1).alias(name))
    sizes = count(left, "lefts").join(count(right, "rights"), "token")
    spread = lambda rows, other, mine, theirs: rows.join(sizes, "token").select("token", "rep", "comp", F.col("block").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs))
    both = spread(left, "rights", "i", "j").withColumn("side", F.lit(0)).unionByName(spread(right, "lefts", "j", "i").withColumn("side", F.lit(1)))
    full = both.join(classes.select("rep", "n", "own", "tokens"), "rep").select("token", "i", "j", "side", "rep", "comp", "n", "own", "tokens")

    def task(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy()
        order = [np.flatnonzero(side == k) for k in (0, 1)]
        rep, comp, n, own = (group[c].to_numpy() for c in ("rep", "comp", "n", "own"))
        tokens = group["tokens"].combine_chunks()
        sets = [[tokens[int(k)].values.to_numpy() for k in o] for o in order]
        a, b = order
        may = comp[a][:, None] != comp[b]
        for salt in (SALT_A, SALT_B):
            prefixes = [[_prefix(x, n[k], own[k], spec, salt) for x, k in zip(part, o)] for part, o in zip(sets, order)]
            if may.any():
                may &= overlaps(*prefixes) > 0
        found = []
        if may.any():
            common = overlaps(*sets).round().astype(np.int64)
            found = forest(may & (100 * common >= spec.percent * (n[a][:, None] + n[b] - common)))
        x, y = rep[a[[e[0] for e in found]]], rep[b[[e[1] for e in found]]]
        return pa.table({"a": pa.array(np.minimum(x, y).astype(np.int64)), "b": pa.array(np.maximum(x, y).astype(np.int64))})

    return full.groupBy("token", "i", "j").applyInArrow(task, "a bigint, b bigint").distinct()


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def links(classes: DataFrame, spec: Spec) -> DataFrame:
    """Links (a, b) between classes that give the same components as all links would."""
    posted, orders = postings(classes, spec), further_orders(classes, spec)
    spark = classes.sparkSession
    found = spark.createDataFrame([], "a bigint, b bigint")
    labels = spark.createDataFrame([], "node bigint, component bigint")
    for turn in range(CENTRE_ROUNDS + 1):
        now = store(posted.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component"), "jaccard-now")
        # the centre: of the list's classes, that with the fewest tokens before this one
        centre = F.min(F.struct("pos", "rep", "n", "comp")).alias("c")
        fields = ["token", F.col("c.rep").alias("rep"), F.col("c.n").alias("n"), F.col("c.pos").alias("pos"), F.col("c.comp").alias("comp")]
        lists = now.groupBy("token").agg(centre, F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low <> high").select(*fields, "size")
        apart = now.alias("m").join(lists.alias("h"), "token").where("m.comp <> h.comp")
        if turn == 0:
            pairs = store(_pairs(apart.where(_possible(spec, "m", "h")), "m.rep", "h.rep"), "jaccard-pairs")
            new, used = verify(pairs, orders, classes, spec), [now, pairs]
        else:
            apart = store(apart.select("token", "m.rep", "m.n", "m.pos", "m.comp", "h.size"), "jaccard-apart")
            last = turn == CENTRE_ROUNDS
            # a further centre among those outside against the whole list; in the end all of them, in short lists by pairs
            second = apart.where(F.col("size") <= SHORT_LIST) if last else apart.groupBy("token").agg(centre).select(*fields)
            pairs = _pairs(second.alias("s").join(now.alias("m"), "token").where("m.comp <> s.comp").where(_possible(spec, "m", "s")), "m.rep", "s.rep")
            pairs = store(pairs, "jaccard-pairs")
            new, used = verify(pairs, orders, classes, spec), [now, pairs, apart]
            if last:
                new = new.unionByName(block_links(now, apart.where(F.col("size") > SHORT_LIST).drop("size"), classes, spec))
        new = store(new, "jaccard-links")
        discard(*used)
        if not new.isEmpty():
            found = store(found.union(new), "jaccard-found")
            if turn < CENTRE_ROUNDS:
                labels = components(found)
    discard(posted, orders)
    return found


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) for every row of docs.

    Words are lower-cased (A-Z) and split at ASCII white space.  A text with
    fewer words than a shingle is one shingle; a null or empty text, or one of
    white space, has none and is linked with nothing.  A row with a null
    doc_id is returned with a null component unless copies have an id.
    Repeated rows come back as often as they are there.  Columns other than
    doc_id and text are not read.  At 80 % and more, sets of up to four
    shingles are only similar if equal.
    """
    spec = Spec(n, percent)
    signed = signatures(docs, spec)
    filled = signed.where("n_shingles > 0")
    first = filled.groupBy("fp", "fp2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"))
    classes = store(first, "jaccard-classes")
    shared = survivors(docs, spec)
    size = F.col("n").cast("int")
    least = F.greatest(F.lit(1), F.lit(1) + F.floor(spec.least_col(size) / 20).cast("int"))
    keep = classes.join(shared, "fp").where(F.col("shared") >= least).groupBy("fp").agg(F.min("rep").alias("rep")).where("rep IS NOT NULL")
    left = central(class_sets(docs, store(keep, "jaccard-keep"), spec), spec)
    labels = components(links(left, spec))
    owners = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "fp2", "rep", "copies", F.coalesce("component", "rep").alias("component_id"))
    # only copies and linked classes need to be told; a class with many copies is dealt to several tasks
    told = owners.where((F.col("copies") > 1) | ~F.col("component_id").eqNullSafe(F.col("rep"))).select("fp", "fp2", "component_id")
    return salted_join(signed, told, ["fp", "fp2"], "doc_id", "left").select(
        "doc_id",
        F.col("n_shingles").cast("bigint").alias("n_shingles"),
        F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )

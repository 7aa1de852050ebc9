"""MinHash near-duplicates by an inverted join of signature coordinates.

Each document's set of word shingles gets a signature of COORDINATES minima. Documents are posted under each pair
of coordinate and value; two documents collide once for each equal coordinate, and a pair with at least MATCHES
collisions is compared on its full sets.

*Prefix.* Values that one document holds alone are no postings at all, and a document with fewer than MATCHES
postings left has no partner. The rest are put in order of rising frequency; two documents with MATCHES common
postings share one among all but the last MATCHES-1 of either, so only these are joined.

*Skip.* Counting within a posting list skips what is decided: first each list's members meet its most connected
member only (the sum of its postings' frequencies), and linked documents merge into components; afterwards a list
counts only pairs whose components differ, in blocks of bounded size, with bit-exact collision counts, a length
bound, and each pair at its first common posting only; documents with such a pair get their full sets, and a block
gives the links that connect its documents, never its pairs. Lists in a single component are skipped whole. No list
is cut short, so no link is lost but for what MinHash itself misses: a pair
at a similarity of just 0.8 has fewer than 13 of 32 collisions with a probability of 2e-7.

Documents with equal sets are one class before anything else, found by a 128-bit digest; classes have numbers of their
own, so that rows of one id may have unlike texts. Nothing is collected to the driver. Joins on hot keys are
sort-merge joins whose large partitions adaptive execution splits; a hot posting list is cut in blocks: members of its
most connected member's component and all others are dealt out to chunks of CHUNK / 2 on average, and a block holds
two chunks of which at least one is of the others.

Defined results: null and empty texts have no shingles and no links; null ids are never linked and are kept; repeated
rows of an id get equal results, rows of one id with unlike texts are linked each by its own text; ties go to the
smaller id; an empty table gives an empty one; texts are read whole however long; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.byte_words import BASE, mix, pieces, words
from foliant.llm.components import components
from foliant.llm.scratch import Scratch
from foliant.llm.skew import with_counted
from foliant.llm.vocabularies import release_memos
from foliant.sources.tables import table

COORDINATES = 32
MATCHES = 13
#: Members of a posting list that are compared at once; two chunks of a longer list hold about as many.
CHUNK = 1024

_G = np.random.Generator(np.random.PCG64(7))
_A = _G.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _G.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, text by text, and n+1 offsets into them.

    A text of fewer words than *width*, but not of none, has its whole sequence as one shingle.
    """
    _, _, row, h = words(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    total = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        total = total * BASE + h[j : j + len(total)]
    good = row[: len(total)] == row[width - 1 :] if len(total) else np.zeros(0, bool)
    value, owner = mix(total[good]), row[: len(total)][good]
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for j in range(width - 1):
            has = count[few] > j
            short[has] = short[has] * BASE + h[first[few][has] + j]
        value = np.concatenate((value, mix(short + count[few].astype(np.uint64))))
        owner = np.concatenate((owner, few))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


def signatures(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The minima of each non-empty set's hashes, as int32."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), COORDINATES), np.uint32)
    for j in range(COORDINATES):
        out[:, j] = np.minimum.reduceat((value * _A[j] + _B[j]) >> np.uint64(32), starts)
    return out.view(np.int32)


def _digests(value: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each set of hashes, none of them empty."""
    return [np.add.reduceat(mix(value ^ salt), starts).view(np.int64) if len(starts) else np.zeros(0, np.int64) for salt in (BASE, ~BASE)]


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """Id, number of shingles, digest and signature of each document."""

    def run(batches):
        release_memos()
        for batch in batches:
            for at, end, data, offsets in pieces(batch.column(1)):
                value, bounds = shingles(data, offsets, width)
                n = np.diff(bounds)
                has = n > 0
                digests = _digests(value, bounds[:-1][has])
                sig = signatures(value, bounds) if has.any() else np.zeros((0, COORDINATES), np.int32)
                place = np.where(has, np.cumsum(has) - 1, -1)
                pick = pa.array(place, pa.int64(), mask=~has)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, COORDINATES), pa.int32()), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(n, pa.int64()), *[pa.array(d).take(pick) for d in digests], lists.take(pick)], names=["id", "n", "d1", "d2", "sig"])

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, sig array<int>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """The sets of the classes in ``found``, an array of class, d1, d2 beside each text, that a row's text belongs to."""

    def run(batches):
        release_memos()
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            for at, end, data, offsets in pieces(batch.column(0)):
                value, bounds = shingles(data, offsets, width)
                has = np.flatnonzero(np.diff(bounds))
                digests = dict(zip(has.tolist(), zip(*(d.tolist() for d in _digests(value, bounds[has])), strict=True), strict=True))
                got = [(i, c["id"]) for i in range(end - at) for c in wanted[at + i] if (c["d1"], c["d2"]) == digests.get(i)]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([c for _, c in got], pa.int64()), lists.take(pa.array([i for i, _ in got], pa.int64()))], names=["id", "set"])

    return docs.select("text", "found").mapInArrow(run, "id long, set array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """The pairs *a*, *b* whose full sets are similar enough."""
    b = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("_sb")), "b")
    both = b.join(sets.select(F.col("id").alias("a"), F.col("set").alias("_sa")), "a")
    common = F.size(F.array_intersect("_sa", "_sb"))
    return both.filter(ratio[1] * common >= ratio[0] * (F.size("_sa") + F.size("_sb") - common)).select("a", "b")


_ROW = "token long, block long, id long, comp long, n long, sig array<int>, posts array<long>, home boolean, probe boolean"


def _collisions(token: int, t: pa.Table, ratio: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block of a posting list that collide often enough and meet here first."""
    ids, comp, n = (t.column(c).to_numpy() for c in ("id", "comp", "n"))
    sig = pa.concat_arrays([c.flatten() for c in t.column("sig").chunks]).to_numpy().reshape(len(ids), -1)
    home, probe = t.column("home").to_numpy(zero_copy_only=False), t.column("probe").to_numpy(zero_copy_only=False)
    posts = t.column("posts").to_pylist()
    h, p, left, right = np.flatnonzero(home), np.flatnonzero(probe), [], []
    for at in range(0, len(p), 64):
        q = p[at : at + 64]
        ok = (comp[h][:, None] != comp[q][None]) & ((ids[h][:, None] < ids[q][None]) | ~probe[h][:, None])
        low, high = np.minimum(n[h][:, None], n[q][None]), np.maximum(n[h][:, None], n[q][None])
        ok &= low * ratio[1] >= high * ratio[0]
        i, j = np.nonzero(ok)
        for part in range(0, len(i), 1 << 16):
            x, y = h[i[part : part + (1 << 16)]], q[j[part : part + (1 << 16)]]
            same = (sig[x] == sig[y]).sum(axis=1) >= MATCHES
            for a, b in zip(x[same].tolist(), y[same].tolist(), strict=True):
                there = set(posts[b])
                if next(v for v in posts[a] if v in there) == token:
                    left.append(a)
                    right.append(b)
    return np.array(left, np.int64), np.array(right, np.int64)


def _spanning(t: pa.Table, left: np.ndarray, right: np.ndarray, ratio: tuple[int, int]) -> list[tuple[int, int]]:
    """Links among the pairs by their full sets; pairs that earlier links connect already are not looked at."""
    ids, comp = t.column("id").to_numpy(), t.column("comp").to_numpy()
    sets = [np.sort(np.asarray(x.values)) for c in t.column("set").chunks for x in c]
    root = np.unique(comp, return_inverse=True)[1]
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    borders = np.flatnonzero(np.append(True, left[1:] != left[:-1])) if len(left) else left
    out = []
    for start, end in zip(borders.tolist(), [*borders[1:].tolist(), len(left)], strict=True):
        a, todo = int(left[start]), right[start:end]
        while len(todo := todo[root[todo] != root[a]]):
            part, todo = todo[:256], todo[256:]
            size = np.array([len(sets[b]) for b in part])
            flat = np.concatenate([sets[b] for b in part])
            place = np.minimum(np.searchsorted(sets[a], flat), len(sets[a]) - 1)
            inside = sets[a][place] == flat
            common = np.add.reduceat(inside, np.cumsum(size) - size, dtype=np.int64)
            for b in part[ratio[1] * common >= ratio[0] * (size + len(sets[a]) - common)].tolist():
                if root[b] != root[a]:
                    root[root == root[b]] = root[a]
                    out.append((int(ids[a]), int(ids[b])))
            if not len(todo):
                break
    return out


def _by_block(rows: DataFrame, work, schema: str) -> DataFrame:
    """*work* on each (token, block) of *rows*, which come sorted by them."""

    def run(batches):
        release_memos()
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            token, block = t.column("token").to_numpy(), t.column("block").to_numpy()
            last = 0
            for c in (np.flatnonzero((token[1:] != token[:-1]) | (block[1:] != block[:-1])) + 1).tolist():
                yield from work(int(token[last]), t.slice(last, c - last))
                last = c
            rest = t.slice(last)
        if rest is not None and rest.num_rows:
            yield from work(int(rest.column("token")[0].as_py()), rest)

    return rows.mapInArrow(run, schema)


def _counted(rows: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """The rows that collide with another one of their block; see the module's description."""

    def work(token: int, t: pa.Table):
        left, right = _collisions(token, t, ratio)
        if len(left):
            yield from t.take(pa.array(np.unique(np.concatenate((left, right))))).combine_chunks().to_batches()

    return _by_block(rows, work, _ROW)


def _linked(rows: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """Links between the rows of each block, on their full sets; no more than connect them."""

    def work(token: int, t: pa.Table):
        found = _spanning(t, *_collisions(token, t, ratio), ratio)
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _by_block(rows, work, "a long, b long")


def in_blocks(rows: DataFrame) -> DataFrame:
    """*rows* of posting lists once for each ``block`` of the list that they are in, as its ``home`` or its ``probe`` side.

    *m* and *p* are the list's numbers of rows in its main component and of others, ``probe`` marks the latter. A block
    is two chunks, one of the main component and one of the others, or two of the others, or one chunk of the others
    with itself; each pair of rows that has a probe meets in one block. A list of up to CHUNK rows is one block.
    """
    chunks = lambda c: F.ceil(2 * F.col(c) / CHUNK)
    rows = rows.withColumn("_m", chunks("m")).withColumn("_p", chunks("p"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("probe"), F.col("_p")).otherwise(F.col("_m")))
    place = lambda block, home, probe: F.struct(block.cast("long").alias("block"), home.alias("home"), probe.alias("probe"))
    yes, no = F.lit(True), F.lit(False)
    with_others = F.transform(F.sequence(F.lit(0), F.col("_p") - 1), lambda x: place(F.col("_own") * F.col("_p") + x, yes, no))
    with_main = F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda x: place(x * F.col("_p") + F.col("_own"), no, yes))
    low, high = lambda x: F.least("_own", x), lambda x: F.greatest("_own", x)
    among = F.transform(F.sequence(F.lit(0), F.col("_p") - 1), lambda x: place(-1 - low(x) * F.col("_p") - high(x), F.col("_own") <= x, F.col("_own") >= x))
    one = F.array(place(F.lit(0), yes, F.col("probe")))
    blocks = F.when(F.col("m") + F.col("p") <= CHUNK, one).when(F.col("probe"), F.concat(with_main, among)).otherwise(with_others)
    rows = rows.withColumn("_own", own).withColumn("_place", F.explode(blocks))
    return rows.drop("probe").select("*", "_place.block", "_place.home", "_place.probe")


def near_copies(docs: DataFrame, width: int = 5, ratio: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document.

    Sets with |A and B| * ratio[1] >= |A or B| * ratio[0] are linked; a component's id is its smallest document's.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    base = scratch.save(_signed(source, width))
    classes = base.filter("n > 0 AND id IS NOT NULL").groupBy("d1", "d2").agg(F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = scratch.save(classes.withColumn("rep", F.monotonically_increasing_id()))  # the numbers hold as they are written

    # Postings that at least two classes hold, by class, the rare ones first.
    token = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("col").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posted = classes.select("rep", F.posexplode("sig")).select("rep", token.alias("token"))
    common = scratch.save(posted.groupBy("token").agg(F.count("*").alias("df")).filter("df >= 2"))
    posts = with_counted(posted, common, "token", "df").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("posts")).filter(F.size("posts") >= MATCHES)
    prefix = F.slice(F.transform("posts", lambda x: x["token"]), 1, F.size("posts") - (MATCHES - 1))
    weight = F.aggregate("posts", F.lit(0).cast("long"), lambda s, x: s + x["df"])
    kept = posts.select("rep", prefix.alias("posts"), weight.alias("weight")).join(classes.select("rep", "n", "sig"), "rep")
    members = scratch.save(kept.withColumnRenamed("rep", "id"))

    # Each list's members with its most connected member.
    lists = members.select("id", "weight", F.explode("posts").alias("token"))
    centers = lists.groupBy("token").agg(F.max(F.struct("weight", (-F.col("id")).alias("i"))).alias("top"), F.count("*").alias("size")).filter("size >= 2").select("token", (-F.col("top.i")).alias("a"), "size")
    centers = scratch.save(centers)
    stars = with_counted(lists, centers, "token", "size").filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    sig = members.select("id", "sig", "n")
    stars = stars.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("_s"), F.col("n").alias("_n")), "b").join(sig.select(F.col("id").alias("a"), F.col("sig").alias("_t"), F.col("n").alias("_m")), "a")
    same = F.size(F.filter(F.zip_with("_s", "_t", lambda x, y: x == y), lambda x: x))
    alike = F.least("_n", "_m") * ratio[1] >= F.greatest("_n", "_m") * ratio[0]
    stars = stars.filter(alike & (same >= MATCHES)).select("a", "b")
    wanted = members.select("id").join(classes.select(F.col("rep").alias("id"), "first_id", "d1", "d2"), "id")
    wanted = wanted.groupBy(F.col("first_id").alias("_of")).agg(F.collect_list(F.struct("id", "d1", "d2")).alias("found"))
    sets = scratch.save(_sets(source.join(wanted, F.col("id") == F.col("_of")), width).dropDuplicates(["id"]))
    links = scratch.save(_verified(stars, sets, ratio))
    reached = scratch.save(components(links, scratch))

    # Lists whose members are still in several components: pairs across components, in blocks.
    state = members.join(reached, "id", "left").select("id", "n", "sig", "posts", F.coalesce("component", "id").alias("comp"))
    lists = state.select("id", "comp", F.explode("posts").alias("token"))
    main = lists.join(centers.select("token", F.col("a").alias("id")), ["token", "id"]).select("token", F.col("comp").alias("main"))
    of_main, n = F.col("comp") == F.col("main"), F.col("count")
    shares = lists.groupBy("token", "comp").count().join(main, "token").groupBy("token").agg(F.first("main").alias("main"), F.sum(F.when(of_main, n)).alias("m"), F.sum(F.when(~of_main, n)).alias("p"))
    shares = scratch.save(shares.filter("p > 0").withColumn("size", F.col("m") + F.col("p")))
    rows = with_counted(lists, shares, "token", "size").join(state.select("id", "n", "sig", "posts"), "id")
    rows = in_blocks(rows.withColumn("probe", F.col("comp") != F.col("main")))
    rows = rows.select("token", "block", "id", "comp", "n", "sig", "posts", "home", "probe").repartition("token", "block").sortWithinPartitions("token", "block")
    colliding = _counted(rows, ratio).join(sets, "id").repartition("token", "block").sortWithinPartitions("token", "block")
    more = _linked(colliding, ratio)
    links = scratch.save(links.unionByName(more))
    whole = components(links, scratch)

    member = classes.select("d1", "d2", "rep", "first_id").join(whole.select(F.col("id").alias("rep"), "component"), "rep", "left")
    member = member.withColumn("component", F.coalesce("component", "rep"))
    least = member.groupBy("component").agg(F.min("first_id").alias("least"))
    member = member.join(least, "component").select("d1", "d2", F.col("least").alias("component"))
    out = base.select("id", "n", "d1", "d2").join(member, ["d1", "d2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op1_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, Jaccard similarity of 0.8 or more."""
    return near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4)


QUERIES = {"op1_near_copies": op1_near_copies}

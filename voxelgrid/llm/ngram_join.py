"""Exact Jaccard self-join of documents on word n-grams by universe-partition pigeonhole.

Two sets of sizes r <= s with Jaccard similarity >= t differ in at most
(1 - t) / (1 + t) * (r + s) tokens. Tokens are hashed into the segments of a size band; a pair
that differs in at most H tokens must agree on one of any H + 1 segments. Every document
therefore indexes a signature of each non-empty segment (and, in bands of small sets, of each
segment with one token deleted, which catches one difference in a segment and so counts twice),
and needs only enough of them to cover H + 1 units. Which ones is decided by cost: signatures
that no other document has are free, and the rest is taken from the smallest groups. A
document whose free signatures already cover H + 1 has no partner. Documents that would need
large groups are indexed again over a finer partition. What is left are small sets of candidate
groups, whose members are compared by bitmaps and verified on the whole sets.

Of each group the members outside of its largest component are compared with all members, in
cells of bounded size, and each gives the few closest ones of other components; pairs that
lie in one component by then are not looked at again, so a group of near copies gives links
in proportion to its members. More are given where those prove wrong, until none is held back.

Contracts
* null or wordless text: an empty set, linked with nothing, component of its own.
* equal sets are one class; only its first document is indexed and compared.
* rows that repeat an id, or have none, are rows of their own (see ``_store.identified``).
* extra columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text
from ._components import components
from ._store import drop, identified, tasks_for, written
from ._worker import forget

_U = np.uint64
#: Bands of set sizes grow by this factor.
BAND = 4 / 3
#: Bands of sets below this size index one-deletion neighbourhoods.
DELETION_BELOW = 16
#: A group of more documents than this is dear; who needs it is indexed over finer segments.
DEAR = 32
#: Signatures that one reducer should hold at once.
ENTRIES_PER_TASK = 3_000_000
#: Members compared with one leader in one task.
MEMBERS_PER_TASK = 256
FINE = 4.0
#: Classes of copies with a greater share of all documents are handed to all tasks.
HOT_SHARE = 1 / 4096
#: Members on the left and on the right side of one cell of a large group.
LEFT, RIGHT = 2048, 8192
#: Pairs that a member gives in a cell at first, and the factor for those whose pairs were no links.
CLOSEST, MORE = 4, 4
#: Bits of a sketch per token, at first and for the groups whose pairs were no links.
COARSE, FINER = 2, 16


def _differences(t: float, total: int) -> int:
    """Most tokens in which two sets of ``total`` tokens together may differ."""
    return math.floor((1 - t) / (1 + t) * total + 1e-9)


def _edges() -> list[int]:
    out = [1]
    while out[-1] < 2**40:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BAND)))
    return out


_EDGES = _edges()


def _schemes(n: int, t: float) -> list[tuple[int, int]]:
    """(band, units needed) of each band whose pairs may hold a set of ``n`` tokens.

    Band k covers the pairs whose smaller set has _EDGES[k] to _EDGES[k + 1] - 1 tokens.
    """
    own = int(np.searchsorted(_EDGES, n, "right")) - 1
    out = [(own, _differences(t, n + math.floor(n / t + 1e-9)) + 1)]
    k = own - 1
    while k >= 0 and math.floor((_EDGES[k + 1] - 1) / t + 1e-9) >= n:
        out.append((k, _differences(t, _EDGES[k + 1] - 1 + n) + 1))
        k -= 1
    return out


def _segments(band: int, t: float, fine: float) -> tuple[int, bool]:
    """Segments of a band, and whether it indexes one-deletion neighbourhoods."""
    most = _EDGES[band + 1] - 1
    need = _differences(t, most + math.floor(most / t + 1e-9)) + 1
    if most < DELETION_BELOW:
        return max(1, math.ceil(need / 2 * fine)), True
    return math.ceil((1.155 * need + 0.8 * math.sqrt(most) + 2) * fine), False


def _signatures(tokens: np.ndarray, band: int, seed: int, m: int, deletion: bool) -> tuple[np.ndarray, int]:
    """Signatures of the non-empty segments, and the units that they cover."""
    salt = _text.mix(np.array([band * 1000 + seed * 7 + 1], _U))[0]
    v, other = _text.mix(tokens ^ salt), _text.mix(np.array([salt]))[0]
    seg = ((v >> _U(32)) * _U(m)) >> _U(32)
    order = np.argsort(seg, kind="stable")
    seg, v = seg[order], v[order]
    at = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    sums, tag = np.add.reduceat(v, at), _text.mix(seg ^ other)
    exact = _text.mix(sums ^ tag[at])
    if not deletion:
        return exact, len(exact)
    length = np.diff(np.concatenate([at, [len(v)]]))
    where = np.repeat(np.arange(len(at)), length)
    less = _text.mix((sums[where] - v) ^ tag)[length[where] >= 2]
    return np.concatenate([exact, less]), int(len(at) + np.count_nonzero(length >= 2))


def _sets(column, size: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, sorted."""
    data, offsets = _text.arrow_bytes(column)
    for a, z in _text.slices(data, offsets):
        words, bounds = _text.hash_words(data, offsets[a : z + 1])
        hashes, ends = _text.shingles(words, bounds, size)
        for k in range(z - a):
            yield np.unique(hashes[ends[k] : ends[k + 1]])


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def document_sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, n_shingles, digest): the size and identity of each document's set."""

    def run(batches):
        forget()
        for b in batches:
            sets = list(_sets(b.column(1), size)) if b.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())],
                names=["node", "n_shingles", "digest"],
            )

    return docs.select("node", "text").mapInArrow(run, "node long, n_shingles long, digest binary")


def _index(docs: DataFrame, size: int, t: float, buckets: int, fine: float) -> DataFrame:
    """(bucket, items, counts, sigs): packed signatures."""

    def run(batches):
        forget()
        pending: list = []
        entries = 0

        def flush():
            nonlocal entries
            sig = np.concatenate([x[3] for x in pending])
            item = np.repeat(np.arange(len(pending)), [len(x[3]) for x in pending])
            bucket = (((sig >> _U(40)) * _U(buckets)) >> _U(24)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            node = np.array([x[0] for x in pending], np.int64)
            scheme = np.array([x[1] for x in pending], np.int32)
            slack = np.array([x[2] for x in pending], np.int32)
            for b in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[b] : cuts[b + 1]]
                items, counts = np.unique(item[own], return_counts=True)
                low = sig[own] & _U((1 << 40) - 1)
                packed = np.empty((len(items), 16), np.uint8)
                packed[:, :8] = node[items].view(np.uint8).reshape(-1, 8)
                packed[:, 8:12] = scheme[items].view(np.uint8).reshape(-1, 4)
                packed[:, 12:] = slack[items].view(np.uint8).reshape(-1, 4)
                planes = np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8)[:, :5].T)
                yield int(b), packed.T.tobytes(), counts.astype(np.uint32).tobytes(), planes.tobytes()
            pending.clear()
            entries = 0

        def out(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "items", "counts", "sigs"])

        for b in batches:
            nodes = b.column(0).to_pylist()
            for node, s in zip(nodes, _sets(b.column(1), size) if nodes else (), strict=True):
                for band, need in _schemes(len(s), t) if len(s) else ():
                    m, deletion = _segments(band, t, fine)
                    seed = 0
                    while True:
                        sig, units = _signatures(s, band, seed, m, deletion)
                        # a signature covers one unit; below its need a set is indexed under further seeds, too
                        slack = (len(sig) if not deletion else units) - need
                        pending.append((node, band * 64 + seed, slack if not deletion else min(slack, 0), sig))
                        entries += len(sig)
                        seed += 1
                        if units >= need:
                            break
                if entries > 2_000_000:
                    yield out(list(flush()))
        if pending:
            yield out(list(flush()))

    return docs.select("node", "text").mapInArrow(run, "bucket int, items binary, counts binary, sigs binary")


def _groups_of_bucket(table: pa.Table) -> pa.Table:
    """Signatures that several documents share, equal member sets merged: one row per member."""
    nodes, schemes, slacks, keys = [], [], [], []
    for items, counts, sigs in zip(*(table.column(c).to_pylist() for c in ("items", "counts", "sigs")), strict=True):
        packed = np.ascontiguousarray(np.frombuffer(items, np.uint8).reshape(16, -1).T)
        n = np.frombuffer(counts, np.uint32)
        planes = np.zeros((int(n.sum()), 8), np.uint8)
        planes[:, :5] = np.frombuffer(sigs, np.uint8).reshape(5, -1).T
        keys.append(planes.view(np.uint64).ravel())
        nodes.append((np.ascontiguousarray(packed[:, :8]).view(np.int64).ravel(), n))
        schemes.append(np.ascontiguousarray(packed[:, 8:12]).view(np.int32).ravel())
        slacks.append(np.ascontiguousarray(packed[:, 12:]).view(np.int32).ravel())
    key, n = np.concatenate(keys), np.concatenate([x[1] for x in nodes])
    node, scheme, slack = np.concatenate([x[0] for x in nodes]), np.concatenate(schemes), np.concatenate(slacks)
    item = np.repeat(np.arange(len(n), dtype=np.int32), n)
    order = np.argsort(key, kind="stable")
    key, item = key[order], item[order]
    edge = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.flatnonzero(edge)
    length = np.diff(np.concatenate([at, [len(key)]]))
    shared = length >= 2
    keep = np.repeat(shared, length)
    item, length = item[keep], length[shared]
    schema = pa.schema([("gid", pa.int64()), ("members", pa.int64()), ("node", pa.int64()), ("scheme", pa.int32()), ("slack", pa.int32()), ("shared", pa.int64())])
    if not len(item):
        return schema.empty_table()
    at = np.concatenate([[0], np.cumsum(length)[:-1]])
    with np.errstate(over="ignore"):
        gid = _text.mix(np.add.reduceat(_text.mix(node[item].view(np.uint64) * _U(2) + _U(1)), at) + length.astype(_U))
    # equal member sets under the same scheme collapse into one group
    which, back, times = np.unique(gid ^ _text.mix(scheme[item[at]].astype(_U)), return_inverse=True, return_counts=True)
    first = np.zeros(len(which), np.int64)
    first[back[::-1]] = np.arange(len(back))[::-1]
    size = length[first]
    rows = np.repeat(at[first] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    member = item[rows]
    return pa.table([np.repeat(which, size).view(np.int64), np.repeat(size, size).astype(np.int64), node[member], scheme[member], slack[member], np.repeat(times, size).astype(np.int64)], schema=schema)


def _groups(index: DataFrame, buckets: int) -> DataFrame:
    """(gid, members, node, scheme, slack, shared) of every group of two documents or more."""
    kind = "gid long, members long, node long, scheme int, slack int, shared long"

    def run(batches):
        forget()
        found = list(batches)
        if found:
            yield from _groups_of_bucket(pa.Table.from_batches(found)).to_batches()

    # a partition for each bucket
    rows = index.repartitionById(buckets, F.col("bucket")).mapInArrow(run, kind)
    # equal groups of several buckets are summed, in mappers first
    return rows.groupBy("gid", "node", "scheme").agg(F.max("members").alias("members"), F.first("slack").alias("slack"), F.sum("shared").alias("shared"))


def _allocate(groups: DataFrame) -> DataFrame:
    """Marks (column ``probe``) the cheapest groups that cover what a document still needs.

    ``shared`` signatures of a document are not free, so its free ones are all but these; it
    needs as many of them as exceed its slack. A one-deletion band takes all of its groups.
    """
    own = Window.partitionBy("node", "scheme")
    before = own.orderBy("members", "gid").rowsBetween(Window.unboundedPreceding, -1)
    g = groups.withColumn("needs", F.sum("shared").over(own) - F.col("slack"))
    g = g.withColumn("covered", F.coalesce(F.sum("shared").over(before), F.lit(0)))
    # negative slack: under this seed the document is only indexed, and probes under another
    deletion = F.floor(F.col("scheme") / 64) < F.lit(int(np.searchsorted(_EDGES, DELETION_BELOW, "right")) - 1)
    return g.withColumn("probe", (F.col("slack") >= 0) & (deletion | (F.col("covered") < F.col("needs"))))


def _bucket_count(spark: SparkSession, entries: int) -> int:
    return max(tasks_for(spark) * 2, math.ceil(entries / ENTRIES_PER_TASK))


def _with_leaders(pairs: DataFrame, table: DataFrame, run, kind: str = "a long, b long") -> DataFrame:
    """``run`` over each leader a and its members b, all with their columns of ``table`` (by node), in parts of bounded size."""
    count = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / MEMBERS_PER_TASK).cast("int"))
    leaders = count.select("a", F.col("a").alias("b"), "salts")
    # leaders of many members are few, a pair in 256 at most, so they can afford a row for each part
    big = count.where("salts > 1").select(F.col("a").alias("k"), "salts", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("part"))
    parted = pairs.withColumn("p", F.pmod(F.xxhash64("b"), F.lit(16)).cast("int"))
    dealt = parted.join(big, (F.col("a") == F.col("k")) & (F.col("p") == F.col("part")), "left").select("a", "b", F.coalesce(F.col("salts"), F.lit(1)).alias("salts"))
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    leads = leaders.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = dealt.unionByName(leads).join(table.withColumnRenamed("node", "b"), "b")
    return rows.groupBy("a", "salt").applyInArrow(run, kind)


def _verify(pairs: DataFrame, docs: DataFrame, size: int, t: float) -> DataFrame:
    """(a, b) of the pairs (leader a, member b) whose whole sets are similar enough."""

    def run(table: pa.Table) -> pa.Table:
        forget()
        a, b = table.column("a")[0].as_py(), table.column("b").to_pylist()
        lead = b.index(a)
        one = next(_sets(table.column("text").slice(lead, 1), size))
        found = []
        for other, s in zip(b, _sets(table.column("text"), size), strict=True):
            both = len(np.intersect1d(one, s, assume_unique=True))
            if other != a and both >= t * (len(one) + len(s) - both) - 1e-9:
                found.append(other)
        return pa.table([pa.array([a] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

    return _with_leaders(pairs, docs, run)


def _possible(pairs: DataFrame, bits: DataFrame, t: float) -> DataFrame:
    """(a, b) of the pairs (leader a, member b) that their sizes and sketches do not rule out."""

    def run(table: pa.Table) -> pa.Table:
        forget()
        a, b, n = table.column("a")[0].as_py(), table.column("b").to_numpy(), table.column("n").to_numpy()
        sketches, lead = _sketches(table.column("bits")), int(np.flatnonzero(b == a)[0])
        apart = np.bitwise_count(sketches ^ sketches[lead]).sum(axis=1)
        good = (apart <= (1 - t) / (1 + t) * (n + n[lead]) + 1e-9) & (n >= t * n[lead] - 1e-9) & (n[lead] >= t * n - 1e-9) & (b != a)
        return pa.table([np.full(int(good.sum()), a), b[good]], names=["a", "b"])

    return _with_leaders(pairs, bits, run)


def _sketches(column: pa.ChunkedArray) -> np.ndarray:
    """Sketches of one width, the least of all: a wide one folds to any smaller power of two."""
    rows = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
    width = min(map(len, rows))
    return np.stack([np.bitwise_xor.reduce(r.reshape(-1, width), axis=0) for r in rows])


def _classes(sets: DataFrame) -> DataFrame:
    """(node, component, n_shingles): the first document of each one's class, for all that have words."""
    sets = sets.where("digest is not null")
    leads = written(sets.groupBy("digest").agg(F.min("node").alias("component"), F.count("*").alias("n")))
    # 1 / HOT_SHARE classes at most have such a share of all rows
    hot = leads.where(F.col("n") > sets.count() * HOT_SHARE)
    few = F.broadcast(hot.select("digest", "component"))
    rest = sets.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(leads.drop("n"), "digest")
    return sets.join(few, "digest").unionByName(rest.select(*sets.columns, "component")).select("node", "component", "n_shingles")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.75) -> DataFrame:
    """One row per document: its id, n_shingles, and the component of the similarity graph.

    Components are exact: a link between different sets is lost only if both of its ends are
    in one component already. ``component_id`` is the smallest id of the component.
    """
    spark = docs.sparkSession
    docs, docs_renumbered = identified(docs, id_col, text_col)
    sets = written(document_sets(docs, size))
    label = written(_classes(sets))
    # few copies are sent to all tasks, many are joined
    copies = written(label.where("node <> component").select("node"))
    firsts = docs.join(copies, "node", "left_anti")
    total = label.where("node = component").agg(F.sum("n_shingles")).first()[0] or 0
    label = label.drop("n_shingles")
    buckets = _bucket_count(spark, total)
    groups = written(_allocate(_groups(_index(firsts, size, threshold, buckets, 1.0), buckets)))
    dear = written(groups.where(f"probe and members > {DEAR}").select("node").distinct())
    hard = firsts.join(dear, "node", "left_semi")
    # who can do without dear groups finds its partners itself; the rest meets over finer segments
    fine = written(_allocate(_groups(_index(hard, size, threshold, buckets, FINE), buckets)).select("gid", "node", "probe"))
    easy = groups.join(dear, "node", "left_anti").where("probe").select("gid").distinct()
    kept = groups.join(easy, "gid", "left_semi").join(dear.withColumn("dear", F.lit(True)), "node", "left")
    kept = kept.select("gid", "node", (F.col("probe") & F.col("dear").isNull()).alias("probe"))
    open_ = written(kept.unionByName(fine.join(fine.where("probe").select("gid").distinct(), "gid", "left_semi")).groupBy("gid", "node").agg(F.max("probe").alias("probe")))
    drop(groups, dear, fine)
    asked = written(open_.select("node").distinct())
    texts = written(docs.join(asked, "node", "left_semi").select("node", "text"))
    drop(asked)
    label = _link_groups(open_, label, texts, size, threshold)
    drop(open_, texts, copies)
    rows = sets.join(label, "node", "left").select("node", "n_shingles", F.coalesce("component", "node").alias("component"))
    if not docs_renumbered:
        return rows.select(F.col("node").cast(docs.schema["id"].dataType).alias(id_col), "n_shingles", F.col("component").cast(docs.schema["id"].dataType).alias("component_id"))
    rows = rows.join(docs.select("node", "id"), "node")
    # a component's name is its smallest id, which a node number need not follow
    names = rows.groupBy("component").agg(F.min("id").alias("component_id"))
    return rows.join(names, "component").select(F.col("id").alias(id_col), "n_shingles", "component_id")


def keep_one_of_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.75) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, or the first where ids repeat or are null.

    Rows are told apart even where their ids are not. Documents without words all stay.
    """
    known, renumbered = identified(docs, id_col, text_col)
    if not renumbered:
        found = similar_documents(docs, id_col=id_col, text_col=text_col, size=size, threshold=threshold)
        gone = written(found.where(F.col("component_id") != F.col(id_col)).select(id_col))
        return docs.join(gone, id_col, "left_anti").select(*docs.columns)
    drop(known)
    numbered = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("node"), F.col(text_col).alias("text")))
    found = similar_documents(numbered, id_col="node", text_col="text", size=size, threshold=threshold)
    gone = written(found.where("component_id <> node").select("node"))
    return numbered.join(gone, "node", "left_anti").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def _relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after ``links``: only components that the links touch are worked on."""
    one, two = (label.select(F.col("node").alias(k), F.col("component").alias(c)) for k, c in (("a", "u"), ("b", "v")))
    moved = components(links.join(one, "a").join(two, "b").select(F.col("u").alias("a"), F.col("v").alias("b")))
    moved = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return written(label.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def _bitmaps(texts: DataFrame, size: int, per_token: int) -> DataFrame:
    """(node, n, bits): set sizes, and odd sketches of about so many bits per token.

    A bit is the parity of the tokens that fall on it, so tokens of both sets cancel out and each
    token of only one set flips one bit: differing bits bound differing tokens from below.
    """

    def run(batches):
        forget()
        for b in batches:
            n, bits = [], []
            for s in _sets(b.column(1), size):
                width = 1 << min(20, max(8, (per_token * len(s) - 1).bit_length()))
                one = np.bincount((s >> _U(20)).astype(np.int64) & (width - 1), minlength=width) & 1
                n.append(len(s))
                bits.append(np.packbits(one.astype(bool), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], names=["node", "n", "bits"])

    return texts.mapInArrow(run, "node long, n long, bits binary")


def _near(table: pa.Table, t: float, most: int) -> pa.Table:
    """Pairs of a cell that lie in different components and that their bitmaps do not rule out.

    For each document on the left the ``most`` closest on the right: of each other component the
    closest first. ``more`` says whether some were held back.
    """
    node, comp, n = (table.column(c).to_numpy() for c in ("node", "c", "n"))
    probe, left = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("probe", "left"))
    bits, gid = _sketches(table.column("bits")), table.column("gid")[0].as_py()
    right = np.flatnonzero(~left)
    a, b, more = [], [], []
    for i in np.flatnonzero(left):
        other = right[(comp[right] != comp[i]) & (probe[right] | probe[i]) & (n[right] >= t * n[i] - 1e-9) & (n[i] >= t * n[right] - 1e-9)]
        apart = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1)
        good = apart <= (1 - t) / (1 + t) * (n[other] + n[i]) + 1e-9
        other, apart = other[good], apart[good]
        if len(other) > most:
            order = np.lexsort((node[other], apart, comp[other]))
            of = comp[other[order]]
            place = np.arange(len(order)) - np.searchsorted(of, of)
            order = order[np.lexsort((node[other[order]], apart[order], place))]
            other, held = other[order[:most]], True
        else:
            held = False
        a.append(np.full(len(other), node[i]))
        b.append(node[other])
        more.append(np.full(len(other), held))
    if not a:
        a, b, more = ([np.zeros(0, x)] for x in (np.int64, np.int64, bool))
    columns = [np.concatenate(x) for x in (a, b, more)]
    return pa.table([np.full(len(columns[0]), gid), *columns], names=["gid", "a", "b", "more"])


def _near_with(t: float, most: int):
    def run(table: pa.Table) -> pa.Table:
        forget()
        return _near(table, t, most)

    return run


def _spread(state: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their components, and the groups with a probe that lie in several components."""
    g = state.join(label, "node").withColumnRenamed("component", "c")
    by = g.groupBy("gid", "c").agg(F.count("*").alias("n"), F.max("probe").alias("any"), F.min(F.when(F.col("probe"), F.struct("node", "c"))).alias("l"))
    kept = by.groupBy("gid").agg(F.count("*").alias("kinds"), F.max("any").alias("any"), F.min("l").alias("l"), F.sum("n").alias("members"), F.max(F.struct("n", F.col("c").alias("main"))).alias("m"))
    return g, kept.where("kinds > 1 and any").select("gid", "l", "members", "m.main", (F.col("members") - F.col("m.n")).alias("rest"))


def _cells(g: DataFrame, bits: DataFrame) -> DataFrame:
    """Each member outside of its group's main component on the left of a row of cells, and every member on the right of a column."""
    across, down = F.ceil(F.col("rest") / LEFT).cast("int"), F.ceil(F.col("members") / RIGHT).cast("int")
    h = F.xxhash64("node")
    cell = lambda left, x, y: F.struct(F.lit(left).alias("left"), x.alias("x"), y.alias("y"))
    on_left = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda y: cell(True, F.pmod(h, F.col("across")).cast("int"), y))
    on_right = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda x: cell(False, x, F.pmod(h, F.col("down")).cast("int")))
    both = F.when(F.col("c") == F.col("main"), on_right).otherwise(F.concat(on_left, on_right))
    dealt = g.withColumns({"across": across, "down": down}).withColumn("cell", F.explode(both))
    return dealt.select("gid", "cell.x", "cell.y", "node", "c", "probe", "cell.left").join(bits, "node")


def _link_groups(groups: DataFrame, label: DataFrame, texts: DataFrame, size: int, t: float) -> DataFrame:
    """Labels after all links that the groups' probes have.

    First each group's first probe is compared with the members in other components, which
    joins groups of copies. Then the groups that still lie in several components are compared
    in cells with bitmaps of their members, until no pair is held back that can be similar.
    """
    g, spread = _spread(groups, label)
    stars = g.join(spread.select("gid", "l"), "gid").where("c <> l.c").select(F.col("l.node").alias("a"), F.col("node").alias("b"))
    stars, bits = written(stars.distinct()), written(_bitmaps(texts, size, COARSE))
    likely = written(_possible(stars, bits, t))
    links = written(_verify(likely, texts, size, t))
    label = _relabelled(label, links)
    drop(links)
    tried = [written(stars.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())]
    drop(stars, likely)
    state, most, held = groups, CLOSEST, []
    while True:
        g, spread = _spread(state, label)
        g = written(g.join(spread.drop("l"), "gid"))
        drop(*held)
        held = [g]
        near = _cells(g, bits).groupBy("gid", "x", "y").applyInArrow(_near_with(t, most), "gid long, a long, b long, more boolean")
        found = written(near)
        near = written(found.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a")))
        fresh = near
        for one in tried:
            fresh = fresh.join(one, ["lo", "hi"], "left_anti")
        fresh = written(fresh.select("a", (F.col("lo") + F.col("hi") - F.col("a")).alias("b"), "lo", "hi"))
        if not fresh.isEmpty():
            links = written(_verify(fresh.select("a", "b"), texts, size, t))
            if not links.isEmpty():
                label = _relabelled(label, links)
            tried.append(written(fresh.select("lo", "hi")))
            drop(links)
        # only groups with pairs that were held back go on
        open_ = written(found.where("more").select("gid").distinct())
        drop(near, fresh, found)
        if open_.isEmpty():
            drop(bits, open_, *tried, *held)
            return label
        state = g.join(open_, "gid").select("gid", "node", "probe")
        held.append(open_)
        if most == CLOSEST:
            drop(bits)
            asked = written(state.select("node").distinct())
            bits = written(_bitmaps(texts.join(asked, "node", "left_semi"), size, FINER))
            drop(asked)
        most *= MORE

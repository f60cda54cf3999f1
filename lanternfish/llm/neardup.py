"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

Method. A text is the bag of its shingles of five consecutive words (a shorter text with a word is one shingle),
weighted by their counts. Each shingle's points of a Poisson process with its weight as rate fall on
random components of the signature; a component keeps the shingle that arrives first, and a text stops
once no later arrival can be first anywhere. Two signatures agree in a component with probability equal to the
probability Jaccard similarity of the two bags. With all weights 1 that is the plain Jaccard similarity of the sets,
so a text that repeats a shingle has a second signature, of its set; a text that repeats none has one for both.
Signatures are cut into bands; equal bands make texts candidates, and candidates count as linked only after
their similarity is computed from the whole texts.

Linked: the probability Jaccard similarity, or the plain Jaccard similarity of the two sets of shingles, is at
least the threshold. Classes are the connected components of the links; equal texts are always of one class.

Scale. Equal texts are collapsed first, reduced before the shuffle. Within a bucket no pairs of all members are made. In
two rounds the members meet one representative, the text with most company in all its buckets, and members linked
to it are of one class. What is left in buckets of several classes, of whatever size, goes to prefix filtering, which
finds every pair of sets, and every pair of bags, of different classes that can reach the threshold; of any two classes one
such pair is tested first, and the others only if that one did not join them. So no pair of different classes that could
be linked stays untested, and no bucket is treated by its size.
Texts move once, for texts with a candidate; the keys of those are broadcast only up to ``BROADCAST_KEYS``.

Defined results: null counts as the empty text; a text without words is in a class with equal texts only;
repeated rows give repeated result rows; an empty table gives no rows; other columns are ignored, whatever their names. A
null doc_id is kept, and is a class's id only if the class has no other. Of texts that tie for most company the one with the
greatest md5 stands for its bucket. A text of any length is hashed whole, in a group of its own beyond ``GROUP_BYTES``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces, ship
from .common import checkpointed, release, settled, settled_rows
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
#: Texts of about so many bytes are hashed at once.
GROUP_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch that are unpacked at once.
ROWS_AT_ONCE, BATCH_BYTES = 500, 8 << 20
#: Slots in which prefix filtering counts shingles, to rank them.
COUNTERS = 1 << 18
TEXTS_PER_TASK = 2000
BROADCAST_KEYS = 200_000
ROUNDS = 2
#: What a prefix is of: a set or bag of a text that repeats a shingle, or both in one.
BOTH, SET, BAG = 0, 1, 2

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A random-looking bijection of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_ODD_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


_KEPT: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    kept = _KEPT.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, GROUP_BYTES + (1 << 18)), base, dtype=np.uint64)
        kept[0] = 1
        kept = _KEPT[int(base)] = np.multiply.accumulate(kept)
    return kept[:n]


def shingle_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle of each text, in order, and the index of its text."""
    data = np.frombuffer(b"\n".join([*raws, b""]), dtype=np.uint8)
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if not len(data):
        return none
    ends_of = np.cumsum([len(r) + 1 for r in raws])
    inside = ~_GAP[data]
    start = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if not len(start):
        return none
    end = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    with np.errstate(over="ignore"):
        prefix = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * _powers(_ODD, len(data)))]
        word = mix((prefix[end] - prefix[start]) * _powers(_ODD_INV, len(data))[start] + (end - start).astype(np.uint64))
        n = np.diff(np.r_[0, np.searchsorted(start, ends_of)])  # words of each text
        doc = np.repeat(np.arange(len(raws)), n)
        stop = np.cumsum(n)
        # a sum of powers over five consecutive words; a shorter text sums all its words
        out = np.zeros(max(len(word) - SHINGLE + 1, 0), dtype=np.uint64)
        for k in range(SHINGLE):
            out += word[k : k + len(out)] * _powers(_GOLD, SHINGLE)[k]
        whole = np.arange(len(out)) + SHINGLE <= stop[doc[: len(out)]]
        hashes, of = [mix(out[whole])], [doc[: len(out)][whole]]
        for d in np.flatnonzero((n > 0) & (n < SHINGLE)):
            own = word[stop[d] - n[d] : stop[d]] * _powers(_GOLD, SHINGLE)[: n[d]]
            hashes.append(mix(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(n[d])))
            of.append(np.array([d]))
    return np.concatenate(hashes), np.concatenate(of)


def bags(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text index, hash, count."""
    h, doc = shingle_hashes(raws)
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)])
    return doc[first], h[first], np.diff(np.r_[first, len(h)])


def signatures(raws: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """ProbMinHash signatures, and which texts have one."""
    return bag_signatures(*bags(raws), len(raws), size)


def bag_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """ProbMinHash signatures of bags as ``bags`` gives them, and which texts have one."""
    first = np.full(texts * size, np.inf)
    winner = np.zeros(texts * size, dtype=np.uint64)
    time = np.zeros(len(doc))
    step = 0
    limit = np.full(texts, np.inf)
    with np.errstate(over="ignore"):
        while len(doc):
            step += 1
            r = mix(element + np.uint64(step) * _GOLD)
            time = time - np.log(((r >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / weight
            slot = ((mix(r ^ _ODD) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            go = time < limit[doc]
            if not go.all():
                doc, element, weight, time, slot = doc[go], element[go], weight[go], time[go], slot[go]
            at = doc * size + slot
            np.minimum.at(first, at, time)
            won = first[at] == time
            winner[at[won]] = element[won]
            if step < 8 or step % 8 == 0:
                here = np.unique(doc)
                limit[here] = first.reshape(texts, size)[here].max(axis=1)
    done = np.isfinite(first.reshape(texts, size)[:, 0]) if texts else np.zeros(0, bool)
    return winner.reshape(texts, size), done


def bag_similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> tuple[float, float]:
    """Probability Jaccard of two bags, and plain Jaccard of their sets; hashes come sorted."""
    if not len(ha) or not len(hb):
        return 0.0, 0.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    n = int(both.sum())
    union = len(ha) + len(hb) - n
    if not n or (wa.max() == 1 and wb.max() == 1):
        return n / union, n / union
    a, b = wa[both].astype(float), wb[at[both]].astype(float)
    only_a, only_b = float(wa.sum() - a.sum()), float(wb.sum() - b.sum())
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    below = np.searchsorted(a / b, a / b, side="left")
    above_a = only_a + a.sum() - np.r_[0, np.cumsum(a)][below]
    below_b = only_b + np.r_[0, np.cumsum(b)][below]
    return float((1 / (above_a / a + below_b / b)).sum()), n / union


def similarity(a: bytes, b: bytes) -> tuple[float, float]:
    """Probability Jaccard of the bags, and plain Jaccard of the sets, of two texts' shingles."""
    doc, h, count = bags([a, b])
    cut = np.searchsorted(doc, 1)
    return bag_similarity(h[:cut], count[:cut], h[cut:], count[cut:])


def grouped(raws: list[bytes]) -> Iterator[list[bytes]]:
    group, total = [], 0
    for r in raws:
        group.append(r)
        total += len(r)
        if total >= GROUP_BYTES:
            yield group
            group, total = [], 0
    if group:
        yield group


def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, BATCH_BYTES):
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(a, ROWS_AT_ONCE)


def band_keys(raws: list[bytes], bands: int, rows: int) -> list[np.ndarray]:
    """Distinct bucket keys of each text: bands of its bag's signature, and of its set's where a shingle repeats."""
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)

    def banded(sig: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.tile(salt, (len(sig), 1))
            for k in range(rows):
                h = mix(h * _GOLD + sig[:, k::rows][:, :bands])
        return h.view(np.int64)

    doc, element, count = bags(raws)
    sig, done = bag_signatures(doc, element, count, len(raws), bands * rows)
    out = [x if d else x[:0] for x, d in zip(banded(sig), done)]
    repeats = np.unique(doc[count > 1])
    own = np.isin(doc, repeats)
    sets, _ = bag_signatures(np.searchsorted(repeats, doc[own]), element[own], np.ones(int(own.sum())), len(repeats), bands * rows)
    for d, x in zip(repeats, banded(sets)):
        out[d] = np.unique(np.r_[out[d], x])
    return out


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_up(batches):
            out = []
            raws = [(t or "").encode() for t in batch.column(0).to_pylist()]
            for g in grouped(raws):
                out += band_keys(g, bands, rows)
            keys = [hashlib.md5(r).digest() for r in raws]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(keys, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names[1:], "key", "bands"])

    return run


def _verify(threshold: float):
    def similarities(rows: list[tuple]) -> list[float]:
        at: dict[bytes, int] = {}
        raws = [t.encode() for a, b, ta, tb in rows for k, t in ((a, ta), (b, tb)) if k not in at and at.setdefault(k, len(at)) is not None]
        doc, h, w = bags(raws)
        cut = np.searchsorted(doc, np.arange(len(raws) + 1))
        own = [(h[x:y], w[x:y]) for x, y in zip(cut, cut[1:])]
        return [max(bag_similarity(*own[at[a]], *own[at[b]])) for a, b, _, _ in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_up(batches):
            sims: list[float] = []
            group, size = [], 0
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                group.append(row)
                size += len(row[3])
                if size >= GROUP_BYTES:
                    sims += similarities(group)
                    group, size = [], 0
            sims += similarities(group) if group else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64()), pa.array([s >= threshold for s in sims], pa.bool_())], names=["a", "b", "sim", "linked"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each document: doc_id, class_id (least doc_id of its class), class_size, copies, links.

    copies counts the rows with an equal text; links the tested links of the text to different texts. key (md5 of the
    text) and root (the least key of the class) tell texts and classes apart where ids repeat.
    """
    ship(__name__)
    release(docs.sparkSession)  # what earlier stages left goes before this one fills the disk
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = checkpointed(docs.select("text", "doc_id").mapInArrow(_sign(bands, rows), f"doc_id {id_type}, key binary, bands array<bigint>"))
    nodes = checkpointed(signed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    members = nodes.select("key", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    # how many texts a text meets in its buckets: most for the one in the middle of a group
    met = settled(members.join(shared, "bucket"))
    central = met.groupBy("key").agg(F.sum("n").alias("central"))
    active = settled(met.select("bucket", "key").join(central, "key"))
    found = None if active.isEmpty() else _links(docs, active, threshold)
    if found is None:
        classes = nodes.select("key", "copies", F.col("key").alias("root"), F.lit(0).cast("bigint").alias("links"))
    else:
        links, roots = found
        degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
        known = roots.withColumnRenamed("node", "key").join(degree, "key")
        classes = nodes.select("key", "copies").join(known, "key", "left").select("key", "copies", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = classes.join(nodes.select("key", "first_id"), "key")
    sizes = named.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    classes = checkpointed(named.join(sizes, "root").select("key", "root", "class_id", "class_size", "copies", "links"))
    return signed.select("doc_id", "key").join(classes, "key").select("doc_id", "class_id", "class_size", "copies", "links", "key", "root")


def _joined(label: DataFrame | None, new: DataFrame, n: int) -> DataFrame:
    """Labels (node, root) after n new links (a, b), by contracting the graph of the classes that they join."""
    edges = new.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if label is None:
        return components(edges, n)
    for c in ("u", "v"):
        edges = edges.join(label.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(c, F.coalesce(f"r{c}", c)).drop(f"r{c}")
    moved = components(edges.select("u", "v").distinct(), n).select(F.col("node").alias("old"), F.col("root").alias("new"))
    kept = label.join(moved, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = moved.join(label, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return settled(kept.unionByName(fresh), most=label.count() + 2 * n)


def _links(docs: DataFrame, active: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame] | None:
    """The tested links (a, b) between different texts, a < b, and the labels (node, root) that they give."""
    texts = _texts_of(docs, active.select("key").distinct())
    tested = label = None
    here, left = active.withColumn("root", F.col("key")), active.count()

    def test(pairs: DataFrame) -> None:
        """Verify pairs that have not met yet, and bring the labels up to date."""
        nonlocal tested, label
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        one = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
        both = one.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
        done = settled(both.select("a", "b", "ta", "tb").mapInArrow(_verify(threshold), "a binary, b binary, sim double, linked boolean"))
        tested = done if tested is None else tested.unionByName(done)
        new = done.where("linked")
        if n := new.count():
            label = _joined(label, new, n)

    def rooted(rows: DataFrame, node: str, root: str) -> DataFrame:
        """Add the class of a node as ``root``; a node without a link is its own."""
        if label is None:
            return rows.withColumn(root, F.col(node))
        return rows.join(label.select(F.col("node").alias(node), F.col("root").alias("_root")), node, "left").withColumn(root, F.coalesce("_root", node)).drop("_root")

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows (bucket, key, central) of buckets of more than one class, with their class."""
        rows = rooted(rows, "key", "root")
        nonlocal left
        of = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        out, left = settled_rows(rows.join(of.select("bucket"), "bucket"), most=left)
        return out

    for _ in range(ROUNDS):
        reps = here.groupBy("bucket").agg(F.max(F.struct("central", "key", "root")).alias("rep")).select("bucket", F.col("rep.key").alias("rep"), F.col("rep.root").alias("rep_root"))
        met = here.join(reps, "bucket").where("root <> rep_root")
        test(met.select(F.least("key", "rep").alias("a"), F.greatest("key", "rep").alias("b")).distinct())
        here = mixed(here.select("bucket", "key", "central").join(reps.select("bucket", F.col("rep").alias("key")), ["bucket", "key"], "left_anti"))
        release(docs.sparkSession)
        if not left:
            break
    else:
        pairs = settled(_overlapping(here.select("key", "root").distinct(), texts, threshold))
        test(pairs.groupBy("ra", "rb").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"))
        test(rooted(rooted(pairs.select("a", "b"), "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b"))
        release(docs.sparkSession)
    return None if label is None else (tested.where("linked").select("a", "b"), label)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in cut_up(batches):
        out, counts = [], []
        for g in grouped([t.encode() for t in batch.column(0).to_pylist()]):
            doc, h, count = bags(g)
            cut = np.searchsorted(doc, np.arange(len(g) + 1))
            out += [h[x:y].view(np.int64) for x, y in zip(cut, cut[1:])]
            counts += [count[x:y] if (count[x:y] > 1).any() else None for x, y in zip(cut, cut[1:])]
        cols = [pa.array(out, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*batch.schema.names[1:], "shingles", "counts"])


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of a task have a shingle in each slot, so far as there are any."""
    total = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False) & (COUNTERS - 1), minlength=COUNTERS)
    slot = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(total[slot])], names=["slot", "n"])


def _prefixes(often_of, threshold: float):
    """The shingles that come early enough in a ranking from rare to common: (key, root, kind, n, what comes before, shingle).

    kind: SET and BAG of a text that repeats a shingle, BOTH of one that repeats none. n is the size, with
    repetitions for a BAG. Rarity is counted in COUNTERS slots by hash; any ranking that all sets share loses nothing, and this one is close to
    the exact one. A shingle that is alone in its slot is in no other set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = often_of.value
        for batch in cut_up(batches):
            rows, kinds, n, place, shingle = [], [], [], [], []
            for k, (hashes, counts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                h = np.array(hashes, dtype=np.int64)
                if not len(h):
                    continue
                f = often[h & (COUNTERS - 1)]
                order = np.lexsort((h, f))
                ones = np.ones(len(h), dtype=np.int64)
                for kind, weight in ((BOTH, ones),) if counts is None else ((SET, ones), (BAG, np.array(counts, dtype=np.int64)[order])):
                    total = int(weight.sum())
                    before = np.cumsum(weight) - weight
                    met = np.flatnonzero((total - before >= threshold * total - 1e-9) & (f[order] > 1))
                    rows.append(np.full(len(met), k))
                    kinds.append(np.full(len(met), kind, dtype=np.int32))
                    n.append(np.full(len(met), total, dtype=np.int32))
                    place.append(before[met].astype(np.int32))
                    shingle.append(h[order[met]])
            if rows:
                at = pa.array(np.concatenate(rows))
                cols = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.concatenate(c)) for c in (kinds, n, place, shingle))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "root", "kind", "n", "i", "h"])

    return run


def _overlapping(nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes (key, root) of different classes ra < rb that may reach the threshold, by prefix filtering.

    Shingles are ranked from rare to common. Two sets that reach the threshold share a shingle so early in both of their
    rankings that what follows it can still hold the overlap they need, so no pair of sets is lost; near copies
    that have drifted apart share only the common shingles of their group, which come late.

    Bags likewise: let A and B be the shares of two bags' weights on shingles that both have. Their probability Jaccard
    is at most 1 / (1/A + 1/B - 1), and what follows their first common shingle, itself included, is at least A and B.
    Bags without repetition are left to the sets, whose similarity is theirs.
    """
    t = threshold
    sets = settled(nodes.join(texts, "key").select("text", "key", "root").mapInArrow(_sets, "key binary, root binary, shingles array<bigint>, counts array<bigint>"), TEXTS_PER_TASK)
    # bounded: COUNTERS counts
    often = np.zeros(COUNTERS, dtype=np.int64)
    for r in sets.select("shingles").mapInArrow(_slot_counts, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toLocalIterator():
        often[r["slot"]] = r["n"]
    early = settled(sets.mapInArrow(_prefixes(sets.sparkSession.sparkContext.broadcast(often), t), "key binary, root binary, kind int, n int, i int, h bigint"))
    # a shingle that only one class has joins nothing
    several = early.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    early = settled(early.join(several.select("h"), "h", "left_semi"))
    set_rows, bag_rows = early.where(F.col("kind") != BAG), early.where(F.col("kind") != SET)
    least = F.ceil(2 * t / (1 + t) * F.col("n") - 1e-9)
    x = set_rows.where(F.col("i") <= F.col("n") - least).select("h", *[F.col(c).alias(f"x_{c}") for c in ("key", "root", "n", "i")])
    y = set_rows.select("h", *[F.col(c).alias(f"y_{c}") for c in ("key", "root", "n", "i")])
    need = F.ceil(t / (1 + t) * (F.col("x_n") + F.col("y_n")) - 1e-9)
    fits = (F.col("x_root") != F.col("y_root")) & (F.col("x_n") <= F.col("y_n")) & (F.col("x_n") >= t * F.col("y_n") - 1e-9)
    fits = fits & (F.col("x_n") - F.col("x_i") >= need) & (F.col("y_n") - F.col("y_i") >= need)
    pairs = x.withColumnRenamed("h", "_h").join(y, (F.col("_h") == F.col("h")) & fits)
    x = bag_rows.where(F.col("kind") == BAG).select(F.col("h").alias("_h"), *[F.col(c).alias(f"x_{c}") for c in ("key", "root", "n", "i")])
    y = bag_rows.select("h", *[F.col(c).alias(f"y_{c}") for c in ("key", "root", "kind", "n", "i")])
    fits = (F.col("x_root") != F.col("y_root")) & ((F.col("y_kind") != BAG) | (F.col("x_key") < F.col("y_key")))
    fits = fits & (F.col("x_n") / (F.col("x_n") - F.col("x_i")) + F.col("y_n") / (F.col("y_n") - F.col("y_i")) <= 1 + 1 / t + 1e-9)
    cols = ["x_key", "y_key", "x_root", "y_root"]
    both = pairs.select(*cols).unionByName(x.join(y, (F.col("_h") == F.col("h")) & fits).select(*cols))
    first = F.col("x_root") < F.col("y_root")
    ends = F.when(first, F.struct(F.col("x_root").alias("ra"), F.col("y_root").alias("rb"))).otherwise(F.struct(F.col("y_root").alias("ra"), F.col("x_root").alias("rb")))
    return both.select(F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b"), ends.alias("r")).select("a", "b", "r.ra", "r.rb").distinct()


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row (key, text) for each key."""
    keyed = docs.select(F.unhex(F.md5("text")).alias("key"), "text")
    keys = settled(keys)
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    found = keyed.join(side, "key")
    return settled(found.dropDuplicates(["key"]), TEXTS_PER_TASK)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class stays, with its own columns: of its least doc_id; of repeated rows one stays."""
    classes = near_duplicates(docs)
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x"))
    stays = first.select(F.col("x.key").alias("_stay"), F.col("x.doc_id").alias("_id"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    keyed = docs.select(whole, F.col("doc_id").alias("_own"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("_key"))
    kept = keyed.join(stays, (F.col("_key") == F.col("_stay")) & F.col("_own").eqNullSafe(F.col("_id")))
    return kept.dropDuplicates(["_key"]).select("_doc.*")


def op6_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents")).drop("key", "root")

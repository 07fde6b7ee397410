"""N-gram Jaccard join (op8): vertical partitioning of shingle sets, with components of the links.

Documents of equal sets are one node. How many nodes hold a shingle is counted exactly, in buckets of the hash whose number grows with the
corpus, and gives shingles their global order: by magnitude of that count, then by hash. What only one node holds comes first and links
nothing; the rest of a set is its reduced set. Nodes that share one of their first shingles, so few that two sets similar enough must
share one, are candidates if the shingle's places in both sets leave room for the overlap. The order is cut into fragments; a candidate
pair's overlap is counted in each fragment by itself and summed. Among the nodes that share a first shingle all are compared with the most
central one, the hub; what remains are pairs of nodes in different components.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Places, cut, from_files, ranked, slices, tidy, write_by_partition

#: Shingles of a bucket of the hash, about, and of a task's portion of them.
BUCKET, PORTION = 1 << 20, 1 << 21
FRAGMENTS = 4
#: Lengths whose ratio is below this share a band, so that a join looks only at sets of about the right length.
BAND = 1.02
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
#: White space that cuts words: blank and the controls 9 to 13.
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


@cache
def _letters() -> np.ndarray:
    """A 64-bit value for every byte, capitals A-Z as their small letters."""
    out = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD[2])
    out[65:91] = out[97:123]
    return out


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def word_values(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and each text's number of words. A word's hash is a polynomial in its bytes, had
    for all words at once as the difference of two prefix sums."""
    data = [t.encode() for t in texts]
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    inside = ~_BLANK[raw]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_letters()[raw] * power[: len(raw)], out=prefix[1:])
    values = _mix((prefix[stop] - prefix[start]) * inverse[start] + (stop - start).astype(np.uint64) * _ODD[3])
    ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1)
    return values, np.diff(np.searchsorted(start, ends), prepend=0)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes: runs of `size` words (lower-cased A-Z, cut at ASCII white space), or
    the whole sequence if it has fewer words; nothing without words."""
    h, n = word_values(texts)
    many = max(0, len(h) - size + 1)
    rolled = np.full(many, size, np.uint64)
    for i in range(size):
        rolled = _mix(rolled * _ODD[2] + h[i : i + many])
    out, at = [], 0
    for k in n.tolist():
        if k >= size:
            own = np.sort(rolled[at : at + k - size + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif k:
            x = np.full(1, k, np.uint64)
            for i in range(k):
                x = _mix(x * _ODD[3] + h[at + i : at + i + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n, percent: int):
    """Shingles that a set of n must share with any set similar enough: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def _linked(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def _joined(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sets in one array, and the size of each; held is empty afterwards, so that they are in memory once."""
    out = np.concatenate(held), np.fromiter(map(len, held), np.int64, len(held))
    held.clear()
    return out


def _portions(batches, size: int, repeats: set[int], first_row: int):
    """(portion, the rows' shingle sets in one array, the size of each) of a partition's texts, less the rows in `repeats`; portions are
    cut alike at each reading. What a portion leaves in its reader's hands stays in memory while the next is collected."""
    held, many, portion, at = [], 0, 0, first_row
    for _, texts in slices(batches):
        for i, own in enumerate(shingle_sets(texts, size), at):
            if len(own) and i not in repeats:
                held.append(own)
                many += len(own)
        at += len(texts)
        if many >= PORTION:
            yield portion, *_joined(held)
            many, portion = 0, portion + 1
    if held:
        yield portion, *_joined(held)


def _tallied(shingles: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct shingles in order the bits 32 to 63 below the upper `bits`, how often each occurs (up to 255), and where each
    bucket begins, with the end. Sorts in place: neither an order nor numbers of the shingles are held beside them."""
    shingles.sort()
    new = np.concatenate((np.ones(min(1, len(shingles)), bool), shingles[1:] != shingles[:-1]))
    counts = np.minimum(np.diff(np.flatnonzero(new), append=len(shingles)), 255).astype(np.uint8)
    keys = shingles[new]
    cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    keys <<= np.uint64(bits)
    keys >>= np.uint64(32)
    return keys.astype(np.uint32), counts, np.append(cuts, len(keys))


def _magnitudes(shingles: np.ndarray, told: np.ndarray) -> np.ndarray:
    """The magnitude of each shingle, where told has those of the distinct ones in order."""
    order = np.argsort(shingles, kind="stable")
    own = shingles[order]
    new = np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1]))
    del own
    if np.count_nonzero(new) != len(told):
        raise RuntimeError("the documents' partitions changed between two readings; write them to a table first")
    at = np.cumsum(new)
    at -= 1
    out = np.empty(len(shingles), np.uint8)
    out[order] = told[at]
    return out


def _repeats(places: Places) -> set[int]:
    found = places.read(TaskContext.get().partitionId(), ["row"])
    return set(found.column("row").to_pylist()) if found else set()


def _spread(texts: DataFrame, size: int, repeats: Places, bits: int) -> DataFrame:
    """(part, portion, bucket, keys, counts): each portion's distinct shingles by the upper `bits` bits, as 32 further bits in order, and
    how many of the portion's nodes hold them (up to 255). Equal ones of a portion are added up before they are sent."""

    @tidy
    def run(batches):
        part = TaskContext.get().partitionId()
        for portion, shingles, _ in _portions(batches, size, _repeats(repeats), part << 40):
            low, counts, cuts = _tallied(shingles, bits)
            del shingles
            own = np.flatnonzero(np.diff(cuts))
            yield pa.record_batch(
                [
                    pa.array(np.full(len(own), part, np.int64)), pa.array(np.full(len(own), portion, np.int64)), pa.array(own, pa.int64()),
                    pa.array([low[cuts[i] : cuts[i + 1]].tobytes() for i in own], pa.binary()), pa.array([counts[cuts[i] : cuts[i + 1]].tobytes() for i in own], pa.binary()),
                ],
                ["part", "portion", "bucket", "keys", "counts"],
            )
            del low, counts

    return texts.mapInArrow(run, "part long, portion long, bucket long, keys binary, counts binary")


def _told(group: pa.Table) -> pa.Table:
    """For a bucket's portions the magnitude (number of bits) of each shingle's count over all portions."""
    keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("keys")]
    found, at = ranked(np.concatenate(keys))
    total = np.bincount(at, np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in group.column("counts")]), len(found))
    told = np.frexp(total)[1].astype(np.uint8)[at]
    ends = np.cumsum([len(k) for k in keys])
    return group.select(["part", "portion", "bucket"]).append_column("told", pa.array([x.tobytes() for x in np.split(told, ends[:-1])], pa.binary()))


def _reduced(texts: DataFrame, size: int, percent: int, repeats: Places, told: Places) -> DataFrame:
    """(node, n, alone, shingles, magnitudes): the reduced set in global order of each node that may link with another, and how many
    shingles it holds alone. A node whose first shingles are all its own links with none."""

    @tidy
    def run(batches):
        part = TaskContext.get().partitionId()
        answers = told.read(part, ["portion", "bucket", "told"])
        for portion, shingles, n in _portions(batches, size, _repeats(repeats), part << 40):
            own = answers.filter(pa.compute.equal(answers.column("portion"), portion)).sort_by("bucket") if answers else None
            magnitude = _magnitudes(shingles, np.frombuffer(b"".join(own.column("told").to_pylist()), np.uint8) if own else np.zeros(0, np.uint8))
            alone = np.add.reduceat(magnitude == 1, np.cumsum(n) - n, dtype=np.int64)
            out, stop = [], np.cumsum(n)
            for i in np.flatnonzero(alone < n - least_overlap(n, percent) + 1).tolist():
                whole, of = shingles[stop[i] - n[i] : stop[i]], magnitude[stop[i] - n[i] : stop[i]]
                shared = of > 1
                s, m = whole[shared], of[shared]
                order = np.argsort(m, kind="stable")  # sets are in the order of the hash already
                out.append((node_of(whole), int(n[i]), int(alone[i]), s[order].view(np.int64), m[order].tobytes()))
                if len(out) == 64 or i == len(n) - 1:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)
            whole = of = shingles = magnitude = None  # none of it stays while the next portion is collected

    def _batch(out):
        node, n, alone, shingles, magnitudes = zip(*out, strict=True)
        return pa.record_batch([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(alone, pa.int64()), pa.array(shingles, pa.list_(pa.int64())), pa.array(magnitudes, pa.binary())], ["node", "n", "alone", "shingles", "magnitudes"])

    return texts.mapInArrow(run, "node long, n long, alone long, shingles array<long>, magnitudes binary")


def _heads(reduced: DataFrame, percent: int) -> DataFrame:
    """(shingle, node, n, room) of first shingles: any set similar enough shares one. room: shingles of the set from that place on."""
    many = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1 - F.col("alone")
    shown = reduced.select("node", "n", "alone", F.posexplode(F.slice("shingles", F.lit(1), many.cast("int"))).alias("place", "shingle"))
    return shown.select("shingle", "node", "n", (F.col("n") - F.col("alone") - F.col("place")).alias("room"))


def _fits(a_n: Column, a_room: Column, b_n: Column, b_room: Column, percent: int) -> Column:
    """Whether sets that share a shingle there may be similar enough, as far as lengths and what is left of both say."""
    return (a_n * percent <= b_n * 100) & (b_n * percent <= a_n * 100) & (F.least(a_room, b_room) * (100 + percent) >= (a_n + b_n) * percent)


def _pivots(reduced: DataFrame) -> list[tuple[int, int]]:
    """Places in the order, as (magnitude, hash), that cut it into fragments of about as many shingles each."""

    @tidy
    def count(batches):
        total = np.zeros(65, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8), minlength=65)
        yield pa.record_batch([pa.array(np.arange(65)), pa.array(total)], ["magnitude", "many"])

    found = reduced.select("magnitudes").mapInArrow(count, "magnitude long, many long").groupBy("magnitude").agg(F.sum("many").alias("many")).collect()
    mass = np.zeros(65, np.int64)
    for r in found:
        mass[r.magnitude] = r.many
    ends = np.cumsum(mass)
    out = []
    for i in range(1, FRAGMENTS):
        want = int(ends[-1]) * i // FRAGMENTS
        m = int(np.searchsorted(ends, want, "right"))
        out.append((m, ((want - int(ends[m] - mass[m])) << 64) // int(mass[m])) if m < 65 else (65, 0))
    return out


def _segments(reduced: DataFrame, needed: DataFrame, pivots: list[tuple[int, int]]) -> DataFrame:
    """(node, fragment, shingles) of the needed nodes, the shingles of a fragment in the order of the hash as signed numbers."""

    @tidy
    def run(batches):
        for batch in batches:
            node, fragment, parts = [], [], []
            for i in range(batch.num_rows):
                s = batch.column(1)[i].values.to_numpy()
                m, u = np.frombuffer(batch.column(2)[i].as_py(), np.uint8), s.view(np.uint64)
                of = sum(((m > p) | ((m == p) & (u >= np.uint64(h)))).astype(np.int64) for p, h in pivots)
                for f in range(FRAGMENTS):
                    node.append(batch.column(0)[i].as_py())
                    fragment.append(f)
                    parts.append(np.sort(s[of == f]))
            yield pa.record_batch([pa.array(node, pa.int64()), pa.array(fragment, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], ["node", "fragment", "shingles"])

    wanted = reduced.join(needed.hint("shuffle_merge"), "node", "left_semi").select("node", "shingles", "magnitudes")
    return cut(wanted.mapInArrow(run, "node long, fragment int, shingles array<long>").filter(F.size("shingles") > 0), "segments")


def _compared(pairs: DataFrame, reduced: DataFrame, pivots: list[tuple[int, int]]) -> DataFrame:
    """pairs (a, b, a_n, b_n) with inter: the overlap in each fragment by itself, then their sum for each pair."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    segments = _segments(reduced, needed, pivots)
    side = lambda p: segments.select(F.col("node").alias(p), "fragment", F.col("shingles").alias(f"s{p}")).hint("shuffle_merge")
    parts = pairs.select("a", "b", F.explode(F.array(*map(F.lit, range(FRAGMENTS)))).alias("fragment"))
    both = parts.join(side("a"), ["a", "fragment"]).join(side("b"), ["b", "fragment"]).select("a", "b", "sa", "sb")

    @tidy
    def count(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            found = [len(np.intersect1d(a[i].values.to_numpy(), b[i].values.to_numpy(), assume_unique=True)) for i in range(batch.num_rows)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["a", "b", "part"])

    counted = both.mapInArrow(count, "a long, b long, part long").groupBy("a", "b").agg(F.sum("part").alias("inter"))
    return cut(pairs.join(counted, ["a", "b"], "left").fillna(0, ["inter"]), "compared")


def components(links: DataFrame) -> DataFrame:
    """(node, component: the least node that links lead to) of every node in links (a, b). Least labels pass along links and then along
    themselves until nothing changes; each round is a table in the shared folder."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        of = stepped.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = cut(stepped.join(of, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        labels = jumped.select("node", "component")
        if jumped.filter("was <> component").isEmpty():
            return labels


def _crossed(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, a_n, b_n) that hubs left open: nodes that share a first shingle, fit, and lie in different components. Of each
    shingle's nodes, those outside its most frequent component meet all of the lengths that their room allows."""
    placed = cut(members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    counts = placed.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("many"))
    open_ = counts.groupBy("shingle").agg(F.max_by("component", F.struct("many", "component")).alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("shingle", "main")
    of = placed.withColumn("low", F.expr(f"({percent} * n + 99) div 100")).withColumn("high", F.least(F.expr(f"100 * n div {percent}"), F.expr(f"{100 + percent} * room div {percent} - n"))).filter("low <= high")
    left = cut(of.join(open_, "shingle"), "open")
    band = lambda n: F.floor(F.log(n) / np.log(BAND)).cast("long")
    side = lambda p: [F.col(c).alias(f"{p}{d}") for c, d in (("node", ""), ("n", "_n"), ("room", "_room"), ("component", "_component"))]
    rest = left.filter("component <> main").select("shingle", *side("a"), F.explode(F.sequence(band(F.col("low")), band(F.col("high")))).alias("band"))
    every = left.select("shingle", *side("b"), band(F.col("n")).alias("band"))
    meet = (F.col("a_component") != F.col("b_component")) & _fits(F.col("a_n"), F.col("a_room"), F.col("b_n"), F.col("b_room"), percent)
    pairs = rest.join(every, ["shingle", "band"]).filter(meet)
    first = F.col("a") < F.col("b")
    return pairs.select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("a_n", "b_n"), ("b_n", "a_n"))]).distinct()


def _labels(rows: DataFrame, known: DataFrame, repeats: Places, size: int, percent: int) -> DataFrame:
    """(node, component) of every node that links with another."""
    total = known.filter("n > 0").select("node", "n").distinct().agg(F.sum("n")).first()[0] or 0
    bits = max(1, int(np.ceil(np.log2(max(1, total / BUCKET)))))
    parts = rows.rdd.getNumPartitions()
    answers = _spread(rows, size, repeats, bits).groupBy("bucket").applyInArrow(_told, "part long, portion long, bucket long, told binary")
    reduced = cut(_reduced(rows, size, percent, repeats, write_by_partition(answers, "magnitudes", parts)), "reduced")
    pivots = _pivots(reduced)

    heads = _heads(reduced, percent)
    central = F.struct((1 - F.col("room") / F.col("n")).alias("share"), "node", "n", "room")
    hubs = heads.groupBy("shingle").agg(F.min(central).alias("hub"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("shingle", "hub")
    members = cut(heads.join(cut(hubs, "hubs"), "shingle"), "members")
    near = members.filter(F.col("node") != F.col("hub.node")).filter(_fits(F.col("n"), F.col("room"), F.col("hub.n"), F.col("hub.room"), percent))
    first = cut(near.select(F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("n").alias("a_n"), F.col("hub.n").alias("b_n")).distinct(), "pairs")
    compared = _compared(first, reduced, pivots)
    links = compared.filter(_linked(F.col("inter"), F.col("a_n"), F.col("b_n"), percent)).select("a", "b")
    labels = components(links)

    done = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossed = cut(_crossed(members.drop("hub"), labels, percent).join(done, ["a", "b"], "left_anti"), "crossed")
    if crossed.isEmpty():
        return labels
    more = _compared(crossed, reduced, pivots).filter(_linked(F.col("inter"), F.col("a_n"), F.col("b_n"), percent)).select("a", "b")
    return labels if more.isEmpty() else components(links.unionByName(more))


def jaccard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """(id, row, check, n, node, component, component_id): one row per row of docs, which `row` numbers by partition (the upper 24 bits)
    and place in it; check is its text's CRC. The rest is as in jaccard_components."""
    rows = from_files(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "near-texts")

    @tidy
    def nodes(batches):
        at = TaskContext.get().partitionId() << 40
        for part, texts in slices(batches):
            sets = shingle_sets(texts, size)
            yield pa.record_batch(
                [
                    part.column(0), pa.array(np.arange(at, at + len(texts))), pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                ],
                ["id", "row", "check", "n", "node"],
            )
            at += len(texts)

    known = cut(rows.mapInArrow(nodes, f"id {docs.schema[id_col].dataType.simpleString()}, row long, check long, n long, node long"), "nodes")
    several = cut(known.filter("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.min("row").alias("row"), F.count(F.lit(1)).alias("many")).filter("many > 1"), "several")
    again = known.filter("n > 0").select("node", "row").join(several.select("node", F.col("row").alias("of")), "node").filter("row <> of")
    repeats = write_by_partition(again.select(F.expr("shiftright(row, 40)").alias("part"), "row"), "repeats", rows.rdd.getNumPartitions())
    labels = cut(_labels(rows.select("text"), known, repeats, size, percent), "labels")

    # Only nodes of several rows or with links have another component than their own row.
    ids = known.filter("n > 0").select("node", "id").join(labels, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    lone = several.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"), F.col("id").alias("component_id"))
    placed = labels.join(ids, "component").select("node", "component", "component_id").unionByName(lone)
    full = known.filter("n > 0").join(placed, "node", "left")
    full = full.select("id", "row", "check", "n", "node", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return full.unionByName(known.filter("n = 0").select("id", "row", "check", "n", "node", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """Components of documents whose shingle sets are similar: (id_col, n_shingles, node, component_id), one row per row of docs.

    Two documents link when 100 * intersection >= percent * union of their sets of `size`-word shingles; component_id is the smallest
    id that links lead to. Equal sets are one node (a 64-bit digest); a null or empty text has no shingles, no node, and is its own
    component. Texts of any length count whole: one is a portion by itself. Repeated rows each give a row; a null id is never a
    component's id unless all its rows have none; an empty table gives no rows; other columns are not read. Every link between different
    texts counts: nothing is capped."""
    told = jaccard_rows(docs, id_col, text_col, size, percent)
    return told.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "node", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, of which one stays for each component of jaccard_components(): that of the smallest id
    (null last), the first of repeated ones. Rows without a text all stay. What goes is looked up by a row's partition and place, so texts
    are not shuffled; that both readings saw the same rows is checked."""
    docs = from_files(docs, "near-docs")
    told = jaccard_rows(docs, id_col, text_col, size, percent).filter("n > 0")
    stays = told.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("component", "first")
    gone = told.join(stays, "component").filter("row <> first.row").select(F.expr("shiftright(row, 40)").alias("part"), "row", "check")
    places = write_by_partition(gone, "near-gone", docs.rdd.getNumPartitions())

    @tidy
    def run(batches):
        part_no = TaskContext.get().partitionId()
        found = places.read(part_no, ["row", "check"])
        gone = dict(zip(found.column("row").to_pylist(), found.column("check").to_pylist(), strict=True)) if found else {}
        at = part_no << 40
        for part, texts in slices(batches, text_col):
            keep = []
            for i, t in enumerate(texts, at):
                keep.append(i not in gone)
                if i in gone and zlib.crc32(t.encode()) != gone[i]:
                    raise RuntimeError("the documents' partitions changed between two readings; write them to a table first")
            yield part.filter(pa.array(keep, pa.bool_()))
            at += len(texts)

    return docs.mapInArrow(run, docs.schema)

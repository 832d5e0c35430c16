"""Operator 1: n-gram Jaccard join by grouped prefixes.

Each document is the set of its distinct word shingles.  Shingles have one global order, rare ones
first; two sets that are similar enough share a shingle among their first few (the prefix).

1. A count sketch, summed over all documents, gives the order.
2. One scan yields each document's size, set hash, prefix and a 256-bit parity map of its set.
   Equal sets become one class; classes of equal prefix and size become one group (but those of a
   crowd of over GROUP classes stay by themselves).
3. Prefix shingles that one group alone holds are left out.  Groups meet where they share one of the
   others, in order of size.  Pairs go through filters that never turn away a similar pair: by size
   and by the shingle's places, and where both groups have one member by the parity maps (which
   bound the symmetric difference from below).
4. Group pairs are expanded to member classes, filtered by the members' own maps, and each pair is
   verified on the full sets.
5. Components of the verified links.
6. Links: all lie within components, so the classes of a component are dealt in blocks and each pair
   of blocks is verified whole on the full sets, in one task of bounded size (``near_links``,
   ``near_pairs``; ``near_duplicates`` wants components only and stops at 5).

A list of a shingle that has far more pairs than members yields only each member's nearest earlier
one at first.  What it held back follows in rounds, each of at most eight times as many partners a
member, and only between groups that are not yet in one component; rounds end when no list holds
anything back.  So a large group of near copies costs a few pairs a member, no link that would join
two components is lost, and step 6 finds all links within them.  Shingles of over LIST groups,
counted exactly, are dealt out in pairs of blocks of about LIST.

Null and empty texts have an empty set and are linked with nothing.  A null doc_id is linked with
nothing and has a null component; rows that repeat a doc_id count as that one document (each row is
reported with its own text's size and class).  Very long texts cost their length.  Ties of order
are broken by hash and id.  Columns other than doc_id and text are ignored.  An empty table gives
an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, materialise, release, sized, table
from .components import connected
from .textkit import NOT_SPACE, mix, shingles, text_buffer, words_of

#: Counters of the sketch, in bits (the least, and the most, of 64 MB), and counters to a row of it.
SKETCH_BITS, MOST_SKETCH_BITS, ROW = 21, 24, 4096
#: Groups that one list of a shingle may hold before it is dealt out in blocks of about so many.
LIST = 2048
#: Lists of at most so many members are searched together, longer ones one by one.
SHORT = 128
#: Classes that one group may have.
GROUP = 8
#: Classes of one component that make a block, and shingles that a block may hold; each pair of
#: blocks is a cell, verified at once.
CELL, CELL_SHINGLES = 512, 1 << 20
#: Size, as a power of two, of the bit filter that tells which documents' full sets are needed: the
#: least, and the most that is broadcast (32 MB).  For more documents than that serves, they are joined.
NEEDED_BITS, MOST_BITS = 24, 28
#: Documents that a task remembers so as to pass over equal rows.
SEEN = 100_000


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    data, offsets = text_buffer(batch.column(batch.schema.get_field_index("text")))
    h, _, _, first = words_of(data, offsets, NOT_SPACE)
    return shingles(h, first, size)


def _source(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketch_bits(docs: DataFrame) -> int:
    """A counter for each 256 bytes of the input, within bounds: a larger corpus has more rare shingles
    to tell apart.  The order decides how many candidates there are, never the result."""
    held = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(MOST_SKETCH_BITS, SKETCH_BITS), max(SKETCH_BITS, math.ceil(math.log2(max(2, held // 256)))))


def count_sketch(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the documents that hold a shingle of each counter: a rank by their number (one byte), and
    whether they are over LIST (one bit)."""
    bits = sketch_bits(docs)
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            got = _sets(batch, size)
            if got:
                np.add.at(total, (np.concatenate(got) >> shift).astype(np.int64), np.uint32(1))
        rows = total.reshape(-1, ROW)
        used = np.flatnonzero(rows.any(axis=1))
        for part in np.array_split(used, max(1, len(used) // 64)):
            if len(part):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([zlib.compress(rows[i].tobytes(), 1) for i in part], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns)):
                own = held.setdefault(part, np.zeros(ROW, np.uint64))
                own += np.frombuffer(zlib.decompress(counts), np.uint32)
        if held:
            ranks = [np.minimum(255, np.round(8 * np.log2(x + 1.0))).astype(np.uint8).tobytes() for x in held.values()]
            often = [np.packbits(x > LIST).tobytes() for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(ranks, pa.binary()), pa.array(often, pa.binary())], names=["part", "ranks", "often"])

    rank, heavy = np.zeros((1 << bits) // ROW * ROW, np.uint8).reshape(-1, ROW), np.zeros((1 << bits) // 8, np.uint8).reshape(-1, ROW // 8)
    # Nine bits a counter reach the driver: 18 MB at most.
    counted = _source(docs).mapInArrow(count, "part long, counts binary").repartition("part")
    for r in counted.mapInArrow(add, "part long, ranks binary, often binary").collect():
        rank[r.part], heavy[r.part] = np.frombuffer(r.ranks, np.uint8), np.frombuffer(r.often, np.uint8)
    return rank.ravel(), heavy.ravel()


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


_MAPS = ["m0", "m1", "m2", "m3"]
FEATURES = "doc_id long, n long, h1 long, h2 long, g long, m0 long, m1 long, m2 long, m3 long, prefix array<long>, heavy array<boolean>"


def features(docs: DataFrame, size: int, num: int, den: int, sketch: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Size, set hash, hash of the prefix, map, and the prefix: of each of its shingles whether its
    list may have over LIST members."""
    shift = np.uint64(64 - (len(sketch[0]) - 1).bit_length())
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, heavy = held.value
        for batch in batches:
            got = _sets(batch, size)
            n = [len(s) for s in got]
            sums, prefixes, cut = np.zeros((len(got), 7), np.uint64), [], [0]
            for i, s in enumerate(got):
                if n[i]:
                    order = np.argsort((rank[(s >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")
                    p = s[order[: prefix_length(n[i], num, den)]]
                    sums[i, 3:] = np.packbits(np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1).view(np.uint64)
                    with np.errstate(over="ignore"):
                        sums[i, 0], sums[i, 1] = s.sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()
                        sums[i, 2] = mix(p + np.arange(len(p), dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).sum()
                    prefixes.append(p)
                cut.append(cut[-1] + (len(p) if n[i] else 0))
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
            cut = pa.array(cut, pa.int32())
            longs = [pa.array(np.ascontiguousarray(sums[:, k]).view(np.int64)) for k in range(7)]
            at = (flat >> shift).astype(np.int64)
            often = (heavy[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *longs, pa.ListArray.from_arrays(cut, pa.array(flat.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(often))],
                names=["doc_id", "n", "h1", "h2", "g", *_MAPS, "prefix", "heavy"],
            )

    return _source(docs).mapInArrow(run, FEATURES)


#: In meta: the shingle's place (40 bits), whether the group has several members, whether they are in
#: several components, and the block (20 bits).
POSTINGS = "token long, dealt long, n long, gid long, meta long, comp long, m0 long, m1 long, m2 long, m3 long"
_COLUMNS = [f.split()[0] for f in POSTINGS.split(", ")]


def long_lists(groups: DataFrame) -> DataFrame:
    """(token, heavy, parts) of the shingles that over LIST groups have in their prefixes: the blocks to deal
    them in.  Only shingles whose counter is that high are counted."""
    each = groups.select(F.explode(F.arrays_zip("prefix", "heavy")).alias("x")).filter("x.heavy").select(F.col("x.prefix").alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("held")).filter(F.col("held") > LIST).select("token", F.lit(True).alias("heavy"), F.ceil(F.col("held") / LIST).cast("int").alias("parts"))


def places(groups: DataFrame, dealt_out: DataFrame) -> DataFrame:
    """(token, row, pos, parts) of the prefix shingles that two groups or more hold; most are held by
    one, which nothing can meet.  Only these narrow rows are shuffled for all shingles.  Shingles that
    are dealt out are known to be shared, so a window holds LIST rows at most."""
    each = groups.select("row", F.posexplode(F.arrays_zip("prefix", "heavy")).alias("pos", "x"))
    each = each.select(F.col("x.prefix").alias("token"), F.col("x.heavy").alias("heavy"), "pos", "row").join(sized(dealt_out), ["token", "heavy"], "left")
    met = each.filter("parts IS NULL").select("token", "row", "pos").withColumn("held", F.count("*").over(Window.partitionBy("token"))).filter("held > 1")
    return each.filter("parts IS NOT NULL").select("token", "row", "pos", "parts").unionAll(met.select("token", "row", "pos", F.lit(1).alias("parts")))


def postings(groups: DataFrame, held: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """A row for each of the ``held`` places (of ``tokens``, if given) with its group; in a list of b
    blocks, one for each of the b pairs of blocks that the group's block is in."""
    each = held if tokens is None else held.join(sized(tokens), "token", "left_semi")
    block = F.pmod(F.xxhash64("gid", F.lit(7)), F.col("parts")).cast("int")
    each = each.join(groups.select("row", "n", "gid", "several", "comp", "mixed", *_MAPS).hint("merge"), "row").withColumn("block", block)
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = F.when(F.col("parts") == 1, F.lit(0)).otherwise(F.least("block", "other").cast("long") * (1 << 20) + F.greatest("block", "other") + 1)
    flags = F.col("several").cast("long") + 2 * F.col("mixed").cast("long") + 4 * F.col("block").cast("long")
    each = each.withColumn("meta", F.col("pos").cast("long") + flags * F.lit(1 << 40))
    return each.select("*", others).withColumn("dealt", dealt.cast("long")).select(*_COLUMNS).repartition("token", "dealt").sortWithinPartitions("token", "dealt", "n", "gid")


PAIRS = "a long, b long, grouped boolean, token long"


def _passing(c: dict[str, np.ndarray], maps: list[np.ndarray], crossed: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
    """Of the pairs (i, j) of one list those that pass the filters, and how far their maps differ."""
    n, pos = c["n"], c["pos"]
    total = n[i] + n[j]
    least = -(-num * total // (num + den))
    ok = (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least) & (c["gid"][i] != c["gid"][j])
    ok &= ~crossed[i] | (c["block"][i] != c["block"][j])
    ok &= (c["comp"][i] != c["comp"][j]) | c["mixed"][i] | c["mixed"][j]
    i, j, most = i[ok], j[ok], (total - 2 * least)[ok]
    differ = np.zeros(len(i), np.int16)
    for m in maps:
        differ += np.bitwise_count(m[i] ^ m[j])
    # The map of a group is that of one member: it says nothing about the others.
    ok = (differ <= most) | c["several"][i] | c["several"][j]
    return i[ok].astype(np.int32), j[ok].astype(np.int32), differ[ok]


def _nearest(i: np.ndarray, j: np.ndarray, d: np.ndarray, each: int) -> np.ndarray:
    """Places of the ``each`` pairs of least d (then i) of every j."""
    order = np.lexsort((i, d, j))
    if not len(order):
        return order
    head = np.flatnonzero(np.r_[True, j[order][1:] != j[order][:-1]])
    rank = np.arange(len(order)) - np.repeat(head, np.diff(np.r_[head, len(order)]))
    return order[rank < each]


def candidate_pairs(lists: DataFrame, num: int, den: int, turn: int) -> DataFrame:
    """Pairs of groups that pass the filters and are not known to be in one component.  In turn 0 a
    list of over four times as many pairs as members yields only each member's nearest earlier one,
    in turn k at most 4 * 8**(k - 1) of them; a row (null, null, null, token) tells that a list
    holds pairs back.  What is held at once is bounded by a list of about LIST members."""

    each = 1 if turn == 0 else 4 * 8 ** (turn - 1)

    def written(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        gid, several = c["gid"], c["several"]
        a, b, wide = np.minimum(gid[i], gid[j]), np.maximum(gid[i], gid[j]), several[i] | several[j]
        order = np.lexsort((b, a))
        a, b, wide = a[order], b[order], wide[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(wide[new]), pa.nulls(int(new.sum()), pa.int64())], names=["a", "b", "grouped", "token"])

    def held_back(tokens: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(tokens), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(tokens), pa.bool_()), pa.array(tokens)], names=["a", "b", "grouped", "token"])

    def of_short(c: dict[str, np.ndarray], maps: list[np.ndarray], crossed: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of whole lists, by steps: each member with the one ``step`` further on."""
        size, n = len(c["n"]), c["n"]
        count = np.diff(np.r_[first, size])
        run = np.repeat(np.arange(len(first)), count)
        end = np.r_[first[1:], size][run]
        found, live, step = [], np.arange(size), 1
        while True:
            live = live[live + step < end[live]]
            live = live[den * n[live] >= num * n[live + step]]
            if not len(live):
                break
            found.append(_passing(c, maps, crossed, live, live + step, num, den))
            step += 1
        if not found:
            return
        i, j, d = (np.concatenate(x) for x in zip(*found))
        if not len(i):
            return
        pairs = np.bincount(run[i], minlength=len(first))
        limited = ((pairs > 4 * count) if turn == 0 else (pairs > 0))[run[i]]
        at = np.flatnonzero(limited)
        near = at[_nearest(i[at], j[at], d[at], each)]
        lost = np.flatnonzero(np.bincount(run[i[at]], minlength=len(first)) > np.bincount(run[i[near]], minlength=len(first)))
        keep = np.r_[np.flatnonzero(~limited), near]
        yield written(c, i[keep], j[keep])
        if len(lost):
            yield held_back(np.unique(c["token"][first[lost]]))

    def of_long(c: dict[str, np.ndarray], maps: list[np.ndarray], crossed: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of one list, some members at a time with all before them."""
        n, size = c["n"], len(c["n"])
        wide, low = max(1, (1 << 18) // size), np.searchsorted(n, -(-num * n // den))
        waiting, held, lost = [], 0, False
        for at in range(1, size, wide):
            to, a = min(size, at + wide), int(low[at])
            j, i = np.divmod(np.arange((to - at) * (to - a)), to - a)
            i, j = i + a, j + at
            ok = (i < j) & (i >= low[j])
            i, j, d = _passing(c, maps, crossed, i[ok], j[ok], num, den)
            if turn == 0 and held + len(i) <= 4 * size:
                waiting.append((i, j, d))
                held += len(i)
                continue
            if waiting:
                i, j, d = (np.concatenate(x) for x in zip(*waiting, (i, j, d)))
                waiting, held = [], 4 * size + 1
            near = _nearest(i, j, d, each)
            lost |= len(near) < len(i)
            if len(near):
                yield written(c, i[near], j[near])
        if waiting:
            i, j, _ = (np.concatenate(x) for x in zip(*waiting))
            if len(i):
                yield written(c, i, j)
        if lost:
            yield held_back(c["token"][:1])

    def process(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """All whole lists of these rows."""
        token, dealt = c["token"], c["dealt"]
        size = len(token)
        first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (dealt[1:] != dealt[:-1])])
        count = np.diff(np.r_[first, size])
        # A list of two different blocks pairs members across them; one of a block with itself, within.
        crossed = (dealt > 0) & ((dealt - 1) >> 20 != (dealt - 1) & ((1 << 20) - 1))
        maps = [c[k].view(np.uint64) for k in _MAPS]

        part = lambda own: ({k: x[own] for k, x in c.items()}, [m[own] for m in maps], crossed[own])
        short = (count > 1) & (count <= SHORT)
        if short.any():
            yield from of_short(*part(np.flatnonzero(np.repeat(short, count))), np.r_[0, np.cumsum(count[short])[:-1]])
        for k in np.flatnonzero(count > SHORT).tolist():
            yield from of_long(*part(slice(first[k], first[k] + count[k])))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0

        def columns(whole: pa.Table) -> dict[str, np.ndarray]:
            c = {k: whole.column(k).to_numpy() for k in _COLUMNS}
            meta = c.pop("meta")
            c |= {"pos": meta & ((1 << 40) - 1), "several": (meta >> 40 & 1).astype(bool), "mixed": (meta >> 41 & 1).astype(bool), "block": meta >> 42}
            return c if turn else c | {"comp": c["gid"]}

        for batch in batches:
            waiting.append(batch)
            rows += len(batch)
            if rows >= 16384:
                whole = pa.Table.from_batches(waiting).combine_chunks()
                token, dealt = whole.column("token").to_numpy(), whole.column("dealt").to_numpy()
                # The last list may go on in the next batch.
                other = np.flatnonzero((token != token[-1]) | (dealt != dealt[-1]))
                stop = int(other[-1]) + 1 if len(other) else 0
                if stop:
                    yield from process(columns(whole.slice(0, stop)))
                rest = whole.slice(stop)
                waiting, rows = rest.to_batches(), min(len(rest), 16383 if stop else 0)
        if waiting and sum(map(len, waiting)):
            yield from process(columns(pa.Table.from_batches(waiting)))

    return lists.mapInArrow(search, PAIRS)


def _needed(ids: DataFrame, size: int) -> np.ndarray:
    """2**size bits, set for each id's hash; others may have set them too."""
    bits = np.zeros(1 << (size - 6), np.uint64)
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << size))
    words = ids.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got = words.toArrow()
    bits[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return bits


def full_sets(docs: DataFrame, size: int, ids: DataFrame, most: int) -> DataFrame:
    """(id, shingles) of the documents in ``ids`` (and, by the filter's mistakes, some others);
    there are at most ``most`` ids, of which the filter has eight bits each.  Of equal rows few
    are given more than once."""
    bits = max(NEEDED_BITS, (8 * most).bit_length())
    source = _source(docs).filter("doc_id IS NOT NULL")
    if bits <= MOST_BITS:
        held = docs.sparkSession.sparkContext.broadcast(_needed(ids, bits))
        source = source.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)))
    else:
        held = None
        source = source.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            if held is not None:
                slot = batch.column(2).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array((held.value[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            if len(batch):
                got, ids = _sets(batch, size), batch.column(0).to_pylist()
                new = []
                for k, (doc, own) in enumerate(zip(ids, got)):
                    key = doc, hash(own.tobytes())
                    if key not in seen:
                        new.append(k)
                        seen.add(key)
                if len(seen) > SEEN:
                    seen.clear()
                got, batch = [got[k] for k in new], batch.take(pa.array(new, pa.int64()))
                if not new:
                    continue
                cut = np.zeros(len(got) + 1, np.int32)
                np.cumsum([len(s) for s in got], out=cut[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(got).view(np.int64)))], names=["id", "shingles"])

    return source.mapInArrow(run, "id long, shingles array<long>")


def verified(docs: DataFrame, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b), a written table, whose sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = full_sets(docs, size, ids, 2 * pairs.count())
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("s"), (F.size("x") + F.size("y")).cast("long").alias("t"))
    return both.filter(F.col("s") * den >= (F.col("t") - F.col("s")) * num).select("a", "b")


_KEY = ["h1", "h2", "n"]


def _joined(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2, n) of each row, and (h1, h2, n, cls, component_id) of each class of equal sets."""
    if not (0 < num <= den) or size < 1:
        raise ValueError("the threshold must lie in (0, 1] and shingles have a word")
    found = materialise(features(docs, size, num, den, count_sketch(docs, size)))

    firsts = [F.first(k).alias(k) for k in ("g", *_MAPS)]
    classes = materialise(found.filter("n > 0 AND doc_id IS NOT NULL").groupBy(*_KEY).agg(F.min("doc_id").alias("cls"), *firsts))
    sums = materialise(classes.groupBy("g", "n").agg(F.min("cls").alias("gid"), F.count("*").alias("members"), *firsts[1:]))
    crowds = sums.filter(F.col("members") > GROUP).select("g", "n")
    alone = classes.join(crowds, ["g", "n"], "left_semi").select("g", "n", F.col("cls").alias("gid"), F.lit(False).alias("several"), *_MAPS)
    grouped = sums.filter(F.col("members") <= GROUP).select("g", "n", "gid", (F.col("members") > 1).alias("several"), *_MAPS)
    own = found.select(F.col("doc_id").alias("gid"), "g", "n", "prefix", "heavy")
    whole = materialise(grouped.unionAll(alone).join(own, ["gid", "g", "n"]).dropDuplicates(["gid", "g", "n"]).withColumn("row", F.xxhash64("gid", "g", "n")).drop("g"))
    # (gid, cls) of the members of groups that have several.
    members = classes.join(sums.filter((F.col("members") > 1) & (F.col("members") <= GROUP)).select("g", "n", "gid"), ["g", "n"]).select("gid", "cls")
    members = materialise(members)
    dealt_out = materialise(long_lists(whole))
    held = materialise(places(whole, dealt_out))
    groups = materialise(whole.drop("prefix", "heavy"))
    rows = materialise(found.select("doc_id", *_KEY))
    release(found, whole)

    def expand(pairs: DataFrame) -> DataFrame:
        """Pairs of classes, from (a, b, grouped) of groups and from within groups."""
        a, b = members.select(F.col("gid").alias("a"), F.col("cls").alias("x")), members.select(F.col("gid").alias("b"), F.col("cls").alias("y"))
        met = pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        left, right = (classes.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), *[F.col(m).alias(f"{m}{k}") for m in _MAPS]) for k in "ab")
        differ = sum((F.bit_count(F.col(f"{m}a").bitwiseXOR(F.col(f"{m}b"))) for m in _MAPS), F.lit(0))
        total = F.col("na") + F.col("nb")
        # Twice the least intersection, rounded up as everywhere.
        least = 2 * F.ceil(num * total / (num + den))
        return met.join(left, "a").join(right, "b").filter(differ <= total - least).select("a", "b")

    links = known = tried = open_lists = None
    turn, used = 0, []
    while True:
        if known is None:
            labelled = groups.withColumns({"comp": F.lit(0).cast("long"), "mixed": F.lit(False)})  # each its own
        else:
            # A group whose members are in several components may link with any.
            label = F.coalesce("component", F.col("cls"))
            of_members = members.join(known.withColumnRenamed("node", "cls"), "cls", "left").select("gid", label.alias("low"))
            both = known.select(F.col("node").alias("gid"), F.col("component").alias("low")).unionAll(of_members)
            labels = materialise(both.groupBy("gid").agg(F.min("low").alias("low"), F.max("low").alias("high")))
            used.append(labels)
            labelled = groups.join(sized(labels), "gid", "left").withColumns({"comp": F.coalesce("low", "gid"), "mixed": F.coalesce(F.col("low") != F.col("high"), F.lit(False))})
        got = materialise(candidate_pairs(postings(labelled, held, open_lists), num, den, turn))
        pairs = got.filter("a IS NOT NULL").select("a", "b", "grouped").distinct()
        wide = pairs.filter("grouped").select("a", "b")
        if turn == 0:
            wide = wide.unionAll(members.select(F.col("gid").alias("a"), F.col("gid").alias("b")).distinct())
        new = pairs.filter("NOT grouped").select("a", "b").unionAll(expand(wide)).distinct()
        new = materialise(new if tried is None else new.join(tried, ["a", "b"], "left_anti"))
        used.append(new)
        if turn == 0 or not new.isEmpty():
            more = materialise(verified(docs, new, size, num, den))
            used.append(more)
            links = more if links is None else links.unionAll(more)
            release(known)
            known = materialise(connected(links))
        tokens = open_lists
        open_lists = materialise(got.filter("token IS NOT NULL").select("token").distinct())
        release(got, tokens)
        if open_lists.isEmpty():
            break
        tried, turn = new if tried is None else tried.unionAll(new), turn + 1
    component = known.select(F.col("node").alias("cls"), "component")
    release(groups, held, sums, members, dealt_out, open_lists, *used)
    return rows, classes.join(component, "cls", "left").select(*_KEY, "cls", F.coalesce("component", "cls").alias("component_id"))


def _by_row(found: DataFrame, labels: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(doc_id, n_shingles, component_id) and the other columns of ``labels``, for each row;
    ``columns`` has what they are where a row has no class."""
    rows = found.select("doc_id", *_KEY)
    head = ["doc_id", F.col("n").alias("n_shingles")]
    linked = rows.filter("n > 0 AND doc_id IS NOT NULL").join(labels, _KEY).select(*head, "component_id", *columns)
    alone = rows.filter("NOT (n > 0 AND doc_id IS NOT NULL)").select(*head, F.col("doc_id").alias("component_id"), *[c.alias(k) for k, c in columns.items()])
    return linked.unionAll(alone)


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of (doc_id, text): documents link when
    den * |intersection| >= num * |union| of their shingles of ``size`` words."""
    found, labels = _joined(docs, size, num, den)
    return _by_row(found, labels.select(*_KEY, "component_id"), {})


def _linked(ids: np.ndarray, block: np.ndarray, sets: list[np.ndarray], crossed: bool, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the sets that are similar enough; if ``crossed``, of different blocks."""
    n, count = np.array([len(s) for s in sets]), len(sets)
    row = np.repeat(np.arange(count), n)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    row, flat = row[order], flat[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    held = np.diff(np.r_[first, len(flat)])
    shared = np.zeros((count, count), np.int32)
    # Shingles that few sets hold are counted pair by pair ...
    few = np.repeat((held > 1) & (held <= 32), held)
    own, column = row[few], np.repeat(np.arange(len(held)), held)[few]
    for step in range(1, 32):
        at = np.flatnonzero(column[step:] == column[:-step]) if step < len(column) else ()
        if not len(at):
            break
        np.add.at(shared, (own[at], own[at + step]), 1)
    # ... those that many hold by products of a dense table, some columns at a time.
    many, wide = np.flatnonzero(held > 32), 2048
    for low in range(0, len(many), wide):
        part = many[low : low + wide]
        dense = np.zeros((count, len(part)), np.float32)
        for k, c in enumerate(part.tolist()):
            dense[row[first[c] : first[c] + held[c]], k] = 1
        shared += np.triu(dense @ dense.T, 1).astype(np.int32)
    i, j = np.nonzero(shared)
    both = shared[i, j].astype(np.int64)
    ok = (both * den >= (n[i] + n[j] - both) * num) & (ids[i] != ids[j])
    if crossed:
        ok &= block[i] != block[j]
    return i[ok], j[ok]


def _all_links(docs: DataFrame, labels: DataFrame, size: int, num: int, den: int, count: bool) -> DataFrame:
    """Every link between classes, once, as (a, b); with ``count``, as (a, b = its links) summed over a cell."""
    members = labels.groupBy("component_id").agg(F.count("*").alias("held"), F.sum("n").alias("volume")).filter("held > 1")
    parts = F.greatest(F.ceil(F.col("held") / CELL), F.ceil(F.col("volume") / CELL_SHINGLES)).cast("int")
    several = materialise(labels.join(members, "component_id").select("cls", "component_id", parts.alias("parts")).distinct())
    sets = full_sets(docs, size, several.select(F.col("cls").alias("id")), several.count())
    own = several.join(sets, F.col("cls") == F.col("id")).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("parts")).cast("int"))
    dealt = own.select("component_id", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "cls", "shingles")
    cells = dealt.select("component_id", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cls", "shingles")
    cells = cells.repartition("component_id", "low", "high").sortWithinPartitions("component_id", "low", "high")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, int, np.ndarray]] = []
        cell: tuple | None = None

        def done() -> Iterator[pa.RecordBatch]:
            if len(waiting) < 2:
                return
            ids, block, held = zip(*waiting)
            ids = np.array(ids)
            i, j = _linked(ids, np.array(block), list(held), cell[1] != cell[2], num, den)
            if len(np.unique(ids)) < len(ids):  # rows that repeat an id, with other texts
                pairs = np.unique(np.column_stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]), axis=0)
                ids, at = np.unique(pairs, return_inverse=True)
                i, j = at.reshape(-1, 2).T
            if count:
                links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                a, b = ids[links > 0], links[links > 0]
            else:
                a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            shingles = batch.column(5)
            for i, (component, low, high, block, cls) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)))):
                if (component, low, high) != cell:
                    yield from done()
                    waiting, cell = [], (component, low, high)
                waiting.append((cls, block, shingles[i].values.to_numpy().copy()))
        yield from done()

    return cells.mapInArrow(verify, "a long, b long")


def near_links(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """What ``near_duplicates`` gives, with class_id, the least document of an equal set, and n_links,
    how many other classes that one is linked with; no link is left out."""
    found, labels = _joined(docs, size, num, den)
    labels = materialise(labels)
    links = _all_links(docs, labels, size, num, den, True).groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("n_links"))
    whole = labels.join(links, "cls", "left").select(*_KEY, "component_id", F.col("cls").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return _by_row(found, whole, {"class_id": F.col("doc_id"), "n_links": F.lit(0).cast("long")})


def near_pairs(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(a, b), a < b, of all pairs of classes that are linked; ``near_links`` tells each row's class."""
    return _all_links(docs, materialise(_joined(docs, size, num, den)[1]), size, num, den, False)


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with only the least doc_id of each component; rows of a null doc_id stay."""
    found = near_duplicates(docs, size, num, den)
    gone = fresh(docs, "gone")
    others = materialise(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(sized(others), F.col("doc_id").cast("long") == F.col(gone), "left_anti")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(table(spark, sf_dir, "documents"), 3, 90, 100)


#: Equal sets first become one class; the least node of a component has no lesser neighbour, so only
#: such nodes are spread along the links.
OP1_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
  FROM texts
), keyed AS (
  SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS h, s FROM sets
), classes AS (
  SELECT h, n, min(doc_id) AS cls, any_value(s) AS s FROM keyed WHERE n > 0 AND doc_id IS NOT NULL GROUP BY h, n
), members AS (
  SELECT cls, n, unnest(s) AS shingle FROM classes
), links AS (
  SELECT x.cls AS a, y.cls AS b FROM members x JOIN members y USING (shingle)
  WHERE x.cls <> y.cls AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY x.cls, y.cls, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach AS (
  SELECT cls AS node, cls AS least FROM classes WHERE cls NOT IN (SELECT a FROM links WHERE b < a)
  UNION
  SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.node
), least_of AS (
  SELECT node, min(least) AS component_id FROM reach GROUP BY node
)
SELECT k.doc_id, k.n AS n_shingles, coalesce(m.component_id, k.doc_id) AS component_id, coalesce(c.cls, k.doc_id) AS class_id, coalesce(d.n_links, 0) AS n_links
FROM keyed k LEFT JOIN classes c ON c.h = k.h AND c.n = k.n AND k.n > 0 AND k.doc_id IS NOT NULL LEFT JOIN least_of m ON m.node = c.cls
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) d ON d.a = c.cls
"""

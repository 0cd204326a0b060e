"""Near duplicates by bottom-k sketches of one hash function."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bloom_build, bloom_pass, bloom_size, bounded, counted, cut, plain, row_names, small, tidy

#: Bytes of text that are hashed together, shingles that are counted together.
TOGETHER, CHUNK = 1 << 18, 1 << 21
#: Values that are seen again come last in the order of all values, the commonest at the very end; only so many of them,
#: the commonest, are told to the workers. The order decides what is compared first, never the result.
MOST_COMMON = 1 << 20
#: Bits of a class's parity map: bit i tells whether an odd number of the set's values fall on i.
PARITY = 1024
#: Values that two sets which link share at least among those that are retained (if they have so many in common).
SHARED = 3
#: Lists up to CLOSE are compared pair by pair; of lists up to PAIRED, members that are not in their hub's component are.
CLOSE, PAIRED = 12, 64
#: Members of an index list that one task orders together; pairs for each member from which on neighbours are linked first.
BLOCK, MANY = 1024, 32
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
ONE, GOLDEN = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of each word of the texts, one text after the other, and the number of words before each text and in all."""
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    inside = ~SPACE[data]
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
    before = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    if not len(starts):
        return np.empty(0, np.uint64), before
    letters = np.flatnonzero(inside)
    first = np.searchsorted(letters, starts)
    sizes = np.diff(first, append=len(letters))
    place = (letters - np.repeat(starts, sizes)).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(BYTES[data[letters]] + place * GOLDEN), first) + sizes.astype(np.uint64)), before


def chained(w: np.ndarray, size: int) -> np.ndarray:
    """63 bits of every run of so many words."""
    h = np.full(max(0, len(w) - size + 1), size, np.uint64)
    for k in range(size):
        h = mixed(h * GOLDEN + w[k : len(w) - size + 1 + k])
    return (h >> ONE).view(np.int64)


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a shorter text is one shingle, one without words none.

    Bytes are split at ASCII white space and A-Z are lower-cased, nothing else is.
    """
    held, size = [], 0
    for k, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size < TOGETHER and k < len(texts) - 1:
            continue
        w, before = word_hashes(held)
        h = chained(w, words)
        for lo, hi in zip(before[:-1], before[1:], strict=True):
            yield np.unique(h[lo : hi - words + 1]) if hi - lo >= words else chained(w[lo:hi], hi - lo) if hi > lo else np.empty(0, np.int64)
        held, size = [], 0


def retained(n: int, percent: int) -> int:
    """Of two sets that link, the first so many values of each, in one order of all values, have SHARED in common."""
    return min(n, n - -(-n * percent // 100) + SHARED)


def counter(words: int, percent: int):
    """Of a partition, the low values that a chunk of its texts has more than once, with their counts.

    Low is what twice as long sketches would retain: where many values are common, sketches reach farther.
    """

    def counted_low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[often]), pa.array(counts[often])], ["v", "n"])

        for batch in batches:
            for h in shingle_sets(batch.column("text").to_pylist(), words):
                held.append(h[: 2 * retained(len(h), percent)])
                n += len(held[-1])
                if n >= CHUNK:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return counted_low


def sketcher(words: int, percent: int, common: np.ndarray, ranks: np.ndarray):
    """Each row's columns but the text, and of its set the size n, a digest (d1, d2), the retained values
    (sketch), how many of those are not common (own), and the parity map of the whole set.

    The values are in their order: the sign bit is set on all that are not common, so those come first; common values
    (sorted) are replaced by their ranks among each other.
    """

    def parted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those that are not common, and the ranks of those that are."""
        if not len(common):
            return h, h[:0]
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        often = common[at] == h
        return h[~often], ranks[at[often]]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, owns, digests, sketches, maps = [], [], [], [], []
            for h in shingle_sets(batch.column("text").to_pylist(), words):
                k = retained(len(h), percent)
                light, known = parted(h[: 2 * k])
                if len(light) < k:
                    light, known = parted(h)
                sizes.append(len(h))
                maps.append(np.packbits(np.bincount(h & (PARITY - 1), minlength=PARITY) & 1).view(np.int64))
                owns.append(min(k, len(light)))
                sketches.append(np.concatenate((light | np.int64(-(1 << 63)), np.sort(known)))[:k])
                digests.append(np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64))
            both = np.array(digests, np.int64).reshape(-1, 2)
            rest = [c for c in batch.schema.names if c != "text"]
            arrays = [batch.column(c) for c in rest] + [pa.array(sizes, pa.int32()), pa.array(owns, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), lists(sketches), lists(maps)]
            yield pa.RecordBatch.from_arrays(arrays, [*rest, "n", "own", "d1", "d2", "sketch", "parity"])

    return sketch


def setter(words: int):
    """(cid, text) -> (cid, set), each cid of a partition once."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new: dict[int, str] = {}
            for cid, text in zip(batch.column("cid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if cid not in seen:
                    seen.add(cid)
                    new[cid] = text
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), lists([*shingle_sets([*new.values()], words)])], ["cid", "set"])

    return made


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node reachable. Large-star and small-star steps."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = state(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        few = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.withColumnRenamed("m", "v"))
        now = cut(few.where("u != v").distinct())
        if (then := state(now)) == was:
            break
        was = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


class NearDuplicates:
    """Links between documents whose sets of word shingles have a Jaccard similarity of percent/100 or more.

    Documents of one set are one class. Its sketch retains the first values of the set in one order of all values, by
    their hash with common ones last: as many as make two classes that link share SHARED of them for certain. Inverted
    lists hold the classes under their retained values. First, members of long lists meet hubs: the class of the list
    with the fewest values that are not common, the likeliest original of a group of copies, and of some very long
    lists one by hash. Then all pairs of different components are counted over the short lists, and over the longer ones where one
    of them is not in the hub's component; those that share enough are compared. A pair that shares less in them shares
    a very long list, whose members outside the hub's component are matched by an index of the full sets; while its lists
    would give many pairs, neighbours in them are linked first, since only pairs of different components count. The parity
    maps of two sets, and their sketches up to the place where both are complete, bound how much the sets differ at
    least; pairs that differ too much go, the full sets of the others decide. No link is lost.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int):
        self.words, self.percent = words, percent
        text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        self.docs = plain(docs, doc_id=id_col, text=text, **row_names(text))
        counts = self.docs.select("text").mapInArrow(tidy(counter(words, percent)), "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
        common = counts.orderBy(F.desc("n"), "v").limit(MOST_COMMON).select("v").toArrow().column("v").to_numpy()[::-1]
        place = np.argsort(common)
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        self.rows = cut(self.docs.mapInArrow(tidy(sketcher(words, percent, common[place], place)), f"doc_id {kind}, t1 long, t2 long, n int, own int, d1 long, d2 long, sketch array<long>, parity array<long>"))
        each = self.rows.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.min(F.struct("t1", "t2")).alias("t"), *[F.any_value(c).alias(c) for c in ("n", "own", "sketch", "parity")])
        self.classes = cut(each.select(F.monotonically_increasing_id().alias("cid"), "d1", "d2", "first", "t.*", "n", "own", "sketch", "parity"))

    def lists(self) -> DataFrame:
        """(v, cid, n, hub, other, m): the inverted lists of values that more than one class retains, their hubs and lengths."""
        # own counts and class numbers in one long, so that the least of them is found by a hash aggregation
        key = F.shiftleft(F.least("own", F.lit(127)).cast("long"), 56).bitwiseOR(F.col("cid"))
        posted = self.classes.select("cid", "n", key.alias("key"), F.explode("sketch").alias("v"))
        shared = posted.groupBy("v").agg(F.count("*").alias("m"), F.min("key").alias("least"), F.min_by("cid", F.xxhash64("cid", "v")).alias("other")).where("m > 1")
        return cut(posted.select("v", "cid", "n").join(shared, "v").select("v", "cid", "n", F.col("least").bitwiseAND(F.lit((1 << 56) - 1)).alias("hub"), "other", "m"))

    def alike(self, a: str, b: str) -> Column:
        """Whether sets of so many values can link."""
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link. Parity maps and the sketch of the union filter them, the full sets decide.

        Sets of n_a and n_b values link if no more than (1 - t) / (1 + t) * (n_a + n_b) values are in one of them only.
        Each bit in which the parity maps differ stands for such a value; and up to the last value of the sketch that
        ends first, both sketches are complete: what differs there differs.
        """

        def beside(pairs: DataFrame, n: int, column: str) -> DataFrame:
            used = bounded(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), 2 * n)
            held = self.classes.select("cid", "n", column).join(used, "cid", "left_semi") if n <= BROADCAST_ROWS else self.classes
            side = lambda x: held.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col(column).alias(f"of_{x}"))
            return bounded(pairs, n).join(side("a"), "a").join(side("b"), "b")

        few = lambda apart: (100 + self.percent) * apart <= (100 - self.percent) * (F.col("n_a") + F.col("n_b"))
        apart = F.aggregate(F.zip_with("of_a", "of_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        pairs, n = counted(beside(*counted(pairs), "parity").where(self.alike("n_a", "n_b") & few(apart)).select("a", "b"))
        both = beside(pairs, n, "sketch").withColumn("last", F.least(F.element_at("of_a", -1), F.element_at("of_b", -1)))
        size = lambda values: F.size(F.filter(values, lambda v: v <= F.col("last")))
        likely, n = counted(both.where(few(size(F.array_union("of_a", "of_b")) - size(F.array_intersect("of_a", "of_b")))).select("a", "b"))
        sets = self.sets(likely.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), 2 * n)
        side = lambda x: sets.select(F.col("cid").alias(x), F.col("set").alias(f"set_{x}"))
        sized = likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("common"), (F.size("set_a") + F.size("set_b")).alias("n"))
        return sized.where(100 * F.col("common") >= self.percent * (F.col("n") - F.col("common"))).select("a", "b")

    def sets(self, ids: DataFrame, most: int) -> DataFrame:
        """(cid, set) of the named classes, at most so many; of many, a filter keeps most other texts out of the shuffle."""
        ids, texts = self.classes.select("cid", "t1", "t2").join(bounded(ids, most), "cid", "left_semi"), self.docs.select("text", "t1", "t2")
        if most > BROADCAST_ROWS:
            ids, n = counted(ids)
            hashes, blocks = ids.select(F.col("t1").alias("h")), bloom_size(n)
            texts = bloom_pass(texts.withColumn("h", F.col("t1")), "h", bloom_build(hashes, "h", blocks), blocks).drop("h")
        made = texts.join(bounded(ids, most), ["t1", "t2"]).select("cid", "text").mapInArrow(tidy(setter(self.words)), "cid long, set array<long>")
        return cut(made.groupBy("cid").agg(F.any_value("set").alias("set")))

    def links(self) -> DataFrame:
        """Links (a, b) that hold together what belongs together."""
        listed = self.lists()
        star = lambda hub, least, some=F.lit(True): listed.where((F.col("m") > least) & (F.col("cid") != F.col(hub)) & some).groupBy(F.col("cid").alias("a"), F.col(hub).alias("b")).agg(F.count("*").alias("x"))
        links, n = counted(self.linked(star("hub", CLOSE).where(F.col("x") >= SHARED).unionByName(star("other", PAIRED, F.pmod(F.xxhash64("v"), F.lit(8)) == 0)).select("a", "b").distinct()))
        found = bounded(components(links), n)
        of = lambda x, name: found.select(F.col("node").alias(x), F.col("component").alias(name))
        named = listed.join(of("cid", "c"), "cid", "left").join(of("hub", "c_hub"), "hub", "left")
        c = F.coalesce("c", "cid")
        named = cut(named.select("v", "m", "n", "cid", c.alias("c"), (c != F.coalesce("c_hub", "hub")).alias("minor")))
        met, pairs = self.indexed(named.where(F.col("m") > PAIRED))
        more, n = counted(self.paired(named.where(F.col("m") <= PAIRED)).unionByName(pairs).distinct())
        links = links if met is None else links.unionByName(met)
        return links.unionByName(self.linked(more)) if n else links

    def paired(self, members: DataFrame) -> DataFrame:
        """Pairs of different components that share enough of these lists. In longer ones, one of a pair is a minor."""
        side = lambda x: members.select("v", "m", *[F.col(k).alias(f"{k}_{x}") for k in ("cid", "n", "c", "minor")])
        asked = side(1).where((F.col("m") <= CLOSE) | F.col("minor_1")).drop("m")
        once = F.when((F.col("m") <= CLOSE) | F.col("minor_2"), F.col("cid_1") < F.col("cid_2")).otherwise(True)
        both = asked.join(side(2), "v").where((F.col("c_1") != F.col("c_2")) & once & self.alike("n_1", "n_2"))
        need = F.ceil(self.percent / (100 + self.percent) * (F.col("n_1") + F.col("n_2")) - 1e-9)
        pairs = both.groupBy(F.least("cid_1", "cid_2").alias("a"), F.greatest("cid_1", "cid_2").alias("b"), need.alias("need")).agg(F.count("*").alias("x"))
        return pairs.where(F.col("x") >= F.least("need", F.lit(SHARED))).select("a", "b")

    def indexed(self, members: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """Links, and pairs of different components that share a list in which one of them is not in the hub's, and may still link.

        The members of such lists are indexed by their full sets: ranked rarest first among them, two sets that link
        share a shingle whose rank on both sides leaves room for all that they must have in common. A copy with too many
        shingles of its own has no such shingle, so the far members of a group of copies drop out here. In each list of
        the index, members outside its commonest component meet all others.
        """
        open_ = members.where("minor").select("v").distinct()
        each, n = counted(members.join(open_, "v", "left_semi").groupBy("cid").agg(F.any_value("c").alias("c"), F.max("minor").alias("minor")))
        if not n:
            return None, each.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
        sets = self.sets(each.select("cid"), n)
        posted = cut(each.join(sets, "cid").select("cid", "minor", F.size("set").alias("n"), F.explode("set").alias("v")))
        counts = posted.groupBy("v").agg(F.count("*").alias("df"), F.max("minor").alias("asked")).where("df > 1")
        w = Window.partitionBy("cid")
        shared = posted.join(counts, "v").withColumn("rank", F.col("n") - F.count("*").over(w) + F.row_number().over(w.orderBy("df", "v")))
        first = cut(shared.where(F.col("asked") & (F.col("rank") <= F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1)).select("v", "df", "cid", "minor", "n", "rank"))
        of, links, was = each.select("cid", "c"), None, None
        for turn in count():
            open_, pairs, rows = self.mixed_lists(first, of, n)
            if pairs <= MANY * rows or (was and pairs > 0.9 * was):
                break
            was, first = pairs, open_.drop("c", "most")  # components only grow together, so a list of one stays that
            found = cut(self.linked(self.neighbours(open_, turn)))
            links = found if links is None else links.unionByName(found)
            joined = components(found.unionByName(of.select(F.col("cid").alias("a"), F.col("c").alias("b"))))
            of = cut(of.select("cid").join(joined, F.col("cid") == F.col("node"), "left").select("cid", F.coalesce("component", "cid").alias("c")))
        side = lambda df, x: df.select("v", *[F.col(k).alias(f"{k}_{x}") for k in ("cid", "c", "minor", "n", "rank", "most")])
        # what a member can have in common bounds its partners' sizes: one none of whose ranks fits the least of them is out
        room = F.col("n") - F.ceil(self.percent / (100 + self.percent) * (F.col("n") + F.ceil(F.col("n") * self.percent / 100)) - 1e-9) + 1
        once = (F.col("c_2") == F.col("most_2")) | (F.col("cid_1") < F.col("cid_2"))
        both = side(open_.where((F.col("c") != F.col("most")) & (F.col("rank") <= room)), 1).join(side(open_, 2), "v").where(once & self.meet())
        return links, both.select(F.least("cid_1", "cid_2").alias("a"), F.greatest("cid_1", "cid_2").alias("b")).distinct()

    def meet(self) -> Column:
        """Whether two members of a list of the index, of different components, may link by their ranks in it."""
        need = F.ceil(self.percent / (100 + self.percent) * (F.col("n_1") + F.col("n_2")) - 1e-9)
        fits = lambda x: F.col(f"rank_{x}") <= F.col(f"n_{x}") - need + 1
        return (F.col("c_1") != F.col("c_2")) & (F.col("minor_1") | F.col("minor_2")) & fits(1) & fits(2)

    def mixed_lists(self, first: DataFrame, of: DataFrame, n: int) -> tuple[DataFrame, int, int]:
        """The lists of more than one component, with each member's component (c) and the list's commonest one (most);
        the pairs that they would give at most, and their rows."""
        named = cut(first.join(bounded(of, n), "cid"))
        each = named.groupBy("v", "c").agg(F.count("*").alias("x")).groupBy("v").agg(F.max(F.struct("x", "c")).alias("top"), F.sum("x").alias("m"))
        open_ = each.where("top.x < m").select("v", F.col("top.c").alias("most"), ((F.col("m") - F.col("top.x")) * F.col("m")).alias("pairs"), "m")
        open_ = cut(open_)
        pairs, rows = open_.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
        return cut(named.join(open_.select("v", "most"), "v")), pairs, rows

    def neighbours(self, lists: DataFrame, turn: int) -> DataFrame:
        """Pairs (a, b) of members that stand near each other when lists are ordered by the turn's hash, a block at a time.

        Only members whose rank leaves room for a partner of their own size take part.
        """
        order = F.xxhash64("cid", "v", F.lit(turn))
        block = F.pmod(order, F.ceil(F.col("df") / BLOCK)).alias("block")
        near = F.col("rank") <= F.col("n") - F.ceil(2 * F.col("n") * self.percent / (100 + self.percent) - 1e-9) + 1
        kept = ("cid", "c", "minor", "n", "rank")
        now = lists.where(near).select("v", block, order.alias("order"), *[F.col(k).alias(f"{k}_1") for k in kept])
        w = Window.partitionBy("v", "block").orderBy("order", "cid_1")
        pairs = [now.withColumns({f"{k}_2": F.lead(f"{k}_1", step).over(w) for k in kept}) for step in (1, 2)]
        beside = pairs[0].unionByName(pairs[1]).where(self.meet())
        return beside.select(F.least("cid_1", "cid_2").alias("a"), F.greatest("cid_1", "cid_2").alias("b")).distinct()

    def named(self) -> DataFrame:
        """(d1, d2, component, least): of each class its component, and the smallest id of all in it."""
        found, n = counted(components(self.links()))
        found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "cid")
        of = self.classes.select("cid", "d1", "d2", "first").join(bounded(found, 2 * n), "cid", "left")
        least = of.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
        of = of.join(bounded(least, n), "component", "left")
        return of.select("d1", "d2", F.coalesce("component", "cid").alias("component"), F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("least")).alias("least"))

    def labelled(self) -> DataFrame:
        out = self.rows.select("doc_id", "n", "d1", "d2").join(self.named(), ["d1", "d2"], "left")
        component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least"))
        return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

    def gone(self) -> tuple[DataFrame, DataFrame]:
        """Rows (doc_id, t1, t2) of components of which another row stays; rows that stay but are there several times."""
        each = self.rows.where("n > 0").groupBy("doc_id", "t1", "t2", "d1", "d2").agg(F.count("*").alias("copies"))
        each = cut(each.join(self.named(), ["d1", "d2"]).select("component", "doc_id", "t1", "t2", "copies"))
        first = each.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("x"), F.count("*").alias("rows"))
        first = first.where("rows > 1").select("component", F.col("x.doc_id").alias("id"), F.col("x.t1").alias("u1"), F.col("x.t2").alias("u2"))
        apart = ~(F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")))
        gone = cut(each.join(small(cut(first)), "component").where(apart).select("doc_id", "t1", "t2"))
        return gone, each.where("copies > 1").select("doc_id", "t1", "t2")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are what white space parts, A-Z lower-cased. Null text counts as empty; a document without words links with
    nothing. component_id is the smallest id of the rows of a component; rows without an id link like others, and their
    component_id is null (and they are kept) where no row of their component has one. Rows that share an id but not the
    text are judged each by its own text. Very long texts are read whole.
    """
    return NearDuplicates(docs, id_col, text_col, words, percent).labelled()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, but one of each component only: the first by id, rows without an id last.

    Rows are told apart by id and text, so rows that share an id, or have none, stay or go by themselves; of rows that
    repeat both, one stays. Texts without words all stay.
    """
    gone, several = NearDuplicates(docs, id_col, text_col, words, percent).gone()
    names = {f"_quillon_{k}": c for k, c in row_names(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).items()}
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_quillon_id")) & (F.col("_quillon_t1") == F.col("_quillon_u1")) & (F.col("_quillon_t2") == F.col("_quillon_u2"))
    keys = lambda df: small(df.select(F.col("doc_id").alias("_quillon_id"), F.col("t1").alias("_quillon_u1"), F.col("t2").alias("_quillon_u2")))
    left = docs.withColumns(names).join(keys(gone), same, "left_anti")
    if several.isEmpty():
        return left.select(*docs.columns)
    once = Window.partitionBy(F.col(f"`{id_col}`"), "_quillon_t1", "_quillon_t2").orderBy(F.lit(1))
    repeated = left.join(keys(several), same, "left_semi").withColumn("_quillon_n", F.row_number().over(once)).where("_quillon_n = 1")
    return left.join(keys(several), same, "left_anti").select(*docs.columns).unionByName(repeated.select(*docs.columns))

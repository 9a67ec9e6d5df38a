"""Set-similarity self-join of documents on word n-grams.

A document's n-grams are put in one order for all documents, rare first: by
the frequency of their bucket in a table of fixed size, then by hash. Two
documents whose Jaccard similarity reaches t share one of the first
n - ceil(t n) + 1 of either (the prefix), so documents meet on prefix n-grams
only. Pairs that meet pass a length, a positional and a suffix filter before
their whole sets are compared, once.

Equal sets are one class and meet as one. Classes that meet at an n-gram of
few classes are paired there and then, and each pair counts its n-grams: with
all prefix n-grams that two classes share known, what is left of the longer
set bounds their intersection, which few pairs pass but near copies. Where
many classes meet, stars go first: one class is compared with the others, and
those that prove linked are one component. Only classes of different
components are then compared with each other, so a large group of near copies
takes a number of comparisons in proportion to its size, and no link between
components is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import exchange as X
from . import kernels as K
from .common import finished, keyed, lean, row_key, settled, type_of
from .components import components

#: Buckets of the frequency table that orders n-grams: its size, and what is broadcast, does not follow the data.
BUCKETS = 1 << 21
_SEGMENTS = 32
#: An n-gram that at most so many classes share pairs them at once; others go by stars.
FEW = 24
#: Longs of a sketch. A power of two.
SKETCH = 16
_SKETCH = [f"q{i}" for i in range(SKETCH)]
#: Rounds of stars before all pairs of different components, and the hubs of a star.
STARS, HUBS = 2, 32
#: Classes of one n-gram and length that a part of the last join holds, about.
CROWD = 512
#: Row keys of this many documents at most are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1 << 20


def prefix_length(n, percent: int):
    return n - -(-n * percent // 100) + 1


def need(total, percent: int):
    """The least intersection of two sets of so many elements together that reaches the similarity."""
    return -(-total * percent // (100 + percent))


def shingles(data: np.ndarray, offs: np.ndarray, size: int):
    """For each document the sorted distinct hashes of its n-grams; with fewer words than `size`, of all its words at once."""
    _, _, firsts, hashes = K.word_hashes(data, offs, lower=True)
    grams = K.windows(hashes, size)
    out = []
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(K.mix(K.windows(hashes[a:b], int(b - a)) + K.U(b - a)))
        else:
            out.append(grams[:0])
    return out


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> K.U(43)).astype(np.int64) % BUCKETS


def ordered(hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The n-grams in the common order: ten bits of frequency rank, then the hash."""
    return np.sort((ranks[bucket(hashes)].astype(K.U) << K.U(54)) | (hashes & K.U((1 << 54) - 1)))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Whether the set has an odd number of elements in each of SKETCH * 64 parts of the universe, as SKETCH longs.

    Two sketches differ in no more bits than the sets in elements.
    """
    odd = np.bincount((tokens & K.U(SKETCH * 64 - 1)).astype(np.int64), minlength=SKETCH * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def survey(size: int, id_type: pa.DataType):
    """A mapInArrow function over (k, id, body): the class and size of each document, and the task's n-gram counts by bucket."""

    names = ["k", "id", "s", "n", *_SKETCH, "segment", "counts"]

    def run(batches):
        counts = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            keys, ids = batch.column(0), batch.column(1)
            for lo, hi, data, offs in K.slices(batch.column(2).cast(pa.large_binary()).cast(pa.large_string())):
                sets = shingles(data, offs, size)
                counts += np.bincount(bucket(np.concatenate(sets)), minlength=BUCKETS).astype(np.uint32)
                classes = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
                n = hi - lo
                yield pa.RecordBatch.from_arrays([keys[lo:hi], ids[lo:hi], pa.array(np.array(classes, np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, np.stack([sketch(s) for s in sets]).T.copy()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if counts.any():
            pressed = zstandard.ZstdCompressor(level=1)
            parts = counts.reshape(_SEGMENTS, -1)
            none = pa.nulls(_SEGMENTS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.nulls(_SEGMENTS, id_type), *[none] * (2 + SKETCH), pa.array(range(_SEGMENTS), pa.int32()), pa.array([pressed.compress(p.tobytes()) for p in parts], pa.binary())], names=names)

    return run


def ranks_of(surveyed: DataFrame) -> np.ndarray:
    """Frequency ranks, 0 to 1023, of the buckets."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        loose = zstandard.ZstdDecompressor()
        for batch in batches:
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[s] = total.get(s, 0) + np.frombuffer(loose.decompress(x.as_py()), np.uint32).astype(np.int64)
        for s, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["segment", "counts"])

    summed = surveyed.where("segment is not null").select("segment", "counts").repartition(_SEGMENTS, "segment").mapInArrow(lean(add), "segment int, counts binary")
    counts = np.zeros(BUCKETS, np.int64)
    for row in summed.collect():  # _SEGMENTS rows, BUCKETS counts in all
        counts[row[0] * (BUCKETS // _SEGMENTS) :][: BUCKETS // _SEGMENTS] = np.frombuffer(bytes(row[1]), np.int64)
    base = max(1.0, float(np.median(counts)))
    return np.clip(np.log2(np.maximum(counts, 1) / base) * 32 + 256, 0, 1023).astype(np.uint16)


def send_prefixes(parts: int, size: int, percent: int, table):
    """A mapInArrow function over (k, body): prefix n-grams of each class that the task holds, packed by n-gram."""

    def run(batches):
        ranks, out, seen = table.value, X.Sender(parts), set()
        for batch in batches:
            for _, _, data, offs in K.slices(batch.column(1).cast(pa.large_binary()).cast(pa.large_string())):
                classes, tokens, sizes = [], [], []
                for s in shingles(data, offs, size):
                    own = xxhash.xxh3_64_intdigest(s.tobytes())
                    if len(s) and own not in seen:
                        seen.add(own)
                        classes.append(own)
                        sizes.append(len(s))
                        tokens.append(ordered(s, ranks)[: prefix_length(len(s), percent)])
                if not classes:
                    continue
                lengths = [len(t) for t in tokens]
                doc = np.repeat(np.arange(len(classes)), lengths)
                place = np.concatenate([np.arange(n) for n in lengths]).astype(np.uint32)
                token = np.concatenate(tokens)
                if out.add(np.array(classes, np.uint64).view(np.int64), doc, X.to_part(K.mix(token), parts), token, np.array(sizes, np.uint32)[doc], place):
                    yield from out.send()
        yield from out.send()

    return run


def meet(few: int):
    """A mapInArrow function over dealt prefixes.

    Pairs of the classes that share an n-gram with at most `few` (t null): how
    many such n-grams of this part the pair shares, and the sizes. Of n-grams
    that more classes share, an entry for each class (t is the n-gram, a the
    class, a_n its size, shared its place).
    """
    names = ["t", "a", "b", "a_n", "b_n", "shared"]

    def run(batches):
        for blobs in X.by_part(batches):
            found = [X.unpack(b) for b in blobs]
            classes = np.concatenate([np.repeat(x[0], x[1]) for x in found])
            token, n, place = (np.concatenate([x[i] for x in found]) for i in (2, 3, 4))
            del found, blobs
            order = np.lexsort((classes, token))
            token, classes, n, place = token[order], classes[order], n[order].astype(np.int64), place[order].astype(np.int64)
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (classes[1:] != classes[:-1])
            token, classes, n, place = token[fresh], classes[fresh], n[fresh], place[fresh]
            begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
            size = np.diff(np.append(begin, len(token)))
            run_of = np.repeat(np.arange(len(begin)), size)
            at = np.flatnonzero(size[run_of] > few) if len(token) else begin
            for lo in range(0, len(at), 1 << 16):
                x = at[lo : lo + (1 << 16)]
                none = pa.nulls(len(x), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(token[x].view(np.int64)), pa.array(classes[x]), none, pa.array(n[x]), none, pa.array(place[x])], names=names)
            # pairs at distance d within the runs that have so many
            left, right = [], []
            for d in range(1, few):
                i = np.flatnonzero((size[run_of] <= few) & (size[run_of] > d)) if len(token) else begin
                i = i[i - begin[run_of[i]] + d < size[run_of[i]]]
                if not len(i):
                    break
                left.append(i)
                right.append(i + d)
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                order = np.lexsort((classes[j], classes[i]))
                i, j = i[order], j[order]
                a, b = classes[i], classes[j]
                first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                shared = np.diff(np.append(first, len(a)))
                for lo in range(0, len(first), 1 << 16):
                    x = first[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.array(a[x]), pa.array(b[x]), pa.array(n[i[x]]), pa.array(n[j[x]]), pa.array(shared[lo : lo + (1 << 16)])], names=names)

    return run


def length_passes(percent: int):
    return F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent


def passes(percent: int):
    """The length and positional filters for classes a and b that meet at an n-gram."""
    total = F.col("a_n") + F.col("b_n")
    bound = F.least("a_place", "b_place") + F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    return length_passes(percent) & (bound * (100 + percent) >= total * percent)


def indexed(percent: int):
    """The shorter prefix that a set needs against sets no smaller: of two similar sets that of the smaller meets the prefix of the other."""
    return F.col("place") * (100 + percent) <= F.col("n") * (100 - percent)


def suffix_passes(percent: int):
    """The suffix filter: the sketches of classes a and b differ in no more bits than two sets so similar may in elements."""
    apart = sum((F.bit_count(F.col(f"a_{q}").bitwiseXOR(F.col(f"b_{q}"))) for q in _SKETCH), F.lit(0))
    total = F.col("a_n") + F.col("b_n")
    return (total - apart) * (100 + percent) >= F.lit(2 * percent) * total


def compare(percent: int):
    """A mapInArrow function over (a, b, a_set, b_set): the pairs that are similar enough."""

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            keep = []
            for i in range(len(a)):
                u, v = np.frombuffer(x[i].as_py(), K.U), np.frombuffer(y[i].as_py(), K.U)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(both * 100 >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def grouped(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(k, id, n, c): each document's row key, id, number of n-grams and component, a class; documents without n-grams share classes but are no component."""
    spark = docs.sparkSession
    parts, kind = X.parts_of(spark), type_of(docs, id_col)
    rows = keyed(docs, id_col, text_col)

    surveyed = settled(rows.mapInArrow(lean(survey(size, to_arrow_type(docs.schema[id_col].dataType))), f"k long, id {kind}, s long, n long, {', '.join(f'{q} long' for q in _SKETCH)}, segment int, counts binary"), "classes")
    classes = surveyed.where("segment is null").select("k", "id", "s", "n", *_SKETCH)
    table = spark.sparkContext.broadcast(ranks_of(surveyed))

    def labelled() -> DataFrame:
        """(node, label) of each class that is linked, but the least of its component."""
        prefixes = rows.select("k", "body").mapInArrow(lean(send_prefixes(parts, size, percent, table)), X.PACKED)
        met = settled(X.deal(prefixes, parts).mapInArrow(lean(meet(FEW)), "t long, a long, b long, a_n long, b_n long, shared long"), "met")
        crowd = met.where("t is not null").select("t", F.col("a").alias("s"), F.col("a_n").alias("n"), F.col("shared").alias("place"))
        crowded = crowd.select("s").distinct()
        # a pair's count is whole unless both meet in a crowd too
        counted = met.where("t is null").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))
        for side in "ab":
            counted = counted.join(crowded.select(F.col("s").alias(side), F.lit(True).alias(f"{side}_in")), side, "left")
        total, longest = F.col("a_n") + F.col("b_n"), F.greatest("a_n", "b_n")
        rest = F.ceil(longest * percent / 100) - 1
        enough = (F.col("shared") + rest) * (100 + percent) >= total * percent
        unsure = F.coalesce(F.col("a_in") & F.col("b_in"), F.lit(False))
        direct = settled(counted.where((F.least("a_n", "b_n") * 100 >= longest * percent) & (enough | unsure)).select("a", "b", "a_n", "b_n"), "direct")

        possible = direct.select(F.col("a").alias("s")).unionByName(direct.select(F.col("b").alias("s"))).unionByName(crowded).distinct()
        chosen = classes.join(possible, "s", "left_semi").groupBy("s").agg(F.min_by(F.struct("k", "n", *_SKETCH), "k").alias("x")).select("s", "x.*")
        chosen = settled(chosen, "chosen")
        n_chosen = chosen.count()
        wanted = chosen.select("k")
        if n_chosen <= BROADCAST_KEYS:
            wanted = F.broadcast(wanted)

        def whole(batches):
            ranks = table.value
            for batch in batches:
                for _, _, data, offs in K.slices(batch.column(0).cast(pa.large_binary()).cast(pa.large_string())):
                    sets = shingles(data, offs, size)
                    own = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([ordered(s, ranks).tobytes() for s in sets], pa.binary())], names=["s", "elements"])

        sets = settled(rows.join(wanted, "k", "left_semi").select("body").mapInArrow(lean(whole), "s long, elements binary"), "sets")
        if sets.count() > n_chosen:  # equal rows
            sets = settled(sets.dropDuplicates(["s"]), "sets")
        narrow = settled(chosen.select("s", *_SKETCH), "sketches")

        def sketched(d: DataFrame, side: str, key: str | None = None) -> DataFrame:
            return d.join(narrow.select(F.col("s").alias(key or side), *(F.col(q).alias(f"{side}_{q}" if key is None else q) for q in _SKETCH)), key or side)

        direct = settled(sketched(sketched(direct, "a"), "b").where(suffix_passes(percent)).select("a", "b", "a_n", "b_n"), "alike")

        def linked(pairs: DataFrame) -> DataFrame:
            for side in "ab":
                pairs = pairs.join(sets.select(F.col("s").alias(side), F.col("elements").alias(f"{side}_set")), side)
            return pairs.select("a", "b", "a_set", "b_set").mapInArrow(lean(compare(percent)), "a long, b long")

        def apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
            """Pairs whose classes are not known to be of one component."""
            if labels is None:
                return pairs
            for side in "ab":
                pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_l")), side, "left")
            return pairs.where(F.coalesce("a_l", "a") != F.coalesce("b_l", "b")).select("a", "b", "a_n", "b_n")

        def least_of(rows_: DataFrame, order) -> DataFrame:
            """(t, h): the least row of each of HUBS parts of an n-gram's classes."""
            salted = rows_.groupBy("t", F.pmod(F.xxhash64("s", F.lit("hub")), F.lit(HUBS)).alias("salt")).agg(F.min(order).alias("h"))
            return salted.select("t", "h")

        def pair(left: DataFrame, right: DataFrame, on: list[str], more) -> DataFrame:
            """Distinct pairs, with sizes, that pass the filters; left and right hold (on, s, n, place, label)."""
            l, r = (d.select(*on, *(F.col(c).alias(f"{side}_{c}") for c in ("s", "n", "place", "label", *_SKETCH))) for d, side in ((left, "a"), (right, "b")))
            both = l.join(r, on).where((F.col("a_label") != F.col("b_label")) & more & suffix_passes(percent))
            return both.select(F.least("a_s", "b_s").alias("a"), F.greatest("a_s", "b_s").alias("b"), F.col("a_n"), F.col("b_n")).groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))

        def all_pairs(rows_: DataFrame) -> DataFrame:
            """Pairs of all classes that meet at an n-gram: the smaller's shorter prefix against the other's whole one.

            Classes meet by n-gram and length: a bin of lengths reaches to those
            that are similar enough, so a class asks its own bin and the next. An
            n-gram of many classes is dealt on: the indexed side by a hash into
            parts of about CROWD classes, the asking side to each of them.
            """
            step = math.log(100 / percent) or 1.0
            bins = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
            index = rows_.where(indexed(percent)).withColumn("bin", bins)
            crowds = index.groupBy("t", "bin").agg(F.ceil(F.count("*") / F.lit(CROWD)).cast("int").alias("ways"))
            index = index.join(crowds, ["t", "bin"]).withColumn("way", F.pmod(F.xxhash64("s", F.lit("way")), F.col("ways")).cast("int")).drop("ways")
            # a smaller set lies in the bin of the larger or in one of the two below: rounding may move a bound by one
            asking = rows_.withColumn("bin", F.explode(F.array(bins, bins - 1, bins - 2))).join(crowds, ["t", "bin"])
            asking = asking.withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")
            smaller = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_s") < F.col("b_s")))
            return pair(sketched(index, "", "s"), sketched(asking, "", "s"), ["t", "bin", "way"], smaller & passes(percent))

        labels = edges = tried = None
        has_crowd = bool(crowd.head(1))
        for turn in range(STARS + 1):
            pairs = None
            if turn < 2:  # of the direct pairs first one for each class, then those that are still apart
                least = direct.groupBy("b").agg(F.min_by(F.struct("a", "a_n", "b_n"), "a").alias("x"))
                pairs = least.select("x.a", "b", "x.a_n", "x.b_n") if turn == 0 else apart(direct, labels)
            if has_crowd:
                now = crowd.withColumn("label", F.col("s")) if labels is None else crowd.join(labels.select(F.col("node").alias("s"), F.col("label").alias("l")), "s", "left").withColumn("label", F.coalesce("l", "s")).drop("l")
                if turn < STARS:
                    # each class goes with one of its n-grams, near copies mostly with the same; the hubs of an
                    # n-gram are its classes of the least mixed hashes; both are others in the next round
                    row = F.struct("t", "n", "place", "label")
                    own = sketched(now.groupBy("s").agg(F.min_by(row, F.xxhash64("t", F.lit(turn))).alias("x")).select("s", "x.*"), "", "s")
                    order = F.struct(F.xxhash64("s", F.lit(turn)), "s", "n", "place", "label", *_SKETCH)
                    spread = own.groupBy("t").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("t")
                    hub = least_of(own.join(spread, "t", "left_semi"), order).select("t", "h.*")
                    # a star's meeting is by chance: only joins of all classes may ask for a place in the prefix
                    more = pair(hub, own, ["t"], length_passes(percent))
                else:
                    spread = now.groupBy("t").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("t")
                    more = all_pairs(settled(now.join(spread, "t", "left_semi"), "open"))
                pairs = more if pairs is None else pairs.unionByName(more).dropDuplicates(["a", "b"])
            if pairs is None:
                break
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = settled(pairs, "pairs")
            if not pairs.head(1):
                continue
            found = settled(linked(pairs), "links")
            tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
            edges = found if edges is None else edges.unionByName(found)
            labels = components(edges)
        return spark.createDataFrame([], "node long, label long") if labels is None else labels

    labels = finished(labelled, "labels")
    named = classes.join(labels.select(F.col("node").alias("s"), "label"), "s", "left").withColumn("c", F.coalesce("label", "s"))
    return named.select("k", "id", "n", "c")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """Components of documents whose n-gram sets have a Jaccard similarity of `percent` / 100 or more.

    Returns (id, n_shingles, component_id): component_id is the smallest id
    that can be reached over links, the document's own included. A-Z is
    lower-cased; texts of fewer than `size` words have all their words as one
    n-gram. Null and empty texts, and texts of white space, have no n-gram, link
    with nothing and are their own component. Equal rows link as any equal
    texts. Null ids take part; a component of nulls alone has a null id. Other
    columns are ignored; an empty table gives an empty one. Sets are of 64-bit
    hashes.
    """
    named = grouped(docs, id_col, text_col, size, percent)
    some = named.where("n > 0")
    least = some.groupBy("c").agg(F.min("id").alias("least"))
    out = some.join(least, "c").select("id", "n", "least").unionByName(named.where("n = 0").select("id", "n", F.col("id").alias("least")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """docs with one row of each component of near_duplicates(), that of the smallest id (and key, if ids repeat); rows without n-grams all stay. A null id counts as the largest."""
    named = settled(grouped(docs, id_col, text_col, size, percent), "grouped")
    first = named.where("n > 0").groupBy("c").agg(F.min(F.struct(F.col("id").isNull(), "id", "k")).alias("x"))
    keys = first.select("x.k").unionByName(named.where("n = 0").select("k").distinct())
    key = row_key(id_col, text_col)
    kept = docs.join(keys.withColumnRenamed("k", "__row_key"), key == F.col("__row_key"), "left_semi")
    repeats = named.where("n > 0").groupBy("k").count().where("count > 1").select("k")
    if not repeats.head(1):
        return kept
    # equal rows with n-grams: one of each key stays
    twice = repeats.withColumnRenamed("k", "__row_key")
    one = kept.join(twice, key == F.col("__row_key"), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(twice, key == F.col("__row_key"), "left_anti").unionByName(one)

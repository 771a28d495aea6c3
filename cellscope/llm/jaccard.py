"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document is the set of its distinct 5-word shingles, each known by a 64-bit hash. Documents
link where the sets' Jaccard similarity is at least ``NUM / DEN``; the result is exact up to
hash collisions. Documents with equal sets form a class, and only classes are compared.

1. Each class sends the ``emitted`` smallest hashes of its set (order 1) to their token. Two
   linked sets share at least ``needed`` of the tokens they send, so a pair is a candidate only
   if its count of shared tokens reaches that. Tokens in at most ``HOT`` classes give their pairs.
2. Tokens in more classes (shared passages, large groups of near copies) give none. A class with
   few of them must share others with each partner, so nothing is lost. The classes with many are
   joined again over all of their tokens under order 2, by rising frequency among them, which
   takes shared passages out of the prefixes.
3. Frequent tokens left in those prefixes belong to classes that have hardly any others, as large
   groups of near copies do. There the most typical class of a token, its centre, is compared with
   its others first, and then only classes that are still in different components. A pair that
   shares no rare token cannot link if the two have too many rare tokens of their own, if what
   each shares with the centre and what each has beside it leave too little in common, or if
   their frequent tokens, counted in bins by a hash, do. That settles nearly all pairs of such a
   group without a comparison.
4. Candidates must share prefix tokens under two further orders (falling hashes, and hashes from
   the middle round) before their sets are intersected. Each document's best candidate is
   verified first; of the others only those between different components are left to verify.

Sets are recomputed from the texts where they are needed; a Bloom filter of a fixed size tells
the tasks which classes to send, and an exact join follows. No step gathers a group or emits all
pairs of a frequent token.

Edge cases: a text with fewer than five words has its whole sequence as one shingle; a NULL, empty
or blank text has an empty set and links with nothing; rows with one id but different texts are
joined as documents of their own; a component of NULL ids only has a NULL id; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellscope.llm.common import checkpointed, table
from cellscope.llm.components import connected
from cellscope.llm.shingles import SHINGLE_WORDS, mix, shingle_sets, text_blocks

NUM, DEN = 80, 100      # a link: DEN * shared >= NUM * united
HOT = 32                # classes a token may be in to give pairs directly
FILTER_BITS = 1 << 25   # of the Bloom filter (4 MB), whatever the number of classes
PARTS = 16              # parts that the rows of a token are dealt to in joins
PROFILE = 64            # bins in which a set's frequent tokens are counted
SIZE_CODE = 16          # steps of a size code in an octave

# Set arithmetic, for numbers and for columns alike ----------------------------------------------


def prefix(n):
    """Tokens of a set of n among which each linked set has one at least."""
    return n // 5 + 1


def slack(n: int) -> int:
    return max(3, prefix(n) // 4)


def emitted(n: int) -> int:
    return min(n, prefix(n) + slack(n))


def overlap(a, b):
    """Fewest shared tokens of linked sets of these sizes."""
    return -((-NUM * (a + b)) // (NUM + DEN))


def _col_slack(n: Column) -> Column:
    return F.greatest(F.lit(3), F.floor((F.floor(n / 5) + 1) / 4)).cast("int")


def _col_emitted(n: Column) -> Column:
    return F.least(n, F.floor(n / 5) + 1 + _col_slack(n)).cast("int")


def _col_overlap(a: Column, b: Column) -> Column:
    return F.ceil(F.lit(NUM) * (a + b) / F.lit(float(NUM + DEN)) - 1e-9).cast("int")


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * DEN >= F.greatest(a, b) * NUM


def _own_fit(a: Column, own_a: Column, b: Column, own_b: Column) -> Column:
    """For sets that share none of their rare tokens: what is left of either must hold the whole
    overlap, and the rare tokens of both, which lie in the union only, may not be too many beside
    the largest possible intersection."""
    most = F.least(a - own_a, b - own_b)
    return (most >= _col_overlap(a, b)) & ((own_a + own_b) * NUM <= most * (DEN - NUM))


def _profiles_share(a: Column, b: Column) -> Column:
    """The most that sets share whose frequent tokens fall into bins as these counts say."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)


def _in_prefixes(a: Column, rank_a: Column, b: Column, rank_b: Column) -> Column:
    """Whether a token of these ranks lies in the prefixes that sets of these sizes must share."""
    need = _col_overlap(a, b)
    return (rank_a <= a - need + 1) & (rank_b <= b - need + 1)


# Scans of the texts -----------------------------------------------------------------------------


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit id of a set, as a signed number."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(tokens ^ np.uint64(0xA0761D6478BD642F)))
        return int(mix(np.array([total + np.uint64(len(tokens)) * np.uint64(0xE7037ED1A0B428DB)])).view(np.int64)[0])


def _sets(batch: pa.RecordBatch, column: int):
    for row, end, data, offsets in text_blocks(batch.column(column)):
        yield row, end, list(shingle_sets(data, offsets, SHINGLE_WORDS))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, sets in _sets(batch, 1):
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(row, end - row), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())], ["_id", "n", "sig"])


def size_code(n: int) -> int:
    return min(0xFFFF, int(np.log2(n) * SIZE_CODE))


def _postings(wanted, whole: bool):
    """(key, sig): key holds the high 48 bits of a token and the size code of its set. Each task
    sends a class once, however many copies it meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, sets in _sets(batch, 0):
                keys, sigs = [], []
                for s in sets:
                    if not len(s):
                        continue
                    sig = set_id(s)
                    if sig in seen or (wanted is not None and not _passes(wanted.value, sig)):
                        continue
                    seen.add(sig)
                    part = s if whole else s[:emitted(len(s))]
                    keys.append((part & np.uint64(0xFFFFFFFFFFFF0000)) | np.uint64(size_code(len(s))))
                    sigs.append(np.full(len(part), sig, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sigs))],
                                                     ["key", "sig"])
    return run


def _whole_sets(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, sets in _sets(batch, 0):
                sigs, parts = [], []
                for s in sets:
                    if len(s):
                        sig = set_id(s)
                        if sig not in seen and _passes(wanted.value, sig):
                            seen.add(sig)
                            sigs.append(sig)
                            parts.append(s.tobytes())
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(parts, pa.binary())], ["sig", "tokens"])
    return run


SECOND = "sig bigint, n int, own int, profile array<int>, prefix array<struct<token:bigint,code:int,df:bigint,rank:int>>"
_PREFIX = pa.list_(pa.struct([("token", pa.int64()), ("code", pa.int32()), ("df", pa.int64()), ("rank", pa.int32())]))


def _second_order(hot: int):
    """Classes (sig, n, tokens, dfs) in order 2, by rising frequency: how many tokens are rare, the
    frequent ones counted in PROFILE bins by a hash, and the prefix that is sent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            own, profiles, prefixes = [], [], []
            for i in range(batch.num_rows):
                tokens = batch.column(2)[i].values.to_numpy()
                dfs = batch.column(3)[i].values.to_numpy()
                spread = mix(tokens.view(np.uint64))
                frequent = dfs > hot
                own.append(int(np.count_nonzero(~frequent)))
                profiles.append(np.bincount((spread[frequent] % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE))
                code = size_code(int(n[i]))
                first = np.lexsort((spread, dfs))[:emitted(int(n[i]))]
                prefixes.append([{"token": t, "code": code, "df": d, "rank": r}
                                 for r, (t, d) in enumerate(zip(tokens[first].tolist(), dfs[first].tolist(), strict=True), 1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(profiles, pa.list_(pa.int32())),
                                              pa.array(prefixes, _PREFIX)], ["sig", "n", "own", "profile", "prefix"])
    return run


def _places(sig: int) -> tuple[int, int]:
    u = sig & 0xFFFFFFFFFFFFFFFF
    return u % FILTER_BITS, (u >> 32) % FILTER_BITS


def _passes(words: np.ndarray, sig: int) -> bool:
    return all(int(words[p >> 6]) >> (p & 63) & 1 for p in _places(sig))


def bloom(sigs: DataFrame):
    """A Bloom filter of the column ``sig``, broadcast: FILTER_BITS / 64 numbers at most reach
    the driver, added up from the tasks by place."""
    u = F.col("sig")
    low = F.pmod(u, F.lit(FILTER_BITS))                                    # u mod a power of two
    high = F.pmod(F.shiftrightunsigned(u, 32), F.lit(FILTER_BITS))
    words = sigs.select(F.explode(F.array(low, high)).alias("p")) \
        .groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("b")) \
        .toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return sigs.sparkSession.sparkContext.broadcast(out)


def passes_orders(x: np.ndarray, y: np.ndarray) -> bool:
    """Prefix filters under two further orders."""
    need = overlap(len(x), len(y))
    p, q = len(x) - need + 1, len(y) - need + 1
    if p <= 0 or q <= 0:
        return False
    shares = lambda a, b: len(np.intersect1d(a, b, assume_unique=True)) > 0
    if not shares(x[-p:], y[-q:]):
        return False
    half = np.uint64(1 << 63)
    i, j = np.searchsorted(x, half), np.searchsorted(y, half)
    return shares(np.concatenate([x[i:], x[:i]])[:p], np.concatenate([y[j:], y[:j]])[:q])


def verify_sets(x: np.ndarray, y: np.ndarray, measure: bool = False) -> tuple[bool, int | None]:
    """Whether two sets link, and their shared tokens where these were counted: if the orders let
    the pair pass, or always with ``measure``."""
    if not measure and not passes_orders(x, y):
        return False, None
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * both >= NUM * (len(x) + len(y) - both), both


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [verify_sets(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), m.as_py())
                 for m, x, y in zip(batch.column(2), batch.column(3), batch.column(4), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.bool_()),
                                          pa.array([f[1] for f in found], pa.int32())], ["a", "b", "link", "shared"])


# The join -----------------------------------------------------------------------------------------


def compared(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, link, shared) of the candidate pairs (a, b, measure), checked on their whole sets."""
    ends = pairs.select("a", "b", "measure", F.explode(F.array("a", "b")).alias("sig"))
    sets = texts.mapInArrow(_whole_sets(bloom(ends.select("sig"))), "sig bigint, tokens binary") \
        .groupBy("sig").agg(F.min("tokens").alias("tokens"))
    both = ends.join(sets, "sig").groupBy("a", "b", "measure").agg(F.min("tokens").alias("x"), F.max("tokens").alias("y"))
    return checkpointed(both.mapInArrow(_verify, "a bigint, b bigint, link boolean, shared int"))


def in_parts(rows: DataFrame) -> DataFrame:
    """Each row once in every part."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))


def rare_pairs(lists: DataFrame) -> DataFrame:
    """(a, b, shared) from rows (token, sig, code) of tokens with at most HOT rows."""
    held = lists.groupBy("token").agg(F.collect_list(F.struct("sig", "code")).alias("l"))
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(
        F.filter(F.slice("l", i + 2, HOT), lambda y: F.abs(y["code"] - x["code"]) <= 7),
        lambda y: F.struct(F.least(x["sig"], y["sig"]).alias("a"), F.greatest(x["sig"], y["sig"]).alias("b")))))
    return held.select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def counted(pairs: DataFrame, classes: DataFrame, hot: DataFrame) -> DataFrame:
    """Pairs whose sizes fit and that share enough tokens. The shared tokens that are hot are not
    counted, so the fewer of the two sides' hot tokens are taken off, and one for keys of 48 bits."""
    info = classes.select("sig", "n").join(hot.select("sig", "hot"), "sig", "left").na.fill(0, ["hot"])
    x = pairs
    for side in ("a", "b"):
        x = x.join(info.select(F.col("sig").alias(side), F.col("n").alias(f"n_{side}"), F.col("hot").alias(f"hot_{side}")), side)
    a, b = F.col("n_a"), F.col("n_b")
    need = F.least(_col_emitted(a) - a, _col_emitted(b) - b) + _col_overlap(a, b)
    return x.where(_sizes_fit(a, b)).where(
        F.col("shared") >= F.greatest(F.lit(1), need - F.least("hot_a", "hot_b") - 1)).select("a", "b", "shared")


def with_frequency(postings: DataFrame) -> DataFrame:
    """(token, code, sig, df): postings once a class, with the number of classes of the token."""
    token = F.shiftright("key", 16)
    x = postings.select(token.alias("token"), F.pmod("key", F.lit(65536)).cast("int").alias("code"), "sig")
    x = x.repartition("token").dropDuplicates(["token", "sig"])
    return x.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token")))


def link_components(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, component): for the classes in a component of two or more, its smallest class.
    ``texts`` has the texts as its only column, ``classes`` (sig, n)."""
    shared = checkpointed(with_frequency(texts.mapInArrow(_postings(None, False), "key bigint, sig bigint")).where("df > 1"))
    hot = checkpointed(shared.where(F.col("df") > HOT).groupBy("sig").agg(F.count(F.lit(1)).cast("int").alias("hot")))
    candidates = counted(rare_pairs(shared.where(F.col("df") <= HOT)), classes, hot)

    # classes with many hot tokens: all their tokens, in an order with frequent ones last
    dense = checkpointed(hot.join(classes, "sig").where(F.col("hot") >= _col_slack(F.col("n")) - 1).select("sig", "n"))
    tokens = texts.mapInArrow(_postings(bloom(dense), True), "key bigint, sig bigint").join(dense, "sig", "left_semi")
    held = with_frequency(tokens).groupBy("sig").agg(F.collect_list("token").alias("tokens"), F.collect_list("df").alias("dfs"))
    ordered = checkpointed(held.join(dense, "sig").select("sig", "n", "tokens", "dfs").mapInArrow(_second_order(HOT), SECOND))
    second = ordered.select("sig", "n", "own", "profile", F.inline("prefix")).where("df > 1") \
        .withColumn("frequent", F.col("df") > HOT)
    hot2 = checkpointed(second.where("frequent").groupBy("sig").agg(F.count(F.lit(1)).cast("int").alias("hot")))
    candidates2 = counted(rare_pairs(second.where("not frequent")), classes, hot2)
    pairs = checkpointed(candidates.unionByName(candidates2).groupBy("a", "b").agg(F.max("shared").alias("shared")))

    # what is left: tokens frequent among classes that have hardly any others. The rows of a token
    # are dealt to PARTS parts, with the few rows of its other side in each
    crowd = second.where("frequent").join(
        hot2.join(classes, "sig").where(F.col("hot") >= _col_slack(F.col("n")) - 1).select("sig"), "sig") \
        .select("token", F.pmod(F.xxhash64("sig"), F.lit(PARTS)).alias("part"), "sig", "n", "own", "rank", "profile")
    centre = crowd.groupBy("token").agg(F.min(F.struct("own", "sig", "n")).alias("c"))
    crowd = checkpointed(crowd.join(in_parts(centre), ["token", "part"]))
    spokes = crowd.where((F.col("sig") != F.col("c.sig")) & _sizes_fit(F.col("n"), F.col("c.n"))) \
        .select(F.least("sig", "c.sig").alias("a"), F.greatest("sig", "c.sig").alias("b")).distinct()

    each = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("o")),
                                          F.struct(F.col("b").alias("v"), F.col("a").alias("o")))).alias("e"), "shared")
    best = each.groupBy("e.v").agg(F.max(F.struct("shared", F.col("e.o").alias("o"))).alias("m")) \
        .select(F.least("v", "m.o").alias("a"), F.greatest("v", "m.o").alias("b"))
    first = checkpointed(best.withColumn("measure", F.lit(False)).unionByName(spokes.withColumn("measure", F.lit(True)))
                         .groupBy("a", "b").agg(F.max("measure").alias("measure")))
    met = compared(texts, first)
    found = connected(met.where("link").select("a", "b"))

    # candidates between components that are still apart
    def component(side: str) -> DataFrame:
        return found.select(F.col("v").alias(side), F.col("component").alias(f"c_{side}"))
    apart = pairs.select("a", "b").join(component("a"), "a", "left").join(component("b"), "b", "left") \
        .where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    # tokens shared with the centre (all of them where that is not known), and the most frequent
    # tokens that the centre may lack
    with_centre = met.where("shared is not null").select(F.explode(F.array(
        F.struct(F.col("a").alias("sig"), F.col("b").alias("by")), F.struct(F.col("b").alias("sig"), F.col("a").alias("by")))).alias("e"), "shared") \
        .select("e.sig", "e.by", "shared")
    n, own = F.col("n"), F.col("own")
    placed = crowd.withColumn("by", F.col("c.sig")).join(with_centre, ["sig", "by"], "left").join(component("sig"), "sig", "left")
    inside = F.when(F.col("sig") == F.col("by"), n).otherwise(F.coalesce("shared", n))
    outside = n - own - F.when(F.col("sig") == F.col("by"), n - own).otherwise(
        F.coalesce(F.greatest(F.lit(0), F.col("shared") - F.least(own, F.col("c.own"))), F.lit(0)))
    placed = checkpointed(placed.select("token", "part", "sig", "n", "own", "rank", "profile", inside.alias("inside"), outside.alias("outside"),
                                        F.coalesce("c_sig", "sig").alias("c")))
    main = placed.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("main"))
    placed = placed.join(in_parts(main), ["token", "part"])
    others = in_parts(placed.where("c != main").select(
        "token", *[F.col(x).alias(f"{x}_o") for x in ("sig", "n", "own", "rank", "profile", "inside", "outside", "c")]))
    m, own_o = F.col("n_o"), F.col("own_o")
    across = placed.join(others, ["token", "part"]).where(
        (F.col("c") != F.col("c_o")) & _sizes_fit(n, m) & _own_fit(n, own, m, own_o)
        & _in_prefixes(n, F.col("rank"), m, F.col("rank_o"))
        & (F.least("inside", "inside_o") + F.least("outside", "outside_o") >= _col_overlap(n, m))
        & (_profiles_share(F.col("profile"), F.col("profile_o")) >= _col_overlap(n, m))) \
        .select(F.least("sig", "sig_o").alias("a"), F.greatest("sig", "sig_o").alias("b"))
    rest = checkpointed(apart.unionByName(across).distinct().join(first, ["a", "b"], "left_anti").withColumn("measure", F.lit(False)))
    if rest.isEmpty():
        return found.select(F.col("v").alias("sig"), "component")
    more = compared(texts, rest).where("link").select("a", "b")
    # earlier components enter as their stars
    stars = found.where("v != component").select(F.least("v", "component").alias("a"), F.greatest("v", "component").alias("b"))
    return connected(checkpointed(stars.unionByName(more))).select(F.col("v").alias("sig"), "component")


def placed_rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, n, sig) of every row, and (sig, component) of every class."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    members = checkpointed(rows.mapInArrow(_members, f"_id {kind}, n bigint, sig bigint"))
    classes = checkpointed(members.where("sig is not null").groupBy("sig").agg(F.first("n").cast("int").alias("n")))
    found = link_components(rows.select("_text"), classes)
    return members, checkpointed(classes.join(found, "sig", "left").select("sig", F.coalesce("component", "sig").alias("component")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id (the smallest id reachable)."""
    members, of = placed_rows(df, id_col, text_col)
    least = members.groupBy("sig").agg(F.min("_id").alias("least"))
    named = of.join(least, "sig").withColumnRenamed("least", "own")
    smallest = named.groupBy("component").agg(F.min("own").alias("component_id"))
    got = members.join(named.join(smallest, "component").select("sig", "component_id"), "sig", "left")
    return got.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("sig").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


def _tagged(text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, sets in _sets(batch, text_at):
                sig = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.slice(row, end - row) for c in batch.columns], sig], [*names, "sig"])
    return run


def first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, when one row of each component does: the one
    with the smallest id (NULL last), and of several texts with that id the one whose set has the
    smallest number. Of rows without words one of each id stays."""
    members, of = placed_rows(df, id_col, text_col)
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("sig").alias("sig"))
    stays = members.join(of, "sig").groupBy("component").agg(F.min(order).alias("o")) \
        .select(F.col("o.sig").alias("_sig"), F.col("o.id").alias("_id"))
    names = [f"c{i}" for i in range(len(df.columns))]
    plain, at, key = df.toDF(*names), df.columns.index(text_col), names[df.columns.index(id_col)]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields], "sig bigint"])
    rows = plain.mapInArrow(_tagged(at, names), schema)
    # one key for the join and the removal of copies; rows without words spread by their id
    place = lambda sig, own: F.xxhash64(F.coalesce(sig, F.xxhash64(own)), own)
    rows = rows.withColumn("_place", place(F.col("sig"), F.col(key)))
    stays = stays.withColumn("_at", place(F.col("_sig"), F.col("_id")))
    kept = rows.join(stays, (F.col("_place") == F.col("_at")) & (F.col("sig") == F.col("_sig")) & F.col(key).eqNullSafe(F.col("_id")), "left") \
        .where(F.col("sig").isNull() | F.col("_sig").isNotNull())
    return kept.dropDuplicates(["_place", "sig", key]).select(*names).toDF(*df.columns)


def op4(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

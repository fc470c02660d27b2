"""N-gram Jaccard join by multiple-global-order filtering.

A document's set holds the hashes of its distinct word shingles. Equal sets form a class, and one document stands for it. If
two sets reach the threshold, each shares at least ceil(t * n) of its n elements with the other, so under any global
order of elements their prefixes share some. Three orders are used: the hash itself and two re-mixed hashes.
 1. Under the first order a prefix with room for k(n) shared elements is spread over the cluster; rows of elements known to be very
    common are spread evenly. Elements that stand in one class only can't be shared; a class with fewer than the sure number of shared ones has no partner.
 2. Classes that remain are grouped by their shared prefix elements. Each group's most central member (the one
    with the largest part of its prefix shared) is its centre, and every member meets the centre that it shares most with;
    pairs must be near in size and share prefix elements under the second and third order too, which is settled on those prefixes
    alone; only what passes is verified on the whole sets.
 3. Links merge classes into components. Groups that still hold several components take their next member as centre. After
    ROUNDS of that, all pairs of different components that share as many elements of the first prefix as any linked pair
    must are compared, so no link that joins two components is lost.
 4. Where an element of that last round stands in more than HOT classes, its pairs come from hot_pairs instead: classes are
    taken by their difference from what most of the group holds, and must share a rare part of it.

Sets are hashed with 64 bits and classes with 128.

Classes are named by the smallest of their ids. Where that is the smallest id of several classes (rows of one id may have different
texts), all but one of them are named by a 64-bit hash instead, and the smallest id is looked up again at the end.

Defined cases: null texts and texts without words have no set and link with nothing; fewer words than a shingle count as one
shingle; rows with a null id are returned without a component; repeated rows fall into one class; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrata.llm.common import BITS, as_rows, bit_set, drop_stored, of_rows, release, spread, stored
from keystrata.llm.graph import components
from keystrata.llm.text_hash import fmix, give_back, shingles, word_hashes

ROUNDS = 2
#: Groups of more classes than this are joined by differences; both ways find the same links.
HOT = 16
#: How often classes that share a hot part of their differences become groups of their own.
DEPTH = 3
#: They do where comparing them at once takes more pairs a class than this.
SPARE = 2 * HOT
#: The part of a set by which the first prefix is longer than needed, so that several elements must be shared.
EXTRA = Fraction(1, 20)
#: Elements at most that are known to stand in very many classes.
COMMON = 1000
#: Parts that the classes of a component are spread over.
SPREAD = 16
_SEEDS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))


def _need(n: int, t: Fraction) -> int:
    return -(-n * t.numerator // t.denominator)


def _sure(n: int, t: Fraction) -> int:
    """Elements of the long prefix that a partner of any fitting size shares at least."""
    return 1 + int(EXTRA * _need(n, t))


def sets_of(docs: DataFrame, words: int, t: Fraction, only: bytes | None = None, whole: bool = False) -> DataFrame:
    """(doc_id, th, n, fa, fb, p1[, tokens, p2, p3]); th is the text's hash, p1 is the long first prefix. only: a bit set of wanted ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = None if only is None else np.frombuffer(only, np.uint8)
        for b in batches:
            if bits is not None:
                i = b["doc_id"].fillna(-1).to_numpy(np.int64)
                at = i & (BITS - 1)
                b = b[(i >= 0) & ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) | (i < 0)]
            rows, ids, th = [], b["doc_id"].tolist(), b["th"].tolist()
            for first, last, h, counts in word_hashes(b["text"].tolist()):
                at = 0
                for i, c in zip(range(first, last), counts, strict=True):
                    s = shingles(h[at : at + c], words)
                    at += c
                    n = len(s)
                    room = n - _need(n, t) + 1 + int(EXTRA * n)
                    mixed = fmix(s ^ np.uint64(0x1234567)) if n else s
                    row = [ids[i], th[i], n, np.int64(np.add.reduce(s).view(np.int64)), np.int64(np.add.reduce(mixed).view(np.int64)), s[: min(n, room)].view(np.int64)]
                    if whole:
                        cut = n - _need(n, t) + 1
                        row += [s.view(np.int64), *[np.sort(np.partition(o, cut - 1)[:cut]).view(np.int64) for o in (fmix(s ^ x) for x in _SEEDS)]]
                    rows.append(row)
                    if len(rows) >= 500:
                        yield frame(rows)
                        rows = []
            if rows:
                yield frame(rows)
        give_back()

    names = ["doc_id", "th", "n", "fa", "fb", "p1"] + (["tokens", "p2", "p3"] if whole else [])

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, th long, n long, fa long, fb long, p1 array<long>" + (", tokens array<long>, p2 array<long>, p3 array<long>" if whole else "")
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))).mapInPandas(run, schema)


def named_classes(sets: DataFrame) -> DataFrame:
    """(fa, fb, n, id, th, rep) of every class: its first row by (id, text hash), and its name."""
    c = sets.where("n > 0 and doc_id is not null").groupBy("fa", "fb").agg(F.min("n").alias("n"), F.min(F.struct("doc_id", "th")).alias("m"))
    c = stored(c.select("fa", "fb", "n", F.col("m.doc_id").alias("id"), F.col("m.th").alias("th")), "first-rows")
    several = c.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("fa", "fb")).alias("f")).where("c > 1").select(F.col("id").alias("_i"), "f")
    rep = F.when(F.col("f").isNull() | (F.struct("fa", "fb") == F.col("f")), F.col("id")).otherwise(F.xxhash64("fa", "fb", "id"))
    return stored(c.join(several, F.col("id") == F.col("_i"), "left").select("fa", "fb", "n", "id", "th", rep.alias("rep")), "names")


def candidates_left(sets: DataFrame, names: DataFrame, t: Fraction) -> DataFrame:
    """Classes that can have a partner: (rep, n, central)."""
    first = names.select("rep", "id", F.col("fa").alias("_a"), F.col("fb").alias("_b"))
    own = sets.where("n > 0").select("doc_id", "fa", "fb", "p1").join(first, (F.col("doc_id") == F.col("id")) & (F.col("fa") == F.col("_a")) & (F.col("fb") == F.col("_b")))
    common = common_elements(sets.where("n > 0").select(F.xxhash64("fa", "fb").alias("rep"), "p1"))
    hits = shared_only(own.select("rep", F.explode("p1").alias("x")), common).groupBy("rep").agg(F.count(F.lit(1)).alias("hits"))
    need = F.ceil(F.col("n") * F.lit(t.numerator) / F.lit(t.denominator) - 1e-9)
    # the guard for rounding keeps a class rather than lose one
    return hits.join(names.select("rep", "n"), "rep").where(F.col("hits") >= 1 + F.floor(need * float(EXTRA) - 1e-6)).select("rep", "n", (F.col("hits") / F.col("n")).alias("central"))


def common_elements(sets: DataFrame) -> DataFrame:
    """(x, common) of the COMMON elements at most that stand in the most classes, going by one class in 64 of sets (rep, p1).

    Each stands in 8 of those at least, so it is shared. Which ones are found decides on how work is dealt out, not on results."""
    one = sets.where(F.pmod("rep", F.lit(64)) == 0).dropDuplicates(["rep"]).select(F.explode("p1").alias("x"))
    most = one.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where("c >= 8").orderBy(F.desc("c"), "x").limit(COMMON)
    return stored(most.select("x", F.lit(True).alias("common")), "common")


def shared_only(e: DataFrame, common: DataFrame) -> DataFrame:
    """The rows of e (rep, x, ...) whose x stands in several classes.

    One exchange by x. Rows of common elements are shared in any case, and spread over the tasks."""
    d = e.join(F.broadcast(common), "x", "left").withColumn("_part", F.when(F.col("common"), F.pmod(F.xxhash64("rep"), F.lit(1024))))
    w = W.partitionBy("x", "_part")
    d = d.withColumn("_lo", F.min("rep").over(w)).withColumn("_hi", F.max("rep").over(w))
    return d.where(F.col("common") | (F.col("_lo") != F.col("_hi"))).drop("common", "_part", "_lo", "_hi")


def hot_pairs(members: DataFrame, sets: DataFrame, t: Fraction, depth: int = DEPTH) -> DataFrame:
    """(a, b) of all classes in one group c of members (c, rep, n, label) that may link and differ in label.

    R is the set of elements that over half of a group hold, d(A) = A xor R. A and B link if and only if |A xor B| <=
    k (|A| + |B|) with k = (1 - t) / (1 + t). Let s(A) = |d(A)| - k |A|, and M the member of least s.
     - If s(A) + s(B) <= 0, so are s(M) + s(A) and s(M) + s(B): both link with M, as |M xor A| <= |d(M)| + |d(A)|. So the
       pairs (M, B) with s(M) + s(B) <= 0 suffice for these.
     - Else d(A) and d(B) share o >= (s(A) + s(B)) / 2 elements. Let s(B) <= s(A); A isn't among the above, so s(A) > -s(M)
       too. Of the elements of d(B) that stand in other differences, by growing number of those, all but the last o - 1
       hold a shared one, and those found there and the others must reach o together. Where classes that meet in one make more than SPARE pairs each, they are a group again, DEPTH times at most: a text with
       many variants, inside a larger group around a passage that all of them quote, then has an R of its own.
    s is counted in units of 1 / (1 + t), scaled to integers."""
    up, down = t.denominator - t.numerator, t.denominator + t.numerator
    size = members.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    held = members.select("c", "rep").join(sets, "rep").select("c", F.explode("tokens").alias("e")).groupBy("c", "e").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    most = stored(held.join(size, "c").where("2 * f > size").groupBy("c").agg(F.collect_list("e").alias("r")), "most")
    r = F.coalesce("r", F.array().cast("array<bigint>"))
    d = members.join(sets, "rep").join(most, "c", "left").select("c", "rep", "n", "label", F.concat(F.array_except("tokens", r), F.array_except(r, "tokens")).alias("d"))
    d = stored(d.select("*", F.size("d").cast("long").alias("nd"), (F.size("d") * F.lit(down) - F.col("n") * up).alias("s")), "differences")
    least = d.groupBy("c").agg(F.min(F.struct("s", "rep", "n", "label")).alias("m"))
    star = d.join(least, "c").where((F.col("s") + F.col("m.s") <= 0) & (F.col("label") != F.col("m.label"))).select(F.col("m.rep").alias("a"), F.col("m.n").alias("na"), F.col("rep").alias("b"), F.col("n").alias("nb"))
    e = d.select("c", "rep", F.explode("d").alias("e"))
    common = e.groupBy("c", "e").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    e = e.join(common, ["c", "e"]).groupBy("c", "rep").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("k"))
    e = stored(e.join(d.drop("d"), ["c", "rep"]).join(least.select("c", F.col("m.s").alias("ms")), "c"), "shared")
    o = F.greatest(F.ceil((F.greatest(F.col("s"), 1 - F.col("ms")) + F.col("s")) / F.lit(2 * down) - 1e-9), F.lit(1))
    first = F.greatest((F.size("k") - o + 1).cast("int"), F.lit(0))
    at = e.select("c", "rep", "n", "label", "s", (F.col("s") > -F.col("ms")).alias("probe"), o.cast("long").alias("o"), first.alias("first"), F.size("k").alias("m"), F.posexplode("k").alias("i", "k"))
    at = stored(at.select("c", F.col("k.e").alias("e"), "rep", "n", "label", "s", "o", "i", (F.col("m") - 1 - F.col("i")).alias("u"), "probe", (F.col("i") < F.col("first")).alias("index")).where("probe or index"), "at")
    key = at.groupBy("c", "e").agg(F.count(F.lit(1)).alias("size"), F.count_if("index").alias("i"), F.count_if("probe").alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct(F.xxhash64("rep").alias("h"), "rep")).alias("leader"))
    at = at.join(key.where("i > 0 and p > 0 and lo != hi").select("c", "e", (F.col("i") * F.col("p") > SPARE * F.col("size")).alias("hot"), F.col("leader.rep").alias("leader")), ["c", "e"])
    if depth:
        again = stored(at.where("hot").select(F.col("leader").alias("c"), "rep", "n", "label").distinct(), "members")
        at = at.where("not hot")
        if not again.isEmpty():
            star = star.unionByName(hot_pairs(again, sets, t, depth - 1))
    index, probe = (at.where(x).select("c", "e", *[F.col(k).alias(k[0] + y) for k in ("rep", "n", "s", "label", "o", "i", "u")]) for x, y in (("index", "b"), ("probe", "a")))
    near = (F.col("na") * t.denominator >= F.col("nb") * t.numerator) & (F.col("nb") * t.denominator >= F.col("na") * t.numerator)
    wanted = F.ceil((F.col("sa") + F.col("sb")) / F.lit(2 * down) - 1e-9)
    # no more elements can be shared than stand before e in both, and behind it
    room = F.least("ia", "ib") + F.least("ua", "ub") + 1 >= wanted
    found = index.join(probe, ["c", "e"]).where(room & (F.col("la") != F.col("lb")) & ((F.col("sb") < F.col("sa")) | (F.col("sb") == F.col("sa")) & (F.col("rb") < F.col("ra"))) & near)
    # what B doesn't index adds at most o - 1 elements to those found; where a hot element is shared too, the group of that one has the pair
    found = found.groupBy("c", "ra", "na", "rb", "nb", "sa", "sb", "ob").agg(F.count(F.lit(1)).alias("both"))
    found = found.where(F.col("both") + F.col("ob") - 1 >= wanted)
    return stored(star.unionByName(found.select(F.col("ra").alias("a"), "na", F.col("rb").alias("b"), "nb")).distinct(), "hot-pairs")


def few_groups(hot: DataFrame, least: Column) -> tuple[DataFrame, DataFrame]:
    """(c, rep, n, label) of the groups c that a class stays in, and (rep, lost): its elements in those that it leaves.

    hot has a row for each element x of a class that stands in more than HOT of them, with x's group c. Linked classes share
    `least` elements of their long prefixes at least. Groups have one order, by the elements that a member has in them on
    average; a class leaves the groups of its end of it that hold fewer than `least` of its elements together. Of two linked
    classes let A be the one that leaves from the earlier place on: not all they share lies after it, so a group that both
    stay in holds some, or an element that isn't hot does."""
    w = stored(hot.groupBy("c", "rep", "n", "label").agg(F.count(F.lit(1)).alias("w")), "in-groups")
    mean = w.groupBy("c").agg((F.sum("w") / F.count(F.lit(1))).alias("mean"))
    after = F.sum("w").over(W.partitionBy("rep").orderBy("mean", "c").rowsBetween(W.unboundedPreceding, 0))
    w = stored(w.join(mean, "c").withColumn("left", after < least), "in-groups")
    return w.where("not left").select("c", "rep", "n", "label"), w.where("left").groupBy("rep").agg(F.sum("w").alias("lost"))


def links(d: DataFrame, t: Fraction) -> DataFrame:
    """Merge the classes of d (rep, n, central, p1, p2, p3, tokens): (rep, component) of those that link."""
    need = lambda n: F.ceil(n * F.lit(t.numerator) / F.lit(t.denominator) - 1e-9)
    sure = lambda n: 1 + F.floor(n * float(EXTRA) - 1e-6)
    common = common_elements(d.select(F.xxhash64("rep").alias("rep"), "p1"))
    e = stored(shared_only(d.select("rep", "n", "central", F.explode("p1").alias("x")), common), "prefixes")
    sets = d.select("rep", "tokens")
    found: DataFrame | None = None
    labels: DataFrame | None = None
    for step in range(ROUNDS + 1):
        g = e.withColumn("label", F.col("rep")) if labels is None else e.join(labels, "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
        near = (F.col("na") >= need(F.col("nb"))) & (F.col("nb") >= need(F.col("na")))
        if step < ROUNDS:
            rank = F.struct(*([(-F.col("central")).alias("k")] if not step else []), F.xxhash64("rep", F.lit(step)).alias("h"), "rep", "n", "label")
            centre = g.groupBy("x").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(rank).alias("c")).where("lo != hi").select("x", F.col("c.rep").alias("a"), F.col("c.n").alias("na"), F.col("c.label").alias("la"))
            pairs = g.join(centre, "x").where(F.col("label") != F.col("la")).select("a", "na", F.col("rep").alias("b"), F.col("n").alias("nb")).where(near)
            # each member meets the centre that it shares most with
            pairs = pairs.groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("c")).groupBy("b", "nb").agg(F.max(F.struct("c", "a", "na")).alias("m")).select("b", "nb", "m.a", "m.na")
        else:
            first = F.min(F.struct((-F.col("central")).alias("k"), F.xxhash64("rep").alias("h"), "rep")).alias("c")
            open_ = g.groupBy("x").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"), first).where("lo != hi").select("x", "size", F.col("c.rep").alias("c"))
            open_ = stored(g.join(open_, "x"), "open")
            members, lost = few_groups(open_.where(F.col("size") > HOT), sure(need(need(F.col("n")))))
            g = open_.where(F.col("size") <= HOT).join(lost, "rep", "left")
            left = g.select("x", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("lost").alias("da"))
            pairs = left.join(g.select("x", F.col("rep").alias("b"), F.col("n").alias("nb"), "label", F.col("lost").alias("db")), "x").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("label"))).where(near)
            # the long prefixes of linked sets share as many elements as is sure for the smaller; all but those of left groups are here if no kept group holds both
            pairs = pairs.groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("c"), F.greatest(F.coalesce(F.max("da"), F.lit(0)), F.coalesce(F.max("db"), F.lit(0))).alias("lost"))
            pairs = pairs.where(F.col("c") + F.col("lost") >= F.least(sure(need(F.col("nb"))), sure(need(F.col("na"))))).drop("c", "lost")
            if not members.isEmpty():
                pairs = pairs.unionByName(hot_pairs(members, sets, t)).distinct()
        # pairs must meet under the other orders before any whole set is read
        first = stored(pairs.select("a", "na", "b", "nb"), "pairs")
        side = lambda k, *cols: d.select(F.col("rep").alias(k), *[F.col(c).alias(c + k) for c in cols])
        j = first.join(side("a", "p2", "p3"), "a").join(side("b", "p2", "p3"), "b").where(F.arrays_overlap("p2a", "p2b") & F.arrays_overlap("p3a", "p3b"))
        pairs = stored(j.select("a", "na", "b", "nb"), "pairs")
        j = pairs.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b")
        both = F.size(F.array_intersect("tokensa", "tokensb")).cast("long")
        new = stored(j.where(both * t.denominator >= (F.col("na") + F.col("nb") - both) * t.numerator).select("a", "b"), "links")
        drop_stored(first, pairs)
        release(d.sparkSession)
        if not new.isEmpty():
            found = new if found is None else found.unionByName(new)
            labels = stored(components(found).select(F.col("node").alias("rep"), "component"), "labels")
    return labels if labels is not None else d.sparkSession.createDataFrame([], "rep long, component long")


def labelled(docs: DataFrame, words: int, threshold: float | str) -> DataFrame:
    """(doc_id, th, n, component_id, first) of all rows. first: the row is the one that its component is named by, or belongs to none."""
    t = Fraction(str(threshold))
    long = stored(sets_of(docs, words, t), "sets")
    names = named_classes(long)
    left = stored(candidates_left(long, names, t), "left")
    sets = stored(long.select("doc_id", "th", "n", "fa", "fb"), "classes")
    drop_stored(long)
    release(docs.sparkSession)
    # the class decides, not the id alone: rows of one id may have different texts
    mine = left.select("rep", "central").join(names.select("rep", "id", F.col("fa").alias("_a"), F.col("fb").alias("_b")), "rep")
    whole = sets_of(docs, words, t, bit_set(mine, "id"), whole=True).where("doc_id is not null and n > 0")
    d = whole.join(mine, (F.col("doc_id") == F.col("id")) & (F.col("fa") == F.col("_a")) & (F.col("fb") == F.col("_b")))
    # a class has one (id, fa, fb), so equal rows stand together after the join already
    one = F.row_number().over(W.partitionBy("doc_id", "fa", "fb").orderBy("th"))
    d = stored(d.withColumn("_r", one).where("_r = 1").select("rep", "n", "central", "p1", "p2", "p3", "tokens"), "whole")
    labels = links(d, t)
    # Components whose name isn't the smallest id, as hashes were among their classes' names.
    m = F.min(F.struct("id", "th", "rep")).alias("m")
    other = names.join(labels, "rep").groupBy("component").agg(m).where((F.col("m.id") != F.col("component")) | (F.col("m.rep") != F.col("component")))
    # A component may hold most classes: its classes are spread over SPREAD tasks.
    other = other.select(F.col("component").alias("_c"), F.col("m.id").alias("_id"), F.col("m.rep").alias("_rep"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_p"))
    named = names.join(labels, "rep", "left").join(other, (F.col("component") == F.col("_c")) & (F.pmod(F.xxhash64("rep"), F.lit(SPREAD)) == F.col("_p")), "left")
    head = F.col("rep") == F.coalesce("_rep", "component", "rep")
    # a class of its own is named by its id, whatever the class's name
    named = named.select(F.col("fa").alias("_a"), F.col("fb").alias("_b"), F.coalesce("_id", "component", "id").alias("component"), F.when(head, F.struct("id", F.col("th").alias("th"))).alias("head"))
    out = sets.join(named, (F.col("fa") == F.col("_a")) & (F.col("fb") == F.col("_b")) & (F.col("n") > 0), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    first = F.col("doc_id").isNull() | (F.col("n") == 0) | F.coalesce((F.col("doc_id") == F.col("head.id")) & (F.col("th") == F.col("head.th")), F.lit(False))
    return out.select("doc_id", sets["th"], "n", component.cast("long").alias("component_id"), first.alias("first"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float | str = "0.8") -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id that links of at least threshold reach, itself included."""
    return labelled(docs, words, threshold).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, words: int = 5, threshold: float | str = "0.8") -> DataFrame:
    """docs with one row of each component, one of its smallest id; equal rows of one id are kept once. Rows with a null id stay, and so
    do texts without words."""
    n = labelled(docs, words, threshold).where("not first").select(F.col("doc_id").alias("_gone"), F.col("th").alias("_t")).distinct()
    d = as_rows(docs).select("_row", F.col("_row.doc_id").cast("long").alias("_id"), F.xxhash64("_row.text").alias("_th"))
    kept = d.join(n, (F.col("_id") == F.col("_gone")) & (F.col("_th") == F.col("_t")), "left_anti")
    w = W.partitionBy("_id", "_th").orderBy("_th")
    return kept.withColumn("_r", F.row_number().over(w)).where(F.col("_id").isNull() | (F.col("_r") == 1)).select(*of_rows(docs))

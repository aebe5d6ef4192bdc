"""Operator 1, n-gram Jaccard join: near-duplicate documents and their components.

Method: token-group matrix. Texts become sets of hashed 5-word shingles.

1. Documents of equal sets are one class; one member stands for it.
2. A shingle that only one class holds can't be shared. Classes of whose shingles fewer than the threshold's share are
   held by a second class have no link and are left out; what is left is small. This pass shuffles each shingle once,
   in 5 bytes, and a shingle that several classes of a block hold goes out once for the block.
3. The rest is partitioned into groups of similar sets: sets that agree in a band of minimal hashes meet the least of
   them, and those of at least half its shingles in common, linked or not, are of its group.
4. Each group stores the union of its members' shingles, in slices. A set asks the groups of other sets with its
   rarest shingles (the prefix that any linked pair must share); shingles that the same groups hold ask once. For the
   groups found, the union's overlap with the set bounds the similarity with every member, given the members' sizes.
   Only groups at or over the threshold are opened: the set visits them.
5. In a group, each set, home or visitor, is told by its difference from the group's core, the shingles of more than
   half its members. For sets of n and m shingles that differ from the core in p and q, the pair is linked when
   7 (p + q - 2 both) <= n + m, where both counts the differences they share. With a = 7 p - n, a pair of a + b <= 0 is
   linked whatever it shares, and then both are linked with the set of the least a: one link for each set. Any other
   pair must share (a + b) / 14 of its differences, so it shares one of the rarest, and these are few: sets near the
   core have almost none to show. What isn't linked with the least makes a group of its own for the next round.

No link between documents of different components is lost; links within a component need not be listed. A group of
copies of any size costs as many comparisons as it has members.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import words as W
from inkloom.llm.components import components
from inkloom.session import Scratch

#: The threshold 3/4 as a fraction: sets of n and m shingles with i in common are linked when 7 i >= 3 (n + m).
NUM, DEN = 3, 4
BROADCAST_ROWS = 500_000
CLASS_RATIO = 1.2


class Shingler:
    """Sets of hashed shingles of each text of a column; a text of fewer words has one of all its words."""

    def __init__(self, k: int):
        self.k, self.words, self.windows = k, W.Words((21,), lower=True), W.Windows(k)

    def sets(self, column) -> list[np.ndarray]:
        data, off = W.string_parts(column)
        _, _, (h,), first = self.words.hashes(data, off)
        total, inverse = self.windows.sums(h)
        all_of = W.mix((total[self.k :] - total[: -self.k]) * inverse[: len(total) - self.k]) if len(h) >= self.k else h[:0]
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= self.k:
                x = np.sort(all_of[a : b - self.k + 1])
                out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            elif b > a:
                out.append(W.mix((total[b : b + 1] - total[a : a + 1]) * inverse[a : a + 1]))
            else:
                out.append(all_of[:0])
        return out


def _prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set's members, 128 bits in all."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    ends = np.cumsum([len(s) for s in sets])
    out = []
    for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(flat ^ np.uint64(seed)))])
        out.append(total[ends] - total[ends - [len(s) for s in sets]])
    return out[0].view(np.int64), out[1].view(np.int64)


def sign(k: int, block: int):
    def run(batches):
        shingler = Shingler(k)
        for batch in batches:
            for part in W.slices(batch, "text", block):
                sets = shingler.sets(part.column(part.schema.get_field_index("text")))
                a, b = _prints(sets)
                yield pa.record_batch([part.column(part.schema.get_field_index("doc_id")), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n", "fa", "fb"])

    return run


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def spread(k: int, block: int, buckets: int):
    """For each block and bucket of shingles: the classes (their first print), how many of each one's shingles other
    classes of the block hold, and the shingles: low 40 bits and the class's number, or 65535 where it is settled."""

    def run(batches):
        shingler = Shingler(k)
        for batch in batches:
            for part in W.slices(batch, "text", block):
                for at in range(0, part.num_rows, 60_000):
                    yield from one(shingler.sets(part.column(part.schema.get_field_index("text")).slice(at, 60_000)))

    def one(sets):
        fa, _ = _prints(sets)
        _, pick = np.unique(fa, return_index=True)
        pick = [i for i in pick.tolist() if len(sets[i])]
        if not pick:
            return
        fa = fa[pick]
        h = np.concatenate([sets[i] for i in pick])
        own = np.repeat(np.arange(len(pick), dtype=np.uint16), [len(sets[i]) for i in pick])
        order = np.argsort(h, kind="stable")
        h, own = h[order], own[order]
        start = _starts(h)
        count = np.diff(np.append(start, len(h)))
        many = np.repeat(count > 1, count)
        to = ((h >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
        cut = np.searchsorted(to, np.arange(buckets + 1))
        single = np.where(count > 1, np.uint16(65535), own[start])
        cut_start = np.searchsorted(start, cut)
        cols = [[], [], [], []]
        for b in range(buckets):
            lo, hi = cut[b], cut[b + 1]
            if lo == hi:
                continue
            local = np.bincount(own[lo:hi][many[lo:hi]], minlength=len(pick))
            mine = single[cut_start[b] : cut_start[b + 1]]
            used = np.zeros(65536, bool)
            used[mine] = True
            used[65535] = False
            used[: len(pick)] |= local > 0
            dense = np.flatnonzero(used)
            name = np.full(65536, 65535, np.uint16)
            name[dense] = np.arange(len(dense), dtype=np.uint16)
            x = h[start[cut_start[b] : cut_start[b + 1]]]
            tail = np.empty(len(x), np.dtype([("lo", "<u4"), ("hi", "u1")]))
            tail["lo"], tail["hi"] = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) & np.uint64(0xFF)
            cols[0].append(b)
            cols[1].append(fa[dense].tobytes() + local[dense].astype(np.int32).tobytes())
            cols[2].append(tail.tobytes())
            cols[3].append(name[mine].tobytes())
        yield pa.record_batch([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "classes", "tails", "owners"])

    return run


def shared_counts(parts: int):
    """For each class with shingles in the bucket: how many of them another class holds too, packed by part of the
    classes. A class in several blocks counts once for each, which can only keep it in."""

    def run(table: pa.Table) -> pa.Table:
        who, n = _shared(table)
        part = (W.mix(who.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, who, n = part[order], who[order], n[order]
        cut = _starts(part)
        ends = np.append(cut[1:], len(part)) if len(part) else cut
        return pa.table({"part": pa.array(part[cut], pa.int32()), "fas": pa.array([who[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()), "counts": pa.array([n[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())})

    return run


def _sums(who: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    who, inverse = np.unique(who, return_inverse=True)
    return who, np.bincount(inverse, n, len(who)).astype(np.int64)


def sum_counts(table: pa.Table) -> pa.Table:
    """fa and its counts over all buckets."""
    who, n = _sums(*(np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("fas", "counts")))
    return pa.table({"fa": pa.array(who), "shared": pa.array(n)})


def _shared(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    tails, prints, extra_print, extra = [], [], [], []
    for classes, tail, owner in zip(*(table.column(c).to_pylist() for c in ("classes", "tails", "owners"))):
        m = len(classes) // 12
        fa = np.frombuffer(classes[: 8 * m], np.int64)
        local = np.frombuffer(classes[8 * m :], np.int32)
        extra_print.append(fa[local > 0])
        extra.append(local[local > 0])
        x = np.frombuffer(tail, np.dtype([("lo", "<u4"), ("hi", "u1")]))
        tails.append(x["lo"].astype(np.uint64) | (x["hi"].astype(np.uint64) << np.uint64(32)))
        who = np.frombuffer(owner, np.uint16)
        prints.append(np.where(who == 65535, np.int64(0), fa[np.minimum(who, m - 1)] if m else np.int64(0)))
        tails[-1] = (tails[-1] << np.uint64(1)) | (who == 65535)
    x, fa = np.concatenate(tails), np.concatenate(prints)
    order = np.argsort(x, kind="stable")
    x, fa = x[order], fa[order]
    start = _starts(x >> np.uint64(1))
    size = np.diff(np.append(start, len(x)))
    settled = np.maximum.reduceat((x & np.uint64(1)).astype(np.int8), start) > 0 if len(x) else np.zeros(0, bool)
    differ = np.minimum.reduceat(fa, start) != np.maximum.reduceat(fa, start) if len(x) else settled
    hit = np.repeat(settled | differ, size) & (x & np.uint64(1) == 0)
    who = np.concatenate([fa[hit], *extra_print])
    n = np.concatenate([np.ones(int(hit.sum()), np.int64), *extra]).astype(np.int64)
    return _sums(who, n)


def sets_and_bands(k: int, block: int, bands: int, rows: int):
    """doc_id, shingles, and a key for each band of minimal hashes."""
    seeds = W.mix(np.arange(1, bands * rows + 1, dtype=np.uint64))

    def run(batches):
        shingler = Shingler(k)
        for batch in batches:
            for part in W.slices(batch, "text", block):
                sets = shingler.sets(part.column(part.schema.get_field_index("text")))
                least = np.zeros((len(sets), bands * rows), np.uint64)
                full = [j for j, x in enumerate(sets) if len(x)]
                if full:
                    joined = np.concatenate([sets[j] for j in full])
                    begin = np.cumsum([0] + [len(sets[j]) for j in full[:-1]])
                    for i, s in enumerate(seeds):
                        least[full, i] = np.minimum.reduceat(W.mix(joined ^ s), begin)
                keys = np.zeros((len(sets), bands), np.uint64)
                for b in range(bands):
                    for r in range(rows):
                        keys[:, b] = W.mix(keys[:, b] ^ least[:, b * rows + r] ^ np.uint64(b + 1))
                lens = np.cumsum([0] + [len(s) for s in sets])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.record_batch(
                    [
                        part.column(part.schema.get_field_index("doc_id")),
                        pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(flat)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel())),
                    ],
                    names=["doc_id", "tokens", "bands"],
                )

    return run


def _common(a: str, b: str):
    return F.size(F.array_intersect(a, b))


def _prefix(rare: str, total, n):
    """Of an array of (count, mark) in the order of counts, the last of ``total`` members: the marks of those of the
    first n, each once, and how many members are left from its first place on."""
    own = total - F.size(rare)
    shown = F.slice(F.col(rare)["mark"], 1, F.greatest(n - own, F.lit(0)).cast("int"))
    marked = F.transform(shown, lambda m, i: F.struct(m.alias("mark"), (total - own - i).cast("int").alias("left")))
    return F.filter(marked, lambda x, i: (i == 0) | (x["mark"] != F.get(shown, i - 1)))


def _visits(placed: DataFrame, scratch: Scratch, slice_tokens: int, n_sets: int) -> DataFrame:
    """rid and grp: which groups, beside its own, each set has to be compared with; n_sets, how many sets there are,
    bounds what has a row for each group and is broadcast."""
    small = F.broadcast if n_sets <= BROADCAST_ROWS else lambda df: df
    cells = placed.select("rid", "n", "grp", F.explode("tokens").alias("token"))
    held_by = cells.groupBy("grp", "token").agg(F.lit(1).alias("one")).groupBy("token")
    across = held_by.agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("grp")).alias("mark")).where("df > 1").select("token", "df", F.xxhash64("df", "mark").alias("mark"))
    rare = cells.join(across, "token").groupBy("rid", "n", "grp").agg(F.sort_array(F.collect_list(F.struct("df", "mark"))).alias("rare"))
    rare = rare.where(DEN * F.size("rare") >= NUM * F.col("n"))
    n = F.col("n")
    asks, kept = (_prefix("rare", n, n - F.ceil(n * a / b) + 1) for a, b in ((NUM, DEN), (2 * NUM, NUM + DEN)))
    rare = scratch.save(rare.select("rid", "n", "grp", asks.alias("asks"), kept.alias("kept")), "rare")
    asked = rare.select("rid", "n", F.col("grp").alias("home"), F.inline("asks"))
    columns = rare.select("grp", "n", F.inline("kept")).groupBy("mark", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("left").alias("left2"))
    # the larger set asks; from the first mark they share on, either must have enough left
    fits = f"home <> grp AND least <= n AND {DEN} * most >= {NUM} * n AND {DEN + NUM} * least(left, left2) >= {NUM} * (n + greatest(least, {NUM} * n / {DEN}))"
    met = asked.join(columns, "mark").where(fits).select("rid", "grp").distinct()
    met = scratch.save(met, "met")

    facts = placed.join(small(met.select("grp").distinct()), "grp").groupBy("grp").agg(F.min("n").alias("least"), F.ceil(F.sum("n") / slice_tokens).alias("slices"))
    spread = placed.join(small(facts), "grp").select("grp", "least", "slices", F.explode("tokens").alias("token"))
    unions = spread.groupBy("grp", "least", F.pmod(F.xxhash64("token"), F.col("slices")).alias("slice")).agg(F.collect_set("token").alias("union"))
    overlap = met.join(placed.select("rid", "n", "tokens"), "rid").join(unions.hint("merge"), "grp").select("rid", "grp", "n", "least", _common("tokens", "union").alias("i"))
    total = overlap.groupBy("rid", "grp", "n", "least").agg(F.sum("i").alias("i"))
    opened = total.where(f"{DEN} * i >= {NUM} * n AND {DEN + NUM} * i >= {NUM} * (n + least)").select("rid", "grp")
    return scratch.save(opened, "opened")


def _against_core(rows: DataFrame, group_rows: int, small) -> DataFrame:
    """rows (grp, home, rid, doc_id, n, tokens) of groups of two sets at least, one of them at home, and z, the
    differences from the group's core, and a."""
    counts = rows.groupBy("grp").agg(F.count("*").alias("members"), F.count_if("home").alias("homes")).where("members > 1 AND homes > 0")
    counts = counts.withColumn("salts", F.ceil(F.col("members") / group_rows))
    facts = small(counts)
    cells = rows.where("home").join(facts, "grp").select("grp", "homes", F.explode("tokens").alias("token"))
    core = cells.groupBy("grp", "homes", "token").agg(F.count("*").alias("c")).where("2 * c > homes").groupBy("grp").agg(F.collect_list("token").alias("core"))
    # a group of very many rows is dealt out, with a copy of its core for each part
    dealt = counts.join(core, "grp", "left").select("grp", "salts", F.coalesce("core", F.array().cast("array<long>")).alias("core"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    salted = rows.join(facts.select("grp", "salts"), "grp").withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts"))).drop("salts")
    z = F.concat(F.array_except("tokens", "core"), F.array_except("core", "tokens"))
    out = salted.join(dealt.drop("salts"), ["grp", "salt"]).select("grp", "home", "rid", "doc_id", "n", "tokens", z.alias("z"))
    return out.withColumn("a", (DEN + NUM) * F.size("z") - F.col("n"))


def _within(rows: DataFrame, scratch: Scratch, rounds: int, group_rows: int, n_sets: int) -> list[DataFrame]:
    """Links (a, b) of doc_ids that join all linked sets of each group; rows have grp, home, rid, doc_id, n, tokens;
    n_sets, how many sets there are, bounds what has a row for each group and is broadcast."""
    small = F.broadcast if n_sets <= BROADCAST_ROWS else lambda df: df
    links = []
    for r in range(rounds):
        zs = scratch.save(_against_core(rows, group_rows, small), "z")
        least = zs.groupBy("grp").agg(F.min(F.struct("a", "doc_id")).alias("x")).select("grp", F.col("x.a").alias("a0"), F.col("x.doc_id").alias("doc0"))
        zs = zs.join(small(least), "grp").withColumn("near", F.col("a") + F.col("a0") <= 0)
        links.append(zs.where("near").select(F.col("doc_id").alias("a"), F.col("doc0").alias("b")))
        far = zs.where("NOT near")
        n_far, n_next = zs.selectExpr("count_if(NOT near)", "count_if(NOT near AND a0 <= 0)").first()
        if not n_far:
            break
        # what a pair that isn't near must share, by what is known of one side
        some = zs.join(small(far.select("grp").distinct()), "grp", "left_semi").where(F.size("z") > 0)
        cells = some.select("grp", "rid", F.explode("z").alias("token"))
        held = cells.groupBy("grp", "token").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("rid")).alias("mark")).where("df > 1").select("grp", "token", "df", F.xxhash64("df", "mark").alias("mark"))
        rare = cells.join(held, ["grp", "token"]).groupBy("grp", "rid").agg(F.sort_array(F.collect_list(F.struct("df", "mark"))).alias("rare"))
        slim = some.select("grp", "rid", "home", "n", "near", F.size("z").alias("p"), "a", "a0").join(rare, ["grp", "rid"])
        first = lambda x: _prefix("rare", F.col("p"), F.col("p") + 1 - F.ceil(x / (2 * (DEN + NUM))))
        slim = slim.withColumn("asks", F.when(~F.col("near"), first(F.col("a") + F.col("a0")))).withColumn("kept", first(F.col("a") - F.col("a0") + 1))
        # sets by their a: what a pair must share follows from either's class, so classes meet with prefixes of their own
        slim = slim.withColumn("class", F.floor(F.log(F.col("a") - F.col("a0") + 2 * (DEN + NUM)) / math.log(CLASS_RATIO)).cast("int"))
        slim = scratch.save(slim.drop("rare"), "slim")
        classes = slim.groupBy("grp", "class").agg(F.min("a").alias("least")).groupBy("grp").agg(F.collect_list(F.struct("class", "least")).alias("classes"))
        slim = slim.join(F.broadcast(classes) if n_sets * 20 <= BROADCAST_ROWS else classes, "grp")
        can = F.expr(f"filter(classes, c -> {2 * (DEN + NUM)} * left >= a + c.least)['class']")
        asked = slim.where("NOT near").select("grp", "rid", "home", "n", "a", F.col("class").alias("of"), "classes", F.inline("asks"))
        asked = asked.select("grp", "rid", "home", "n", "a", "mark", "left", "of", F.explode(can).alias("to"))
        # where none is near, or in the last round, those that aren't near meet each other too
        shown = (slim if r == rounds - 1 else slim.where("near OR a0 > 0")).select("grp", "rid", "home", "n", "a", "near", F.col("class").alias("to"), "classes", F.inline("kept"))
        shown = shown.select("grp", F.col("rid").alias("other"), F.col("home").alias("home2"), F.col("n").alias("m"), F.col("a").alias("b"), "near", "mark", F.col("left").alias("left2"), "to", F.explode(can).alias("of"))
        # from the first mark they share on, either must have enough left
        fits = f"(home OR home2) AND {DEN} * least(n, m) >= {NUM} * greatest(n, m) AND {2 * (DEN + NUM)} * least(left, left2) >= a + b AND (near OR rid < other)"
        # merged, as marks of near copies take little room in files and many times that in a broadcast
        pairs = scratch.save(asked.join(shown.hint("merge"), ["grp", "mark", "of", "to"]).where(fits).select("grp", "rid", "other").distinct(), "pairs")
        one = zs.select("grp", "rid", "doc_id", "n", "z")
        two = zs.select("grp", F.col("rid").alias("other"), F.col("doc_id").alias("doc2"), F.col("n").alias("m"), F.col("z").alias("z2"))
        both = pairs.join(one, ["grp", "rid"]).join(two.hint("merge"), ["grp", "other"])  # no rows with sets are broadcast
        linked = both.where(f"{DEN + NUM} * (size(z) + size(z2) - 2 * size(array_intersect(z, z2))) <= n + m")
        links.append(scratch.save(linked.select(F.col("doc_id").alias("a"), F.col("doc2").alias("b")), "linked"))
        if not n_next:
            break
        rows = far.where("a0 <= 0").select("grp", "home", "rid", "doc_id", "n", "tokens")
    return links


def ngram_components(docs: DataFrame, k: int = 5, bands: int = 8, band_rows: int = 3, block: int = 2 << 20, bucket_shingles: int = 1_000_000, class_part: int = 25_000, slice_tokens: int = 20_000, rounds: int = 4, group_rows: int = 2000) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text; other columns are not read).

    Words are lower-cased (A-Z); a set is the distinct k-word shingles of the whole text, with fewer words the whole
    sequence. Two documents are linked when their sets' similarity is 3/4 or more; component_id is the smallest doc_id
    that links lead to. A document without words (null, empty or only white space) has n_shingles 0 and is alone, as is
    a row with a null doc_id, whose component_id is null. Rows with one doc_id are one node, whatever their texts, so
    that all of them that have words come out with one component_id. Repeated rows come out as often as they go in; an
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.save(docs.mapInArrow(sign(k, block), "doc_id long, n long, fa long, fb long"), "signed")
    named = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.save(named.groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "classes")

    total, n_classes = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    buckets = int(max(16, total // bucket_shingles))
    spreaded = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(spread(k, block, buckets), "bucket int, classes binary, tails binary, owners binary")
    parts = int(max(8, n_classes // class_part))
    packed = spreaded.groupBy("bucket").applyInArrow(shared_counts(parts), "part int, fas binary, counts binary")
    shared = packed.groupBy("part").applyInArrow(sum_counts, "fa long, shared long")
    left = scratch.save(classes.join(shared, "fa").where(DEN * F.col("shared") >= NUM * F.col("n")).select("rep", "n"), "left")

    found = left.select(F.col("rep").alias("doc_id")).distinct()
    n_sets = left.count()
    found = F.broadcast(found) if n_sets <= BROADCAST_ROWS else found
    prints = docs.join(found, "doc_id", "left_semi")
    sets = scratch.save(
        prints.mapInArrow(sets_and_bands(k, block, bands, band_rows), "doc_id long, tokens array<long>, bands array<long>")
        .where("size(tokens) > 0")
        .withColumn("rid", F.xxhash64("doc_id", "tokens"))
        .dropDuplicates(["rid"])
        .select("rid", "doc_id", F.size("tokens").alias("n"), "tokens", "bands"),
        "sets",
    )

    # groups: the least set of each band leads; sets at least half like it, linked or not, are of its group
    band = sets.select("rid", F.posexplode("bands").alias("b", "key"))
    lead = band.groupBy("b", "key").agg(F.min("rid").alias("lead"), F.count("*").alias("c")).where("c > 1").drop("c")
    pairs = band.join(lead, ["b", "key"]).where("rid <> lead").select("rid", "lead").distinct()
    leads = sets.select(F.col("rid").alias("lead"), F.col("n").alias("m"), F.col("tokens").alias("other"))
    like = pairs.join(sets.select("rid", "n", "tokens"), "rid").join(leads.hint("merge"), "lead").where("2 * least(n, m) >= greatest(n, m)").where(3 * _common("tokens", "other") >= F.col("n") + F.col("m"))
    like = scratch.save(like.groupBy("rid").agg(F.min("lead").alias("lead")), "like")
    again = like.select(F.col("rid").alias("lead"), F.col("lead").alias("above"))
    group = like.join(again, "lead", "left").select("rid", F.coalesce("above", "lead").alias("grp"))
    placed = scratch.save(sets.drop("bands").join(group, "rid", "left").withColumn("grp", F.coalesce("grp", "rid")), "placed")

    visits = _visits(placed, scratch, slice_tokens, n_sets)
    home = placed.select("grp", F.lit(True).alias("home"), "rid", "doc_id", "n", "tokens")
    visiting = visits.join(placed.drop("grp"), "rid").select("grp", F.lit(False).alias("home"), "rid", "doc_id", "n", "tokens")
    links = _within(home.unionByName(visiting), scratch, rounds, group_rows, n_sets)
    # a doc_id with several texts is one node: the classes of its texts belong together
    several = named.groupBy("doc_id").agg(F.min(F.struct("fa", "fb")).alias("lo"), F.max(F.struct("fa", "fb")).alias("hi")).where("lo <> hi").select("doc_id")
    links.append(named.join(several, "doc_id").join(classes.drop("n"), ["fa", "fb"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    final = components(every, scratch)

    by_class = scratch.save(classes.join(final, F.col("rep") == F.col("node"), "left").select("fa", "fb", F.coalesce("component", "rep").alias("component")), "by_class")
    scratch.keep(signed, by_class)
    return (
        signed.join(by_class, ["fa", "fb"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

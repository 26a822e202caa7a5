"""N-gram Jaccard join by universe partition and the pigeonhole rule, verified exactly.

A document's set holds the hashes of its distinct five-word shingles (words [^\\x20\\x09-\\x0D]+, A-Z lower-cased; fewer words:
the whole sequence as one; none: empty and linked with nothing). Two sets link when 4 * intersection >= 3 * union, so their
difference has at most H = (a + b) / 7 members.

Sets are dealt to size bands with edges at 4/3; a link joins a band with itself or the next. In each family (a band and the
one above it) shingle hashes are dealt to m segments of the universe. At most H segments of linked sets differ, so a set with
more than H filled segments shares a filled one with every partner. Segments are indexed at the following cost, cheapest safe
form first:
  - every filled segment once, as one hash of its members;
  - segments that more than HOT classes share are skipped for sets which have more than H filled ones without them, and a
    pair must then share as many of the other filled segments as exceed H;
  - sets with at most H filled segments are also indexed by fewer, wider segments with their one-deletion neighbourhoods
    (of m' segments at most H / 2 differ in two members or more).
Index entries are exchanged as packed blocks, equal sets count once (a class), and candidates are verified against whole
sets: first one per class, then those that still lie in different components, then the crowded segments, from
doubling numbers of members until every pair in them is verified or in one component. No pair list of a group is built
where one component already holds it.

Null ids are a value; repeated rows are members of one class; other columns are not read by `components`. Hashes have 64 bits
(48 where two sets are compared).
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from plumbline.llm.kit import U, bitmap, fresh, keep, mix, passes, shingles, shuffle_parts, slices

HOT = 8
FILTER_BITS = 24
FLUSH = 4_000_000
SALT_ROWS = 1024
RARE = 64


def band_edges(most: int = 1 << 40) -> list[int]:
    edges = [1]
    while edges[-1] < most:
        edges.append(edges[-1] * 4 // 3 + 1)
    return edges


EDGES = band_edges()


def family(f: int) -> tuple[int, int, int]:
    """Largest difference H, segments m, wide segments m' of the links between band f and bands f, f + 1."""
    top = EDGES[f + 1] - 1
    h = top // 3
    return h, top // 2 + 2, h // 2 + 1 + max(1, h // 8)


class Sets:
    """Shingle sets of a slice of documents: hashes sorted within each document, sizes, and a hash of each whole set."""

    def __init__(self, texts):
        start, end, before = texts.words()
        values, doc = shingles(texts.hashes(start, end), before)
        for i, j in pairwise(np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()):
            values[i:j].sort()
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
        self.values, self.doc = values[new], doc[new]
        self.size = np.bincount(self.doc, minlength=len(texts))
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        sums = np.concatenate([[U(0)], np.cumsum(mix(self.values ^ U(0x5851F42D4C957F2D)))]).astype(U)
        self.cls = mix(sums[self.at[1:]] - sums[self.at[:-1]] + self.size.astype(U))

    def segments(self, fam: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First value and document of each filled segment, and the sum of member hashes up to each value. fam, count: per document."""
        part = ((self.values >> U(32)) * count[self.doc].astype(U)) >> U(32)
        first = np.ones(len(part), bool)
        first[1:] = (part[1:] != part[:-1]) | (self.doc[1:] != self.doc[:-1])
        return np.flatnonzero(first), part, mix(self.values)


def _keys(sums: np.ndarray, fam: np.ndarray, part: np.ndarray, kind: int) -> np.ndarray:
    return mix(sums + mix((fam.astype(U) << U(36)) + (part << U(4)) + U(kind)))


def entries(sets: Sets, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index keys, their documents and roles (0, 1: segments as lower and upper band; 2, 3: wide ones), and the slack
    (filled segments less H) of each document in its two families."""
    keys, docs, roles = [], [], []
    slack = np.zeros((2, len(sets.size)), np.int64)
    with np.errstate(over="ignore"):
        for role in (0, 1):
            fam = bands - role
            sets_in = (fam >= 0) & (sets.size > 0)
            if not sets_in.any():
                continue
            f = np.maximum(fam, 0)
            h, m, wide = (np.array([family(int(x))[k] for x in range(f.max() + 1)])[f] for k in range(3))
            first, part, member = sets.segments(f, m)
            ok = sets_in[sets.doc[first]]
            sums = np.add.reduceat(member, first) if len(first) else member
            first, sums = first[ok], sums[ok]
            doc = sets.doc[first]
            keys.append(_keys(sums, f[doc], part[first], 0))
            docs.append(doc)
            roles.append(np.full(len(doc), role))
            slack[role] = np.bincount(doc, minlength=len(f)) - h
            few = sets_in & (slack[role] <= 0)
            if few.any():
                k, d = _wide(sets, few, f, wide, h)
                keys.append(k)
                docs.append(d)
                roles.append(np.full(len(d), role + 2))
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(keys, U), join(docs, np.int64), join(roles, np.int64), slack


def _wide(sets: Sets, few: np.ndarray, fam: np.ndarray, count: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of wide segments: their content and their content less each member. The empty content is a key only for sets in
    which too few segments have two members or more."""
    first, part, member = sets.segments(fam, count)
    sums, size = np.add.reduceat(member, first), np.diff(np.append(first, len(member)))
    doc = sets.doc[first]
    big = np.bincount(doc[size >= 2], minlength=len(few))
    bare = few & (big <= h // 2)
    own = few[doc]
    of = np.repeat(np.arange(len(first)), size)
    less = sums[of] - member
    value = few[sets.doc] & ((size[of] > 1) | bare[sets.doc])
    key = [_keys(sums[own], fam[doc[own]], part[first][own], 1), _keys(less[value], fam[sets.doc[value]], part[value], 1)]
    docs = [doc[own], sets.doc[value]]
    for d in np.flatnonzero(bare):  # segments without a member
        empty = np.setdiff1d(np.arange(count[d]), part[first[doc == d]].astype(np.int64)).astype(U)
        key.append(_keys(np.zeros(len(empty), U), np.full(len(empty), fam[d]), empty, 1))
        docs.append(np.full(len(empty), d))
    return np.concatenate(key), np.concatenate(docs)


def _bands(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(EDGES), np.maximum(size, 1), "right") - 1


def _index(docs: DataFrame, id: str, text: str, parts: int) -> DataFrame:
    """Rows (p, digest of a document) and rows (p, packed index entries)."""

    def run(batches):
        seen: set[int] = set()
        held, pending, kind = [], 0, None

        def flush():
            place = np.cumsum([0, *(len(c) for _, _, _, c in held)])
            key, role, of = (np.concatenate(x) for x in ([k for k, _, _, _ in held], [r for _, _, r, _ in held], [d + at for (_, d, _, _), at in zip(held, place, strict=False)]))
            p = ((key >> U(32)) * U(parts)) >> U(32)
            order = np.argsort(p << U(44) | of.astype(U) << U(2) | role.astype(U))
            key, cls, role, p = key[order], np.concatenate([c for _, _, _, c in held])[of[order]], role[order], p[order]
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1]) | (cls[1:] != cls[:-1]) | (role[1:] != role[:-1])
            run_at = np.flatnonzero(new)
            runs = np.diff(np.append(run_at, len(p))).astype(np.uint32) << np.uint32(2) | role[run_at].astype(np.uint32)
            short = key.view(np.uint8).reshape(-1, 8)[:, :5]
            cut, cut_runs = np.searchsorted(p, np.arange(parts + 1)), np.searchsorted(p[run_at], np.arange(parts + 1))
            some = [k for k in range(parts) if cut[k] < cut[k + 1]]
            blank = pa.nulls(len(some), kind), *(pa.nulls(len(some), pa.int64()) for _ in range(4))
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), *blank, pa.array([cls[run_at[cut_runs[k]:cut_runs[k + 1]]].tobytes() for k in some], pa.binary()),
                 pa.array([runs[cut_runs[k]:cut_runs[k + 1]].tobytes() for k in some], pa.binary()),
                 pa.array([short[cut[k]:cut[k + 1]].tobytes() for k in some], pa.binary())], names)

        names = ["p", "id", "n", "cls", "slack0", "slack1", "classes", "runs", "keys"]
        for texts in slices(batches):
            kind = texts.ids("id").type
            sets = Sets(texts)
            bands = _bands(sets.size)
            size, cls = sets.size.copy(), sets.cls
            new = np.zeros(len(size), bool)
            for i, c in enumerate(cls.tolist()):
                if size[i] and c not in seen:
                    seen.add(c)
                    new[i] = True
            key, doc, role, slack = entries(sets, bands)
            first = new[doc]
            key, doc, role = key[first], doc[first], role[first]
            none = pa.nulls(len(size), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array((((cls >> U(32)) * U(parts)) >> U(32)).astype(np.int32)), texts.ids("id"), pa.array(size.astype(np.int64)), pa.array(cls.view(np.int64)),
                 pa.array(slack[0]), pa.array(slack[1]), none, none, none], names)
            if len(key):
                held.append((key, doc, role, cls))
                pending += len(key)
            if pending > FLUSH:
                yield flush()
                held, pending = [], 0
        if held:
            yield flush()

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"p int, id {kind}, n long, cls long, slack0 long, slack1 long, classes binary, runs binary, keys binary")


def _meet(index: DataFrame, kind: str) -> DataFrame:
    """Digests pass; entries of one part meet: pairs of up to HOT classes with the number of shared segments, and the members of
    more crowded segments. Two sets of one band meet as its lower members only; what they share in the family below is left out."""
    names = ["id", "n", "cls", "slack0", "slack1", "hot", "a", "b", "roles"]

    def meet(p: int, held: list) -> list[tuple]:
        cls = np.concatenate([np.frombuffer(x, U) for x, _, _ in held])
        runs = np.concatenate([np.frombuffer(x, np.uint32) for _, x, _ in held])
        raw = np.concatenate([np.frombuffer(x, np.uint8) for _, _, x in held]).reshape(-1, 5)
        key = np.zeros((len(raw), 8), np.uint8)
        key[:, :5] = raw
        key = key.view(U).reshape(-1)
        times = runs >> np.uint32(2)
        cls, role = np.repeat(cls, times), np.repeat((runs & np.uint32(3)).astype(np.int64), times)
        order = np.argsort(key, kind="stable")
        key, cls, role = key[order], cls[order], role[order]
        twin = np.zeros(len(key), bool)
        twin[1:] = key[1:] == key[:-1]
        twin[:-1] |= twin[1:]
        key, cls, role = key[twin], cls[twin], role[twin]
        order = np.lexsort((cls, key))
        key, cls, role = key[order], cls[order], role[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls, role = key[new], cls[new], role[new]
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        group = np.cumsum(head) - 1
        size = np.bincount(group, minlength=0)
        out = []
        few = size[group] <= HOT
        k2, c2, r2 = group[few], cls[few].view(np.int64), role[few]
        found = []
        for d in range(1, min(HOT, len(k2))):
            same = (k2[d:] == k2[:-d]) & ((r2[d:] & r2[:-d] & 1) == 0)
            x, y, rx, ry = c2[:-d][same], c2[d:][same], r2[:-d][same], r2[d:][same]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y), np.where(x < y, rx << 2 | ry, ry << 2 | rx)], 1))
        if found:
            pair, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
            out += [(False, pair[i:i + 50_000, 0], pair[i:i + 50_000, 1], n[i:i + 50_000] << 4 | pair[i:i + 50_000, 2]) for i in range(0, len(pair), 50_000)]
        lower = np.bincount(group, (role & 1) == 0, len(size)) > 0
        many = ~few & lower[group] if len(group) else few
        c3, r3, k3 = cls[many].view(np.int64), role[many], (key[many] | (U(p) << U(40))).view(np.int64)
        out += [(True, k3[i:i + 50_000], c3[i:i + 50_000], r3[i:i + 50_000]) for i in range(0, len(c3), 50_000)]
        return out

    def batch(rows: list[tuple], kind) -> pa.RecordBatch:
        lists = [pa.array([r[0] for r in rows]), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (1, 2, 3))]
        return pa.RecordBatch.from_arrays([pa.nulls(len(rows), kind), *(pa.nulls(len(rows), pa.int64()) for _ in range(4)), *lists], names)

    def run(batches):
        now, held, id_type = None, [], None
        for b in batches:
            id_type = b.column("id").type
            digest = b.filter(b.column("classes").is_null())
            if digest.num_rows:
                none = pa.nulls(digest.num_rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(digest.column(c) for c in names[:5]), pa.nulls(digest.num_rows, pa.bool_()), none, none, none], names)
            packed = b.filter(b.column("classes").is_valid())
            for p, *blobs in zip(*(packed.column(c).to_pylist() for c in ("p", "classes", "runs", "keys")), strict=True):
                if p != now and held:
                    if rows := meet(now, held):
                        yield batch(rows, id_type)
                    held = []
                now = p
                held.append(blobs)
        if held and (rows := meet(now, held)):
            yield batch(rows, id_type)

    return index.mapInArrow(run, f"id {kind}, n long, cls long, slack0 long, slack1 long, hot boolean, a array<long>, b array<long>, roles array<long>")


def _sets(wanted: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(cls, set) of the classes wanted, and a few others that pass the filter; 48 bits of each member, in order."""
    flags = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap(wanted, "cls", FILTER_BITS)))

    def run(batches):
        bits, seen = np.unpackbits(flags.value).astype(bool), set()
        for texts in slices(batches):
            sets = Sets(texts)
            rows = []
            for i in np.flatnonzero(passes(bits, sets.cls) & (sets.size > 0)):
                c = int(sets.cls[i])
                if c not in seen:
                    seen.add(c)
                    v = sets.values[sets.at[i]:sets.at[i + 1]]
                    rows.append((c - (1 << 64) if c >> 63 else c, np.sort(v & U((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["cls", "set"])

    return keep(docs.select(F.col(text).alias("text")).mapInArrow(run, "cls long, set binary"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the class pairs (a, b) whose sets link. Members of a are compared with a's set, in rooms of about SALT_ROWS."""
    spark = pairs.sparkSession
    rooms = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("rooms"))
    homes = rooms.select(F.col("a").alias("cls"), F.col("a").alias("center"), F.explode(F.sequence(F.lit(0), F.col("rooms") - 1)).alias("room"), F.lit(0).alias("guest"))
    guests = pairs.join(rooms, "a").select(F.col("b").alias("cls"), F.col("a").alias("center"), F.pmod(F.xxhash64("b"), "rooms").cast("int").alias("room"), F.lit(1).alias("guest"))
    routes = homes.unionByName(guests)
    there = sets.join(routes, "cls").repartition(shuffle_parts(spark), "center", "room").sortWithinPartitions("center", "room", "guest")

    def widen(x: bytes) -> np.ndarray:
        out = np.zeros((len(x) // 6, 8), np.uint8)
        out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
        return out.view(U).reshape(-1)

    def compare(batches):
        at, mine = None, None
        for b in batches:
            hits = []
            for center, room, guest, cls, packed in zip(*(b.column(c).to_pylist() for c in ("center", "room", "guest", "cls", "set")), strict=True):
                if not guest:
                    at, mine = (center, room), widen(packed)
                elif at == (center, room):
                    other = widen(packed)
                    both = len(mine) + len(other)
                    if 7 * min(len(mine), len(other)) >= 3 * both and 7 * (both - len(np.union1d(mine, other))) >= 3 * both:
                        hits.append((center, cls))
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.int64()) for k in (0, 1)], ["a", "b"])

    return keep(there.select("center", "room", "guest", "cls", "set").mapInArrow(compare, "a long, b long").distinct())


def connected(edges: DataFrame) -> DataFrame:
    """(v, comp): smallest vertex of each vertex' component, by alternating large and small stars until only stars are left."""
    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1 and up > 0").isEmpty():
            return now.select(F.col("u").alias("v"), F.col("v").alias("comp")).unionByName(now.select("v", F.col("v").alias("comp")).distinct())
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = keep(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        now = keep(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def merged(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after more edges: only the components that they join are worked on."""
    links = keep(_by_component(edges, comp).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).where("a <> b").distinct())
    if links.isEmpty():
        return comp
    moved = connected(links)
    added = moved.join(comp.select("v"), "v", "left_anti")
    old = comp.join(moved.select(F.col("v").alias("comp"), F.col("comp").alias("to")), "comp", "left")
    return keep(old.select("v", F.coalesce("to", "comp").alias("comp")).unionByName(added))


def components(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id: the smallest id that links reach) of every row."""
    spark = docs.sparkSession
    parts = 4 * shuffle_parts(spark)
    kind = docs.schema[id].dataType.simpleString()
    dealt = _index(docs, id, text, parts).repartition(shuffle_parts(spark), "p").sortWithinPartitions("p")
    met = keep(_meet(dealt, kind))
    digest = met.where("cls is not null").select("id", "n", "cls", "slack0", "slack1")
    hot = met.where("hot").select(F.explode(F.arrays_zip("a", "b", "roles")).alias("p")).select(F.col("p.a").alias("bucket"), F.col("p.b").alias("cls"), F.col("p.roles").alias("role"))
    need = keep(_needed(hot, digest))
    small = keep(_candidates(met, need))
    full = _crowded(hot, need)
    centers = keep(full.groupBy("bucket").agg(F.min("cls").alias("center")))
    stars = full.join(centers, "bucket").where("cls <> center").select(F.col("center").alias("a"), F.col("cls").alias("b"))
    pairs = keep(small.unionByName(stars).distinct())
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(full.select("cls")), docs, text)
    tried = keep(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    comp = keep(connected(_verified(tried, sets)))
    more = _apart(pairs, comp).join(tried, ["a", "b"], "left_anti")
    comp, tried = _extend(more, tried, comp, sets)
    rare, hard = _finest(full, comp, sets)
    comp, tried = _extend(rare.join(tried, ["a", "b"], "left_anti"), tried, comp, sets)
    comp = _settle(full, hard, digest, tried, comp, sets)
    first = digest.groupBy("cls").agg(F.min("id").alias("first"))
    named = first.join(comp.withColumnRenamed("v", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_class = named.join(least, "comp").select("cls", "component_id")
    out = digest.join(of_class, "cls").select(F.col("id").alias(id), F.col("n").alias("n_shingles"),
                                              F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out


def _needed(hot: DataFrame, digest: DataFrame) -> DataFrame:
    """(cls, role, need): filled segments outside crowded ones, less H. A partner shares at least as many of them."""
    load = hot.where("role < 2").groupBy("cls", "role").agg(F.count(F.lit(1)).alias("n_hot"))
    slack = digest.where("n > 0").groupBy("cls").agg(F.max("slack0").alias("s0"), F.max("slack1").alias("s1"))
    by_role = slack.select("cls", F.explode(F.array(*[F.struct(F.lit(r).cast("long").alias("role"), F.col(f"s{r}").alias("s")) for r in (0, 1)])).alias("x"))
    return by_role.select("cls", "x.role", "x.s").join(load, ["cls", "role"], "left").select("cls", "role", (F.col("s") - F.coalesce("n_hot", F.lit(0))).alias("need"))


def _candidates(met: DataFrame, need: DataFrame) -> DataFrame:
    """Pairs that share as many segments as a link makes sure of, and those that met in wide segments."""
    one = met.where("not hot").select(F.explode(F.arrays_zip("a", "b", "roles")).alias("p")).select(
        "p.a", "p.b", F.shiftright("p.roles", 4).alias("n"), F.shiftright("p.roles", 2).bitwiseAND(F.lit(3)).alias("ra"), F.col("p.roles").bitwiseAND(F.lit(3)).alias("rb"))
    met_by = one.groupBy("a", "b").agg(F.max(F.greatest("ra", "rb") >= 2).alias("wide"), F.sum(F.when(F.greatest("ra", "rb") < 2, F.col("n")).otherwise(0)).alias("n"),
                                       F.max(F.when(F.greatest("ra", "rb") < 2, F.col("ra"))).alias("ra"), F.max(F.when(F.greatest("ra", "rb") < 2, F.col("rb"))).alias("rb"))
    of = lambda c: need.select(F.col("cls").alias(c), F.col("role").alias(f"r{c}"), F.col("need").alias(f"need_{c}"))
    known = met_by.join(of("a"), ["a", "ra"], "left").join(of("b"), ["b", "rb"], "left")
    return known.where(F.col("wide") | (F.col("n") >= F.greatest("need_a", "need_b"))).select("a", "b")


def _crowded(hot: DataFrame, need: DataFrame) -> DataFrame:
    """Members of crowded segments that can't do without them, because nothing is needed outside."""
    short = need.where("need <= 0").select("cls", "role")
    wide = hot.where("role > 1").select("cls", "role").distinct()
    return keep(hot.join(keep(short.unionByName(wide)), ["cls", "role"]).select("bucket", "cls").distinct())


def _by_component(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs with the components of both; a class that has no link yet is its own."""
    of = lambda c: comp.select(F.col("v").alias(c), F.col("comp").alias(f"of_{c}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("of_a", "a").alias("comp_a"), F.coalesce("of_b", "b").alias("comp_b"))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose classes lie in different components."""
    return _by_component(pairs, comp).where("comp_a <> comp_b").select("a", "b")


def _extend(more: DataFrame, tried: DataFrame, comp: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components and tried pairs after more pairs are verified; only sets of these pairs are exchanged."""
    more = keep(more)
    if more.isEmpty():
        return comp, tried
    flags = sets.sparkSession.sparkContext.broadcast(np.packbits(bitmap(more.select(F.explode(F.array("a", "b")).alias("cls")), "cls", FILTER_BITS)))

    def wanted(batches):
        bits = np.unpackbits(flags.value).astype(bool)
        for b in batches:
            yield b.filter(pa.array(passes(bits, b.column("cls").to_numpy())))

    found = _verified(more, sets.mapInArrow(wanted, sets.schema))
    return merged(comp, found), tried.unionByName(more)


def _finest(full: DataFrame, comp: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of crowded segments by single shingles: pairs (a, b) of which the smaller set shares one of its rarest shingles
    with the larger, in another component, and the classes (cls) whose shingles are too common for that."""

    def spread(batches):
        for b in batches:
            held = b.column("set")
            size = np.array([len(x) // 6 for x in held.to_pylist()], np.int64)
            packed = np.frombuffer(b"".join(held.to_pylist()), np.uint8).reshape(-1, 6)
            value = np.zeros((len(packed), 8), np.uint8)
            value[:, :6] = packed
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("cls").to_numpy(), size)), pa.array(np.repeat(size, size)),
                                              pa.array(value.view(np.int64).reshape(-1))], ["cls", "n", "value"])

    members = sets.join(full.select("cls").distinct(), "cls", "left_semi").select("cls", "set")
    shingle = keep(members.mapInArrow(spread, "cls long, n long, value long"))
    holders = shingle.groupBy("value").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") <= RARE)
    rank = F.row_number().over(W.partitionBy("cls").orderBy("holders", "value"))
    rare = keep(shingle.join(holders, "value").withColumn("rank", rank))
    spare = F.col("n") - F.floor(F.col("n") / 7)  # shingles that a larger partner has for sure
    enough = rare.where(F.col("rank") > F.col("n") - spare).select("cls").distinct()
    hard = keep(shingle.select("cls").distinct().join(enough, "cls", "left_anti"))
    named = rare.where("holders > 1").join(comp.withColumnRenamed("v", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = named.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("value")
    shared = keep(named.join(mixed, "value"))
    probe = shared.where(F.col("rank") <= F.col("n") - spare + 1).join(hard, "cls", "left_anti").select("value", F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"))
    pairs = probe.join(shared.select("value", "cls", "n", "comp"), "value").where("comp <> cx and n >= nx and 3 * n <= 4 * nx")
    return keep(pairs.select(F.least("x", "cls").alias("a"), F.greatest("x", "cls").alias("b")).distinct()), hard


def _settle(full: DataFrame, hard: DataFrame, digest: DataFrame, tried: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame:
    """Crowded segments whose members are not of one component: each hard member in turn, in doubling numbers, meets those that
    are as large or up to a third larger."""
    sizes = digest.where("n > 0").select("cls", "n").distinct().join(hard.withColumn("hard", F.lit(True)), "cls", "left")
    sized = keep(full.join(sizes, "cls").select("bucket", "cls", "n", F.coalesce("hard", F.lit(False)).alias("hard")))
    low = 0
    while True:
        named = sized.join(comp.withColumnRenamed("v", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        mixed = named.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.sum(F.col("hard").cast("int")).alias("turns")).where(f"x <> y and turns > {low}")
        open_ = keep(named.join(mixed.select("bucket"), "bucket"))
        if open_.isEmpty():
            return comp
        ranked = open_.where("hard").withColumn("rank", F.row_number().over(W.partitionBy("bucket").orderBy("cls")) - 1)
        turn = ranked.where(F.col("rank").between(low, 2 * low)).select("bucket", F.col("cls").alias("c"), F.col("n").alias("nc"), F.col("comp").alias("cc"))
        met = open_.join(turn, "bucket").where("comp <> cc and n >= nc and 3 * n <= 4 * nc").select(F.least("cls", "c").alias("a"), F.greatest("cls", "c").alias("b")).distinct()
        comp, tried = _extend(met.join(tried, ["a", "b"], "left_anti"), tried, comp, sets)
        low = 2 * low + 1


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: the row with the smallest id, and one of rows that repeat it. Empty sets all stay."""
    mark = fresh(docs, "_copy")
    groups = keep(components(docs, id, text))
    chosen = groups.where((F.col("n_shingles") > 0) & ~F.col(id).eqNullSafe(F.col("component_id"))).select(F.col(id).alias(mark)).distinct()
    left = docs.join(chosen, docs[id].eqNullSafe(F.col(mark)), "left_anti")
    repeated = groups.where("n_shingles > 0").groupBy(id).count().where("count > 1")
    return left if repeated.isEmpty() else left.dropDuplicates([id, text])

"""N-gram Jaccard join in the metric space of shingle sets.

Two documents link where their sets of 5-word shingles have a Jaccard similarity of 0.8 or
more, that is a distance of r = 0.2 or less; linked documents form components. Documents with
equal sets are one class and take part once. Hashes of shingles have 64 bits and give every
set a fixed order.

1. A class can only link if enough of its shingles occur in another class. Blocks of
   documents report the first three tenths of each set; classes that share too few of these
   are done with. Between blocks a shingle has one row per block, however many documents
   have it.
2. Shingles of the classes left are counted and ordered by the number of classes that have
   them, then by hash. Two linked sets share a shingle in the first n - ceil(0.8 n) + 1 of each
   in that order, where those that no other class has come first and choose nothing; classes
   with enough of them are done with. For each shingle chosen the class with the least document
   id is the pivot; a pivot's region holds all classes that chose it by some shingle, so a class
   near a border is in several regions and each linked pair is together in one. Rare shingles
   make few and small regions, and a region's sets are all that travels.
3. A region is joined exactly: distances to some pivots are kept, and by the triangle
   inequality x and y are compared only if their distances to each pivot differ by r or less
   (and their sizes allow a link, and no chain of links joins them yet).
4. A region that is too large for one task is dealt into chunks. Members within r of a pivot,
   or of a pivot linked to it, are one component; the others are compared with the members of
   every chunk, a pair of chunks in each task.
5. Components come from rounds of large and small stars over the links.

Null texts and texts without words have no shingles, link with nothing and are their own
component; fewer than five words make one shingle. A null id is never the least. An empty
table gives an empty table. Nothing is dropped, and no partner or candidate is capped.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store
from . import words as W

SHINGLE, PER_CENT = 5, 80
BLOCK_BYTES = 8 << 20
#: Share of a set, in the order of hashes, that is looked at to find classes without partners.
REPORTED = 0.3
#: Shingles of a region that one task joins; larger regions are dealt into chunks of half as many.
REGION_SHINGLES = 2_000_000
PIVOTS = 8


def least_shared(n):
    """Shingles that a set of n shares at least with any set it links with."""
    return (n * PER_CENT + 99) // 100


def sets(w: W.Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    g, _ = w.grams(SHINGLE)
    first, count = w.first.tolist(), w.count.tolist()
    out = []
    for r, n in enumerate(count):
        if n >= SHINGLE:
            out.append(np.unique(g[first[r] : first[r] + n - SHINGLE + 1]))
        elif n:
            h = w.hash[first[r] : first[r] + n]
            out.append(W.mix(np.array([(h * W._STEP[:n]).sum() + np.uint64(n)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _class(s: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))).astype(np.int64))


def reported(n):
    """Shingles that a set of n reports; works on arrays as well."""
    return np.minimum(n, np.maximum(n - least_shared(n) + 1, np.ceil(REPORTED * n).astype(np.int64)))


@lru_cache(1 << 16)
def least_met(n: int) -> int:
    """Reported shingles of a set of n that any set it links with surely reports, too.

    Of s shared shingles, in the order of hashes, the first k(n) - (n - s) at least are in
    the n's report and the first k(m) - (m - s) in the partner's; the lesser of both is in
    both. The least over all sizes m that may link counts.
    """
    m = np.arange(least_shared(n), n * 100 // PER_CENT + 1)
    s = -(-PER_CENT * (n + m) // (100 + PER_CENT))
    m, s = m[s <= np.minimum(n, m)], s[s <= np.minimum(n, m)]
    return int(np.minimum(reported(n) - (n - s), reported(m) - (m - s)).min())


def _block_sets(t: pa.Table):
    for batch in t.select(["_id", "_text"]).combine_chunks().to_batches():
        for part in W.slices(batch, "_text"):
            yield part.column(0).to_pylist(), sets(W.words(part.column(1), fold=True))


def _flat(tokens: pa.Array) -> np.ndarray:
    return (tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens).flatten().to_numpy()


def _lists(by: np.ndarray, *values: np.ndarray | pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """The distinct numbers in ``by``, which is sorted, and for each the list of every column's values."""
    name, first = np.unique(by, return_index=True)
    off = pa.array(np.append(first, len(by)), pa.int32())
    return name, [pa.ListArray.from_arrays(off, v if isinstance(v, pa.Array) else pa.array(v)) for v in values]


def report(t: pa.Table, slots: int) -> pa.Table:
    """Distinct reported shingles of a block with the class that has each; null: several have it.

    A row has the shingles of one slot: as single rows they would take a third more disk.
    """
    token, cls, seen = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], set()
    for _, all_sets in _block_sets(t):
        for s in all_sets:
            if len(s) and (c := _class(s)) not in seen:
                seen.add(c)
                k = reported(len(s))
                token.append(s[:k])
                cls.append(np.full(k, c, dtype=np.int64))
    token, cls = np.concatenate(token), np.concatenate(cls)
    order = np.lexsort((cls, token))
    token, cls = token[order], cls[order]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(token)) - 1
    slot = (token[first] % np.uint64(slots)).astype(np.int32)
    by = np.argsort(slot, kind="stable")
    first, last = first[by], last[by]
    name, (token, c) = _lists(slot[by], token[first].view(np.int64), pa.array(cls[first], mask=cls[first] != cls[last]))
    block = t.column("_block")[0].as_py()
    return pa.table({"slot": name, "_block": pa.array(np.full(len(name), block), pa.int32()), "token": token, "c": c})


def shared_by_classes(t: pa.Table) -> pa.Table:
    """Of the shingles of a slot those that several classes have, for each block that reports them."""
    c = t.column("c").combine_chunks().flatten()
    token, several, c = _flat(t.column("token")), np.asarray(c.is_null()), c.fill_null(0).to_numpy()
    block = np.repeat(t.column("_block").to_numpy(), pa.compute.list_value_length(t.column("token")).to_numpy())
    by = np.argsort(token, kind="stable")
    token, several, c, block = token[by], several[by], c[by], block[by]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    met = np.logical_or.reduceat(several, first) | (np.minimum.reduceat(c, first) < np.maximum.reduceat(c, first))
    met = np.repeat(met, np.diff(np.append(first, len(token))))
    token, block = token[met], block[met]
    by = np.argsort(block, kind="stable")
    name, (token,) = _lists(block[by], token[by])
    return pa.table({"_block": name, "token": token})


def classify(t: pa.Table, shared: pa.Table) -> pa.Table:
    """Every row's set size and class; the first row of a class that may link has the set as well."""
    want = np.unique(_flat(shared.column("token")).view(np.uint64))
    ids, size, cls, tokens, seen = [], [], [], [], set()
    for own, all_sets in _block_sets(t):
        for i, s in zip(own, all_sets, strict=True):
            n, c = len(s), _class(s) if len(s) else None
            ids.append(i)
            size.append(n)
            cls.append(c)
            kept = None
            if n and c not in seen:
                seen.add(c)
                k = reported(n)
                at = np.minimum(np.searchsorted(want, s[:k]), max(len(want) - 1, 0))
                if len(want) and np.count_nonzero(want[at] == s[:k]) >= least_met(n):
                    kept = s.view(np.int64)
            tokens.append(kept)
    return pa.table({"_id": pa.array(ids, pa.int64()), "n": pa.array(size, pa.int64()), "c": pa.array(cls, pa.int64()), "tokens": pa.array(tokens, pa.list_(pa.int64()))})


def tally(t: pa.Table) -> pa.Table:
    """Distinct shingles of a block of classes and how many of its classes have each."""
    token, k = np.unique(_flat(t.column("tokens")), return_counts=True)
    return pa.table({"token": token, "_block": pa.array(np.full(len(token), t.column("_block")[0].as_py()), pa.int32()), "k": k})


def rarest(t: pa.Table, met: pa.Table) -> pa.Table:
    """Shingles by which the classes of a block choose pivots: the rarest of those in ``met``.

    ``met`` has all shingles of the block that several classes have, with their number.
    """
    tokens = t.column("tokens")
    flat, size = _flat(tokens), pa.compute.list_value_length(tokens).to_numpy().astype(np.int64)
    want, many = met.column("token").to_numpy(), met.column("many").to_numpy()
    by = np.argsort(want)
    at = np.minimum(np.searchsorted(want, flat, sorter=by), max(len(want) - 1, 0))
    own = np.repeat(np.arange(len(size)), size)
    some = want[by[at]] == flat if len(want) else np.zeros(len(flat), dtype=bool)
    flat, own, many = flat[some], own[some], many[by[at[some]]] if len(want) else flat[:0]
    order = np.lexsort((flat, many, own))
    left = np.bincount(own, minlength=len(size))
    place = np.arange(len(own)) - np.repeat(np.cumsum(left) - left, left)
    first = order[place < (size - least_shared(size) + 1 - (size - left))[own[order]]]
    return pa.table({"c": t.column("c").take(own[first]), "lo": t.column("lo").take(own[first]), "token": flat[first]})


class Region:
    """Sets of some classes with an index from shingle to members."""

    def __init__(self, tokens: pa.Array):
        flat = _flat(tokens).view(np.uint64)
        self.size = np.asarray(pa.compute.list_value_length(tokens)).astype(np.int64)
        self.bounds = np.append(0, np.cumsum(self.size))
        self.flat = flat
        order = np.argsort(flat, kind="stable")
        self.sorted, self.owner = flat[order], np.repeat(np.arange(len(self.size)), self.size)[order]

    def shared(self, x: int) -> np.ndarray:
        """Shingles that member x shares with each member."""
        own = self.flat[self.bounds[x] : self.bounds[x + 1]]
        lo, hi = np.searchsorted(self.sorted, own, "left"), np.searchsorted(self.sorted, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.size))

    def against(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """(linked with x, distance from x) of each member."""
        s = self.shared(x)
        union = self.size[x] + self.size - s
        return 100 * s >= PER_CENT * union, 1.0 - s / union


class Chains:
    """Components of members by links found so far."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, x: int, linked: np.ndarray) -> None:
        names = np.unique(self.of[linked])
        if len(names) > 1:
            self.of[np.isin(self.of, names)] = names[0]


def compare(region: Region, chains: Chains, queries: np.ndarray, first: np.ndarray) -> None:
    """Link each query with all members; ``first`` (pivots) go first and lend their distances.

    A query is passed over for members that a pivot's window, their sizes or an existing
    chain of links settle; if none is left, it isn't compared at all.
    """
    radius = 1.0 - PER_CENT / 100 + 1e-9
    rulers: list[np.ndarray] = []
    done = np.zeros(len(region.size), dtype=bool)
    for x in np.concatenate([first, np.setdiff1d(queries, first)]).tolist():
        open_ = (chains.of != chains.of[x]) & ~done
        open_ &= (100 * region.size >= PER_CENT * region.size[x]) & (100 * region.size[x] >= PER_CENT * region.size)
        for d in rulers:
            open_ &= np.abs(d - d[x]) <= radius
        open_[x] = False
        lends = len(rulers) < len(first)
        if lends or open_.any():
            linked, d = region.against(x)
            chains.link(x, np.flatnonzero(linked & (open_ | (np.arange(len(linked)) == x) | lends)))
            if lends:
                rulers.append(d)
        done[x] = True


def pivots_of(region: Region, n: int) -> np.ndarray:
    """Members that lie in the thick of the region: those whose shingles have most owners; member 0 first."""
    if len(region.size) <= 2:
        return np.arange(min(1, len(region.size)))
    starts = np.flatnonzero(np.append(True, region.sorted[1:] != region.sorted[:-1]))
    many = np.repeat(np.diff(np.append(starts, len(region.sorted))), np.diff(np.append(starts, len(region.sorted))))
    thick = np.bincount(region.owner, weights=many, minlength=len(region.size)) / np.maximum(region.size, 1)
    best = np.argsort(-thick, kind="stable")[:n]
    return np.append(0, best[best != 0])[:n]


def join_region(t: pa.Table) -> pa.Table:
    """(class, least class of its component in the region) of the members that link."""
    t = t.sort_by([("lo", "ascending"), ("c", "ascending")])
    region, c = Region(t.column("tokens")), t.column("c").to_numpy()
    chains = Chains(len(c))
    compare(region, chains, np.arange(len(c)), pivots_of(region, min(PIVOTS, 1 + len(c) // 4)))
    return _edges(c, chains)


def _edges(c: np.ndarray, chains: Chains) -> pa.Table:
    root = c[chains.of]
    some = root != c
    return pa.table({"u": c[some], "v": root[some]})


def split_region(t: pa.Table) -> pa.Table:
    """For a chunk of a large region: the pivots' component, and who is not in it.

    Rows with ``lead`` are the region's pivots, sent to every chunk; the first is the centre.
    """
    t = t.sort_by([("lead", "descending"), ("lo", "ascending"), ("c", "ascending")])
    region, c, lead = Region(t.column("tokens")), t.column("c").to_numpy(), np.count_nonzero(t.column("lead").to_numpy(zero_copy_only=False))
    linked = [region.against(x)[0] for x in range(lead)]
    main, grown = {0}, True
    while grown:
        more = {y for x in main for y in range(lead) if linked[x][y]} - main
        main, grown = main | more, bool(more)
    inner = np.any([linked[x] for x in main], axis=0)
    rows = np.arange(lead, len(c))
    return pa.table({"p": t.column("p").take(rows), "c": c[rows], "inner": inner[rows], "centre": np.full(len(rows), c[0])})


def join_chunks(t: pa.Table) -> pa.Table:
    """Links between the members left out (``outer``) of one chunk and all members of another."""
    t = t.sort_by([("outer", "descending"), ("lo", "ascending"), ("c", "ascending")])
    region, c = Region(t.column("tokens")), t.column("c").to_numpy()
    queries = np.flatnonzero(t.column("outer").to_numpy(zero_copy_only=False))
    chains = Chains(len(c))
    compare(region, chains, queries, queries[: min(PIVOTS, 1 + len(queries) // 4)])
    return _edges(c, chains)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v): each linked class but the least of its component, and that least class."""
    spark = edges.sparkSession
    edges = store.settle(edges.select("u", "v").filter("u <> v").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        for small in (False, True):
            if small:
                pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            else:
                pairs = edges.union(edges.select("v", "u"))
            least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            met = pairs.join(least, "u")
            if small:
                new = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
            else:
                new = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = store.settle(new.filter("u <> v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now
    raise RuntimeError("components did not settle")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """_id, n, c (class) of every row, and the set (tokens) where the class may link; kept as a table."""
    slim = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    size = slim.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = max(64, -(-size // block_bytes))
    dealt = slim.withColumn("_block", F.pmod(F.xxhash64("_id", F.when(F.col("_id").isNull(), F.col("_text"))), F.lit(n)).cast("int"))
    seen = dealt.groupBy("_block").applyInArrow(lambda t: report(t, n), "slot int, _block int, token array<long>, c array<long>")
    shared = seen.groupBy("slot").applyInArrow(shared_by_classes, "_block int, token array<long>")
    out = dealt.groupBy("_block").cogroup(shared.groupBy("_block")).applyInArrow(lambda a, b: classify(a, b), "_id long, n long, c long, tokens array<long>")
    return store.settle(out, "classes")


def regions(v: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(p, c): every class of v in the region of each pivot that its rarest shared shingles have."""
    size = 8 * (v.agg(F.sum("n")).first()[0] or 0)
    dealt = v.select("c", "lo", "tokens", F.pmod(F.xxhash64("c"), F.lit(max(64, -(-size // block_bytes)))).cast("int").alias("_block"))
    seen = dealt.groupBy("_block").applyInArrow(tally, "token long, _block int, k long")
    met = seen.withColumn("many", F.sum("k").over(Window.partitionBy("token"))).filter("many > 1").select("_block", "token", "many")
    chosen = dealt.groupBy("_block").cogroup(met.groupBy("_block")).applyInArrow(lambda a, b: rarest(a, b), "c long, lo long, token long")
    chosen = store.settle(chosen, "chosen")
    pivot = chosen.groupBy("token").agg(F.min(F.struct(F.col("lo").isNull().alias("none"), "lo", "c")).alias("p"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("token", F.col("p.c").alias("p"))
    return chosen.select("token", "c").join(pivot, "token").select("p", "c").distinct()


def link(v: DataFrame, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """Links (u, v) that join the classes of v into their components."""
    member = store.settle(regions(v).join(v.select("c", "lo", "n"), "c"), "regions")
    weight = member.groupBy("p").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    sized = member.join(weight, "p").withColumn("chunks", F.ceil(F.col("weight") * 2 / region_shingles).cast("int"))
    held = v.select("c", "tokens")
    small = sized.filter(F.col("weight") <= region_shingles).select("p", "c", "lo").join(held, "c")
    edges = small.groupBy("p").applyInArrow(join_region, "u long, v long")
    large = sized.filter(F.col("weight") > region_shingles).withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int")).select("p", "c", "lo", "n", "chunks", "chunk")
    large = store.settle(large, "large-regions")
    if large.isEmpty():
        return edges
    rank = Window.partitionBy("p").orderBy(F.col("c") != F.col("p"), F.col("lo").asc_nulls_last(), "c")  # a limit on the rank is applied before the exchange
    leads = large.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= PIVOTS)
    leads = leads.select("p", "c", "lo", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("lead"))
    rows = large.select("p", "c", "lo", "chunk", F.lit(False).alias("lead")).union(leads.select("p", "c", "lo", "chunk", "lead")).join(held, "c")
    told = store.settle(rows.groupBy("p", "chunk").applyInArrow(split_region, "p long, c long, inner boolean, centre long"), "centres")
    inner = told.filter("inner and c <> centre").select(F.col("c").alias("u"), F.col("centre").alias("v"))
    outer = told.filter("not inner").select("p", "c")
    n_outer = outer.join(large.select("p", "c", "n"), ["p", "c"]).groupBy("p").agg(F.ceil(F.sum("n") * 2 / region_shingles).cast("int").alias("outs"))
    marked = large.join(n_outer, "p").join(outer.withColumn("is_outer", F.lit(True)), ["p", "c"], "left")
    mine = F.pmod(F.xxhash64("c", F.lit("outer")), F.col("outs")).cast("int")
    as_member = marked.select("p", "c", "lo", "chunk", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("out"), F.lit(False).alias("outer"))
    as_query = marked.filter("is_outer").select("p", "c", "lo", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), mine.alias("out"), F.lit(True).alias("outer"))
    both = as_member.union(as_query.select("p", "c", "lo", "chunk", "out", "outer")).groupBy("p", "chunk", "out", "c", "lo").agg(F.max("outer").alias("outer"))
    crossed = both.join(held, "c").groupBy("p", "chunk", "out").applyInArrow(join_chunks, "u long, v long")
    return edges.union(inner).union(crossed)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """key, n_shingles, component_id (least id reachable by links) of every row."""
    d = classes(docs, key, text, block_bytes)
    least = d.filter("c is not null").groupBy("c").agg(F.min("_id").alias("lo"))
    v = d.filter("tokens is not null").select("c", "n", "tokens").dropDuplicates(["c"]).join(least, "c")
    v = store.settle(v, "candidates")
    tied = components(link(v, region_shingles))
    stars = tied.union(tied.select("v", "v").distinct()).toDF("c", "root").join(least, "c")
    lowest = stars.groupBy("root").agg(F.min("lo").alias("low"))
    named = stars.join(lowest, "root").select("c", "low")
    known = least.join(named, "c", "left").select("c", F.coalesce("low", "lo").alias("component"))
    return d.select("_id", "n", "c").join(known, "c", "left").select(
        F.col("_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "_id").alias("component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the least id stays, once.

    Documents without words stay; rows without an id stay.
    """
    found = near_duplicates(docs.select("doc_id", "text"))
    gone = found.filter((F.col("component_id") != F.col("doc_id")) & (F.col("n_shingles") > 0)).select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti").select(*store.own(docs))
    return left.filter("doc_id is not null").dropDuplicates(["doc_id"]).union(left.filter("doc_id is null"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
with recursive d as (select doc_id, list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x) as ws from documents),
s as (select distinct doc_id, md5(array_to_string(g, ' ')) as g from (
  select doc_id, list_slice(ws, p, p + 4) as g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as p from d where len(ws) >= 5)
  union all select doc_id, ws from d where len(ws) between 1 and 4)),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from i join n na on na.doc_id = x join n nb on nb.doc_id = y where 100 * k >= 80 * (na.n + nb.n - k)),
r(x, y) as (select doc_id, doc_id from d union select r.x, l.y from r join l on r.y = l.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id from d left join n using (doc_id) join (select x as doc_id, min(y) as component_id from r group by x) m using (doc_id)
"""

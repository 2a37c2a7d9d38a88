"""Operator 10: n-gram Jaccard join by grouped prefixes.

A document is its set of distinct word shingles. Two link when their Jaccard similarity
reaches a percentage. The query's contract is shingles of ``SHINGLE`` words and ``PERCENT``;
the stage of the pipeline takes ``STAGE_SHINGLE`` and ``STAGE_PERCENT``. The plan:

1. Equal sets form a class at once; only one text of a class goes on.
2. Shingles are ordered by (document frequency, hash). Frequencies are exact, counted
   block by block (see ``counts``). A set of which too few shingles occur elsewhere can
   have no partner and drops out; the others keep their prefix, the rarest shingles of
   which any partner must share one.
3. Sets with the same size and prefix collapse into a group. Groups that share a prefix
   shingle are connected into clusters, by ids only.
4. The sets of a cluster meet in one task. It joins groups by their prefix shingles, filters
   the pairs of groups by size and by what the places of the first shared shingle leave
   possible, expands those that pass and verifies their members exactly, skipping pairs
   that are connected already. A cluster over ``TASK_ITEMS`` is cut by size bands and hash
   into blocks; a piece of a group goes to the tasks of those pairs of blocks in which it
   has a prefix shingle in common with the other side. So no task is unbounded, blocks
   that share nothing never meet, and no pair is lost.
5. Links of the tasks are joined to components.

The result is a component for each document; pairs inside a class or a component are
never all written out.

Cases: null or empty text has an empty set and links with nothing; texts under
one shingle's width are one shingle; rows that share a doc_id are vertices of one
document, so its component joins theirs, and the stage keeps one of them; a null doc_id gets
a null component, joins nothing and stays; an empty table gives no rows; other columns, of
any name, are ignored or, in the stage, carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import counts as C
from tracelake.llm import kernels as K
from tracelake.llm.components import connected
from tracelake.llm.store import cut, table

SHINGLE = 3
PERCENT = 90
STAGE_SHINGLE = 5
STAGE_PERCENT = 80
TASK_ITEMS = 3_000_000
_U = np.uint64


class Sets:
    """Distinct shingles of texts: ``items`` sorted inside ``bounds``, and two keys of each set."""

    def __init__(self, b: np.ndarray, o: np.ndarray, width: int):
        s, e, doc = K.words(b, o, K.SPACED)
        n = len(o) - 1
        h = K.slice_hash(K.prefix(b, K.LOWER_CODES), s, e)
        at, sh = K.window_hash(h, doc, width)
        sd = doc[at]
        words = np.bincount(doc, minlength=n)
        few = np.flatnonzero((words > 0) & (words < width))
        if len(few):
            first = np.searchsorted(doc, few)
            whole = np.array([int(K.window_hash(h[i : i + words[d]], doc[i : i + words[d]], words[d])[1][0]) for i, d in zip(first, few, strict=True)], dtype=_U)
            sh, sd = np.concatenate([sh, K.mix(whole + _U(1))]), np.concatenate([sd, few])
        order = np.lexsort((sh, sd))
        sh, sd = sh[order], sd[order]
        new = np.append(True, (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])) if len(sh) else np.zeros(0, bool)
        self.items, own = sh[new], sd[new]
        self.bounds = np.searchsorted(own, np.arange(n + 1))
        self.size = np.diff(self.bounds)
        self.key1 = _sum(K.mix(self.items), self.bounds)
        self.key2 = _sum(K.mix(self.items ^ _U(0xC2B2AE3D27D4EB4F)), self.bounds)


def _sum(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.append(_U(0), np.cumsum(x, dtype=_U))
    return K.mix(c[bounds[1:]] - c[bounds[:-1]]).view(np.int64)


def _least(n, percent: int):
    """Shingles that a set of ``n`` must share with any partner."""
    return (percent * n + 99) // 100


def members(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, key1, key2) of each row."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("t"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                buf, off = K.texts(batch.column(1))
                sets = [Sets(b, o, width) for _, _, b, o in K.chunks(buf, off)]
                cat = [np.concatenate([getattr(x, a) for x in sets]) for a in ("size", "key1", "key2")]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cat)], names=["doc_id", "n_shingles", "key1", "key2"])

    return src.mapInArrow(run, T.StructType([src.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_shingles", "key1", "key2")]]))


def _pack(docs: DataFrame, n_blocks: int, width: int) -> DataFrame:
    """(block, keys, lens, texts): one text of each set of a batch, dealt by the set's key."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            buf, off = K.texts(batch.column(0))
            sets = [Sets(b, o, width) for _, _, b, o in K.chunks(buf, off)]
            key, size = (np.concatenate([getattr(x, a) for x in sets]) for a in ("key1", "size"))
            rows = np.unique(np.where(size > 0, key, 0), return_index=True)[1]
            rows = rows[size[rows] > 0]
            if not len(rows):
                continue
            block = (key[rows].view(_U) % _U(n_blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            rows, block = rows[order], block[order]
            head = np.flatnonzero(np.diff(block, prepend=-1))
            out = []
            for a, z in zip(head, np.append(head[1:], len(rows)), strict=True):
                own = rows[a:z]
                text = b"".join(buf[off[i] : off[i + 1]].tobytes() for i in own)
                out.append((int(block[a]), key[own].tobytes(), (off[own + 1] - off[own]).tobytes(), press.compress(text)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "keys", "lens", "texts"])

    return docs.select(F.col("text").cast("string").alias("t")).mapInArrow(run, "block long, keys binary, lens binary, texts binary")


def _block_sets(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, bounds, items) of the distinct sets of a block, by key."""
    seen: dict[int, np.ndarray] = {}
    for r in rows.select(["keys", "lens", "texts"]).to_pylist():
        keys = np.frombuffer(r["keys"], np.int64)
        buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["texts"]), np.uint8)
        off = np.append(0, np.cumsum(np.frombuffer(r["lens"], np.int64)))
        for i, _, b, o in K.chunks(buf, off):
            s = Sets(b, o, width)
            for k in range(len(o) - 1):
                seen.setdefault(int(keys[i + k]), s.items[s.bounds[k] : s.bounds[k + 1]])
    keys = sorted(seen)
    bounds = np.append(0, np.cumsum([len(seen[k]) for k in keys])).astype(np.int64)
    return np.array(keys, dtype=np.int64), bounds, np.concatenate([seen[k] for k in keys]) if keys else np.empty(0, _U)


def candidates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(sid, n, grp, tokens array<long>, places array<int>, items binary) of the sets that can have a
    partner: tokens are the prefix shingles that occur elsewhere, places where they stand in the prefix."""
    _, size = C.sizes(docs)
    n_blocks, n_buckets = max(1, -(-size // C.BLOCK_BYTES)), max(1, -(-size // (6 * C.BUCKET_ITEMS)))
    packed = _pack(docs, n_blocks, width)

    def request(key, t):
        _, _, items = _block_sets(t, width)
        u, n = np.unique(items, return_counts=True)
        return C.ask(key[0].as_py(), 0, u, n, n_buckets)

    told = cut(C.answers(packed.groupBy("block").applyInArrow(request, C._ASK), lambda cls: [1.0], lambda cls, sums: [sums[0]], lambda u, sums: []), "df").filter("block >= 0")

    def pick(key, t, got):
        sid, bounds, items = _block_sets(t, width)
        u, back = np.unique(items, return_inverse=True)
        df = C.ordered(got)[0][back] if len(u) else np.empty(0, np.int64)
        n = np.diff(bounds)
        shared = np.add.reduceat(df > 1, bounds[:-1]) if len(n) else n
        rows = []
        for i in np.flatnonzero(shared >= _least(n, percent)):
            own, f = items[bounds[i] : bounds[i + 1]], df[bounds[i] : bounds[i + 1]]
            order = np.lexsort((own, f))[: n[i] - _least(n[i], percent) + 1]
            head = own[order]
            grp = int(_sum(K.mix(head + _U(n[i])), np.array([0, len(head)]))[0])
            spots = np.flatnonzero(f[order] > 1)
            rows.append((int(sid[i]), int(n[i]), grp, head[spots].view(np.int64), spots.astype(np.int32), own.tobytes()))
        return pa.table({"sid": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "grp": pa.array([r[2] for r in rows], pa.int64()), "tokens": pa.array([r[3] for r in rows], pa.list_(pa.int64())), "places": pa.array([r[4] for r in rows], pa.list_(pa.int32())), "items": pa.array([r[5] for r in rows], pa.binary())})

    rows = packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(pick, "sid long, n long, grp long, tokens array<long>, places array<int>, items binary")
    return cut(rows, "sets")


class _Prefixes:
    """Groups by prefix shingle, filled while groups are taken in order of size."""

    def __init__(self, tokens: list[np.ndarray], places: list[np.ndarray], n: np.ndarray, percent: int):
        self.bounds = np.append(0, np.cumsum([len(t) for t in tokens]))
        self.token = np.unique(np.concatenate(tokens), return_inverse=True)[1] if self.bounds[-1] else np.empty(0, np.int64)
        self.place, self.n, self.percent = places, n, percent
        self.groups: list[list[int]] = [[] for _ in range(int(self.token.max()) + 1 if len(self.token) else 0)]
        self.left: list[list[int]] = [[] for _ in self.groups]  # shingles of the group from that place on

    def partners(self, g: int) -> np.ndarray:
        """Groups taken before, in which a member may reach the percentage with one of ``g``; then takes ``g``."""
        own = self.token[self.bounds[g] : self.bounds[g + 1]]
        rest = self.n[g] - self.place[g]
        near = [np.array(self.groups[t], dtype=np.int64) for t in own]
        found = np.empty(0, np.int64)
        if sum(map(len, near)):
            other = np.concatenate(near)
            most = np.minimum(np.concatenate([np.array(self.left[t], dtype=np.int64) for t in own]), np.repeat(rest, [len(x) for x in near]))
            order = np.argsort(other, kind="stable")
            other, most = other[order], most[order]
            head = np.flatnonzero(np.append(True, other[1:] != other[:-1]))
            # the first shared shingle leaves the most: what stands before it is not shared
            other, most = other[head], np.maximum.reduceat(most, head)
            size = self.n[other]
            found = other[(size >= _least(self.n[g], self.percent)) & ((100 + self.percent) * most >= self.percent * (size + self.n[g]))]
        for t, r in zip(own.tolist(), rest.tolist(), strict=True):
            self.groups[t].append(g)
            self.left[t].append(r)
        return found


def verify(sid: np.ndarray, n: np.ndarray, grp: np.ndarray, tokens: list[np.ndarray], places: list[np.ndarray], items: list[np.ndarray], side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all pairs that reach ``percent`` (a spanning forest); ``side`` tells
    two blocks apart of which only pairs across are asked for."""
    order = np.lexsort((sid, grp, n))
    bounds = np.append(0, np.cumsum([len(items[i]) for i in order]))
    _, flat = np.unique(np.concatenate([items[i] for i in order]), return_inverse=True)
    size, own_grp = n[order], grp[order]
    first = np.flatnonzero(np.append(True, own_grp[1:] != own_grp[:-1]))
    ends = np.append(first[1:], len(order))
    joined = _Prefixes([tokens[order[i]] for i in first], [places[order[i]] for i in first], size[first], percent)
    flag = np.zeros(int(flat.max()) + 1 if len(flat) else 0, dtype=bool)
    comp = np.arange(len(order))
    sides = side[order] if side is not None else None
    made_a, made_b = [], []
    together: dict[int, list[int]] = {}
    for g, (a, z) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
        near = joined.partners(g)
        width = ends[near] - first[near]
        members = np.repeat(first[near] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        for x in range(a, z):
            near = np.concatenate([members, np.arange(a, x)])
            ok = comp[near] != comp[x]
            near = near[ok if sides is None else ok & (sides[near] != sides[x])]
            if not len(near):
                continue
            mine = flat[bounds[x] : bounds[x + 1]]
            flag[mine] = True
            for i in range(0, len(near), 2048):
                c = near[i : i + 2048]
                c = c[comp[c] != comp[x]]
                if not len(c):
                    continue
                k = size[c]
                heads = np.cumsum(k) - k
                got = np.add.reduceat(flag[flat[np.repeat(bounds[c] - heads, k) + np.arange(k.sum())]], heads)
                for y in c[100 * got >= percent * (k + size[x] - got)]:
                    if comp[y] != comp[x]:
                        made_a.append(x)
                        made_b.append(int(y))
                        u, v = comp[x], comp[y]
                        small, big = (u, v) if len(together.get(u, (u,))) < len(together.get(v, (v,))) else (v, u)
                        moved = together.pop(small, [small])
                        comp[moved] = big
                        together.setdefault(big, [big]).extend(moved)
            flag[mine] = False
    ids = sid[order]
    return ids[np.array(made_a, dtype=np.int64)], ids[np.array(made_b, dtype=np.int64)]


_SET = ("grp", "tokens", "places", "items")


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between sids, enough to connect every component."""
    groups = sets.select("grp", "n", "tokens").dropDuplicates(["grp"])
    spots = cut(groups.select("grp", F.explode("tokens").alias("token")), "prefixes")
    hubs = spots.groupBy("token").agg(F.min("grp").alias("hub"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    edges = spots.join(hubs, "token").filter("grp <> hub").select(F.col("grp").alias("a"), F.col("hub").alias("b")).distinct()
    cluster = connected(edges)
    tagged = sets.join(cluster.withColumnRenamed("node", "grp"), "grp", "left").withColumn("cluster", F.coalesce("label", "grp"))
    # only clusters of two sets or more have pairs
    total = tagged.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total")).filter("k > 1")
    tagged = cut(tagged.join(total, "cluster").select("cluster", "sid", "n", "total", *_SET), "clusters")
    items = tagged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()["s"]
    shards = max(1, -(-items // TASK_ITEMS))
    whole = tagged.filter(F.col("total") <= TASK_ITEMS).select(F.concat(F.lit("c"), F.pmod(F.xxhash64("cluster"), F.lit(shards))).alias("task"), F.lit(-1).alias("side"), "sid", "n", *_SET)
    out = _verified(whole.unionByName(_blocks(tagged.filter(F.col("total") > TASK_ITEMS), percent)), percent)
    return cut(out, "links")


def _blocks(large: DataFrame, percent: int) -> DataFrame:
    """Rows of large clusters, once for each pair of blocks that they belong to and share a prefix shingle in."""
    band = F.floor(F.log("n") / F.lit(float(np.log(100 / percent))))
    rows = large.withColumn("band", band)
    parts = rows.groupBy("cluster", "band").agg(F.ceil(F.sum("n") * 2 / TASK_ITEMS).alias("m"))
    rows = cut(rows.join(parts, ["cluster", "band"]).withColumn("r", F.pmod(F.xxhash64("sid"), F.col("m"))), "blocks")
    piece = ["cluster", "grp", "band", "r"]
    spots = rows.select(*piece, F.explode("tokens").alias("token")).distinct()
    there = spots.select("cluster", "token", F.col("band").alias("band2"), F.col("r").alias("r2")).distinct()
    met = spots.join(there, ["cluster", "token"]).filter(F.abs(F.col("band") - F.col("band2")) <= 1).select(*piece, "band2", "r2").distinct()
    own, other = F.struct("band", "r"), F.struct(F.col("band2").alias("band"), F.col("r2").alias("r"))
    name = lambda x: F.concat_ws(":", x["band"], x["r"])
    task = F.concat_ws("/", F.lit("b"), "cluster", name(F.least(own, other)), name(F.greatest(own, other)))
    side = F.when(own == other, -1).otherwise((own > other).cast("int"))
    return rows.join(met.select(*piece, task.alias("task"), side.alias("side")), piece).select("task", "side", "sid", "n", *_SET)


def _verified(rows: DataFrame, percent: int) -> DataFrame:
    def run(key, t):
        side = t.column("side").to_numpy()
        tokens = [np.array(x, dtype=np.int64) for x in t.column("tokens").to_pylist()]
        places = [np.array(x, dtype=np.int64) for x in t.column("places").to_pylist()]
        items = [np.frombuffer(x, _U) for x in t.column("items").to_pylist()]
        a, b = verify(*[t.column(c).to_numpy() for c in ("sid", "n", "grp")], tokens, places, items, None if (side < 0).all() else side, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("task").applyInArrow(run, "a long, b long")


def components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    rows = cut(members(docs, width), "members")
    found = connected(links(candidates(docs, width, percent), percent))
    ids = rows.filter("doc_id is not null")
    # rows that share a doc_id tie their sets together
    ties = ids.filter("n_shingles > 0").groupBy("doc_id").agg(F.min("key1").alias("b"), F.max("key1").alias("z")).filter("b < z")
    if not ties.isEmpty():
        more = ids.filter("n_shingles > 0").join(ties, "doc_id").select(F.col("key1").alias("a"), "b")
        found = connected(found.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more.filter("a <> b")))
    classes = ids.filter("n_shingles > 0").groupBy("key1").agg(F.min("doc_id").alias("own"))
    labelled = classes.join(found, classes["key1"] == found["node"], "left").select("key1", "own", "label")
    least = labelled.filter("label is not null").groupBy("label").agg(F.min("own").alias("low"))
    named = labelled.join(least, "label", "left").select("key1", F.coalesce("low", "own").alias("component"))
    out = rows.join(named, "key1", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))).alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), SHINGLE, PERCENT)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest doc_id, once."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    gone = components(docs, STAGE_SHINGLE, STAGE_PERCENT).filter("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    left = rows.join(gone, F.col("row.doc_id") == F.col("gone"), "left_anti")
    many = docs.groupBy(F.col("doc_id").alias("many")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and many is not null").select("many")
    if not many.isEmpty():
        one = left.join(many, F.col("row.doc_id") == F.col("many"), "left_semi")
        order = Window.partitionBy("row.doc_id").orderBy("row.text", F.to_json("row"))
        one = one.withColumn("place", F.row_number().over(order)).filter("place = 1").select("row")
        left = left.join(many, F.col("row.doc_id") == F.col("many"), "left_anti").unionByName(one)
    return left.select("row.*")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i + 1 : i + 3], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
"""

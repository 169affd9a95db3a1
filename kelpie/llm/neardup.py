"""Near-duplicate documents by a chosen-path similarity join over minwise tokens.

A document is the set of its distinct shingles of five words. Documents with equal sets are one class, and the join works on
one document of each class. Each is embedded in 64 minwise tokens. An independent tree branches them: every node picks one or
two of the tokens not yet used on its path, by a hash of the path, four thirds on average, which is the inverse of the
similarity sought; the node's documents part by the values of those tokens. Nodes of at most `node_limit` documents are
compared exhaustively. A larger node branches on, as deep as it takes, while that makes it smaller; a node that kept more than
two thirds of its parent's documents holds near copies, which no branching parts, and is dense. A pair at the similarity sought
stays together in a tree with a chance of about a half or more, so 16 trees miss one in 10**4 or fewer.

Large groups of copies are linked first: each document with the pivot with which it shares most root nodes, which is linear.
Nodes whose documents are then all in one component need no more; in the others only pairs across components are compared. The
dense nodes of all trees that hold one group are compared as one, in blocks. Candidates are pairs whose tokens agree within five
standard errors of the limit. Nodes give of them only what connects groups that pivots don't connect yet; the components of both
are clusters that hold all candidates, and within a cluster of several components all full sets are compared across components,
in blocks. No step makes a row for each pair, and no link between components is lost, so the components are exact up to the
recall of the trees. Where k of a dense group's n documents aren't in its large components, a row is made for each of its n
documents and each 256 of the k.

Cases: null and empty texts and texts without words have no shingles and are linked with nothing; rows with null ids take no
part, keep a null component and are kept; rows that share an id share a component; an empty table gives no rows. Columns of
the input other than id and text are not looked at, but kept by `without_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import apart, chunked, columns_of, mixed, range_hashes, rows_of, stored, word_hashes

TOKENS = 64
SHINGLE = 5
_A = (np.random.default_rng(11).integers(0, 2**63, TOKENS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = np.random.default_rng(12).integers(0, 2**63, TOKENS, dtype=np.uint64)
_STRANGE = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(data: bytes | None, words: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a text; of a shorter text, that of all its words."""
    hashes = word_hashes(data)
    n = len(hashes)
    if not n:
        return hashes
    if n < words:
        return range_hashes(hashes, np.array([0]), np.array([n]))
    out = np.zeros(n - words + 1, np.uint64)
    for k in range(words):
        out = (out ^ hashes[k : n - words + 1 + k]) * _STRANGE
        out ^= out >> np.uint64(32)
    return np.unique(mixed(out))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set that isn't empty."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[at : at + 2048, None] * _A + _B).min(0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the class of its set (two numbers) and tokens; stored."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in chunked(rows_of(batches, "doc_id", "data"), 1024):
            made = []
            for doc_id, x in some:
                s = shingle_set(x)
                one, two = (int(mixed(s ^ salt).sum(dtype=np.uint64).astype(np.int64)) for salt in (np.uint64(0), _STRANGE))
                made.append((doc_id, len(s), one, two, minwise(s).tobytes() if len(s) else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 4 else pa.int64()) for k, c in enumerate(zip(*made, strict=True))], ["doc_id", "n_shingles", "set_one", "set_two", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    return stored(rows.mapInArrow(look, "doc_id long, n_shingles long, set_one long, set_two long, tokens binary"), "prepared")


# --- trees ------------------------------------------------------------------------------------


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    return mixed(x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 2**64 - 1))


def branch(path: np.ndarray, used: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, path and used tokens (bits) of the children of rows with paths, used tokens and values of tokens. What a node picks
    depends on its path alone."""
    out = []
    for pick in (0, 1):
        rows = np.arange(len(path)) if not pick else np.flatnonzero(_hash(path, 101) % np.uint64(3) == 0)
        if not len(rows):
            continue
        p, u = path[rows], used[rows].copy()
        if pick:  # not what the first pick took
            u |= np.uint64(1) << _unused(p, u, 0)
        token = _unused(p, u, pick)
        value = tokens[rows, token.astype(np.int64)].astype(np.uint64)
        out.append((rows, mixed(_hash(p, 103) + (value * np.uint64(64) + token) * _STRANGE), used[rows] | np.uint64(1) << token))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), path, used)


def _unused(path: np.ndarray, used: np.ndarray, pick: int) -> np.ndarray:
    """A token that the path hasn't used, by a hash of the path."""
    free = ((used[:, None] >> np.arange(TOKENS, dtype=np.uint64)) & np.uint64(1)) == 0
    turn = (_hash(path, 107 + pick) % np.maximum(free.sum(1), 1).astype(np.uint64)).astype(np.int64)
    return (np.cumsum(free, 1) > turn[:, None]).argmax(1).astype(np.uint64)


def _matrix(tokens: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(tokens), "<u4").reshape(-1, TOKENS)


def _grown(rows: DataFrame, trees: int | None = None) -> DataFrame:
    """Children (path, used, doc_id, above: the documents of their parent) of rows with path, used, doc_id, n and tokens, or those of
    the roots of so many trees."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens, *at in columns_of(batches, "doc_id", "tokens", *([] if trees else ["path", "used", "n"])):
            for low in range(0, len(ids), 4096):
                own, matrix = np.asarray(ids[low : low + 4096], np.int64), _matrix(tokens[low : low + 4096])
                if trees:
                    path, used = np.tile(np.arange(trees, dtype=np.uint64), len(own)), np.zeros(len(own) * trees, np.uint64)
                    own, matrix, above = np.repeat(own, trees), np.repeat(matrix, trees, 0), np.full(len(own) * trees, 2**60)
                else:
                    path, used, above = (np.asarray(x[low : low + 4096], np.int64) for x in at)
                row, path, used = branch(path.astype(np.uint64), used.astype(np.uint64), matrix)
                yield pa.RecordBatch.from_arrays([pa.array(path.astype(np.int64)), pa.array(used.astype(np.int64)), pa.array(own[row]), pa.array(above[row])], ["path", "used", "doc_id", "above"])

    return rows.mapInArrow(grow, "path long, used long, doc_id long, above long")


# --- candidates and links ---------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data")).filter("data is not null")


#: Bits of the filter of wanted ids: a table of at most _FILTER / 64 rows, whatever their number.
_FILTER = 1 << 24


def _maybe_wanted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts but for most of those whose doc_id isn't wanted, so that few of these are shuffled."""
    place = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(_FILTER))
    bit = lambda: F.call_function("shiftleft", F.lit(1).cast("long"), (place() % 64).cast("int"))
    bits = wanted.select(F.floor(place() / 64).alias("__word"), bit().alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    found = texts.withColumn("__word", F.floor(place() / 64)).join(F.broadcast(bits), "__word")  # at most _FILTER / 64 rows
    return found.filter(F.col("__bits").bitwiseAND(bit()) != 0).drop("__word", "__bits")


def _keyed_sets(docs: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The sets of the wanted documents, each row with its long keys, rows of equal keys next to each other in order of keys."""
    names = ["doc_id", *keys]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, b"")  # a document's rows come one after another
        for some in chunked(rows_of(batches, "data", *names), 64):
            made = []
            for x, *_ in some:
                if x != last[0]:
                    last = (x, shingle_set(x).tobytes())
                made.append(last[1])
            rest = zip(*(r[1:] for r in some), strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rest), pa.array(made, pa.binary())], [*names, "shingles"])

    wanted = stored(wanted.select(*names), "wanted")
    sets = _maybe_wanted(_texts(docs), wanted).join(wanted, "doc_id").select("data", *names).mapInArrow(look, ", ".join(f"{n} long" for n in names) + ", shingles binary")
    return sets.repartition(*keys[:-1]).sortWithinPartitions(*keys)


def _pivots_confirmed(best: DataFrame, docs: DataFrame, percent: int, share: int = 1024) -> DataFrame:
    """The pairs (a, b), one for each b, whose full sets are similar; the documents of a pivot are dealt to parts of about `share`,
    each with the pivot's own set first."""
    sized = best.join(best.groupBy("a").agg(F.ceil(F.count("*") / share).alias("ways")), "a")
    others = sized.select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), "ways").alias("part"), F.lit(1).cast("long").alias("turn"))
    firsts = sized.groupBy("a").agg(F.max("ways").alias("ways")).select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)).alias("part"), F.lit(0).cast("long").alias("turn"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, at = [], None  # rows that share the pivot's id each count
        for ids, a, part, turn, data in columns_of(batches, "doc_id", "a", "part", "turn", "shingles"):
            found = []
            for i, p, q, t, x in zip(ids, a, part, turn, data, strict=True):
                if (p, q) != at:
                    pivots, at = [], (p, q)
                own = np.frombuffer(x, np.uint64)
                if t == 0:
                    pivots.append(own)
                elif any(similar(v, own, percent) for v in pivots):
                    found.append((p, i))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _keyed_sets(docs, others.union(firsts), ["a", "part", "turn"]).mapInArrow(check, "a long, b long")


def _forest(one: np.ndarray, two: np.ndarray, labels: list) -> list[tuple[int, int]]:
    """Of the pairs of positions, those that connect labels not yet connected."""
    root: dict = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for i, j in zip(one.tolist(), two.tolist(), strict=True):
        x, y = find(labels[i]), find(labels[j])
        if x != y:
            root[x] = y
            kept.append((i, j))
    return kept


def _likely_pairs(docs: list, comps: list, groups: list, tokens: list, least: int) -> list[tuple[int, int]]:
    """Pairs of a node's documents that share so many tokens, across components, as far as they connect groups anew."""
    matrix, comp, ids = _matrix(tokens), np.asarray(comps), np.asarray(docs)
    one, two = [], []
    for i in range(len(ids) - 1):
        near = np.flatnonzero(((matrix[i + 1 :] == matrix[i]).sum(1) >= least) & (comp[i + 1 :] != comp[i]) & (ids[i + 1 :] != ids[i])) + i + 1
        one.append(np.full(len(near), i))
        two.append(near)
    if not one:
        return []
    return [(docs[i], docs[j]) for i, j in _forest(np.concatenate(one), np.concatenate(two), groups)]


def _pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _leaf_pairs(leaves: DataFrame, least: int) -> DataFrame:
    """Candidates of nodes that hold at most node_limit documents: their rows are bounded lists."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (nodes,) in columns_of(batches, "node"):
            yield _pair_batch([p for n in nodes for p in _likely_pairs([x["doc_id"] for x in n], [x["comp"] for x in n], [x["group"] for x in n], [x["tokens"] for x in n], least)])

    nodes = leaves.groupBy("path").agg(F.collect_list(F.struct("doc_id", "comp", "group", "tokens")).alias("node"))
    return nodes.select("node").mapInArrow(compare, "a long, b long")


def _blocked(rows: DataFrame, group: str, size: int) -> DataFrame:
    """Rows of groups dealt to blocks of about `size`, and each row to the pairs of blocks (one <= two) that its own is in. A large
    component has blocks of its own, which don't meet each other."""
    counts = rows.groupBy(group, "comp").agg(F.count("*").alias("__n")).withColumn("__pure", F.when(F.col("__n") >= size, F.col("comp")))
    ways = counts.groupBy(group, "__pure").agg(F.ceil(F.sum("__n") / size).alias("__ways"))
    block = F.xxhash64(F.col("__pure"), F.col("__at"))
    blocks = ways.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__ways") - 1))).groupBy(group).agg(F.collect_list(F.struct("__pure", block.alias("block"))).alias("__blocks"))
    pure = counts.filter("__pure is not null").select(group, "comp", "__pure")
    own = rows.join(pure, [group, "comp"], "left").join(ways.select(F.col(group).alias("__g"), F.col("__pure").alias("__p"), "__ways"), (F.col(group) == F.col("__g")) & F.col("__pure").eqNullSafe(F.col("__p")))
    own = own.withColumn("__at", F.pmod(F.xxhash64("doc_id"), "__ways")).withColumn("__own", block).drop("__g", "__p")
    met = own.join(blocks, group).withColumn("__met", F.explode("__blocks")).filter(F.coalesce(F.col("__met.__pure") != F.col("__pure"), F.lit(True)))
    return met.withColumn("one", F.least("__own", "__met.block")).withColumn("two", F.greatest("__own", "__met.block")).drop("__ways", "__own", "__met", "__pure", "__at", "__blocks")


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[list[tuple]]:
    """The rows of each run of equal keys."""
    at, rows = None, []
    for columns in columns_of(batches, *keys, *names):
        for row in zip(*columns, strict=True):
            if row[: len(keys)] != at:
                if rows:
                    yield rows
                at, rows = row[: len(keys)], []
            rows.append(row[len(keys) :])
    if rows:
        yield rows


def _block_pairs(rows: DataFrame, least: int, block: int = 256) -> DataFrame:
    """Candidates of groups of dense nodes (key, doc_id, comp, group, tokens), by pairs of blocks of their documents."""
    keys = ["key", "one", "two"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, keys, ["doc_id", "comp", "group", "tokens"]):
            yield _pair_batch(_likely_pairs(*map(list, zip(*group, strict=True)), least))

    dealt = _blocked(rows, "key", block)
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets, by products of their incidence with the values that several of them have."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    _, number = np.unique(number[shared], return_inverse=True)
    owner, total = owner[shared], np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        s, e = np.searchsorted(number, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[s:e], number[s:e] - low] = 1
        total += part @ part.T
    return total


def _links_within(clusters: DataFrame, docs: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """Links between documents of a cluster (cluster, doc_id, comp) whose full sets are similar, across components, as far as they
    connect them anew; large clusters by pairs of blocks."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["cluster", "one", "two"], ["doc_id", "comp", "shingles"]):
            ids, comps = [g[0] for g in group], np.asarray([g[1] for g in group])
            sets = [np.frombuffer(g[2], np.uint64) for g in group]
            if len(sets) <= 8:
                pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if comps[i] != comps[j] and similar(sets[i], sets[j], percent)]
                one, two = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
            else:
                both, size = _common(sets), np.array([len(x) for x in sets], np.float32)
                one, two = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size - both), 1) & (comps[:, None] != comps))
            yield _pair_batch([(ids[i], ids[j]) for i, j in _forest(one, two, comps.tolist())])

    dealt = _blocked(clusters, "cluster", block)
    return _keyed_sets(docs, dealt, ["cluster", "one", "two", "comp"]).mapInArrow(check, "a long, b long")


def _stars(edges: DataFrame) -> bool:
    """Whether each u of the edges (u, v) has one v, which is no u itself: then v names its component. One number reaches the driver."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select(F.col("v"), F.lit(0)))
    odd = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).filter("ups > 1 or (ups = 1 and n > 1)")
    return odd.agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """doc_id and comp, the smallest id reachable, of each end of the links a, b: large and small stars in turn until only stars
    are left."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("comp")).distinct())


def _as_links(comps: DataFrame) -> DataFrame:
    """The links (a, b) of each document with the name of its component."""
    return comps.select(F.col("doc_id").alias("a"), F.col(comps.columns[1]).alias("b"))


def _best_pivots(members: DataFrame, trees: int) -> DataFrame:
    """For each document b the pivot a with which it shares most root nodes, where these are two fifths of them or more. A group's
    most central document is in large nodes more often than others: it is the pivot of those nodes."""
    central = members.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    weighed = members.select("path", "doc_id").join(central, "doc_id")
    pivots = weighed.groupBy("path").agg(F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("a"))
    stars = members.select("path", "doc_id").join(pivots, "path").select("a", F.col("doc_id").alias("b")).filter("a <> b")
    shared = stars.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= trees * 4 / 3 * 2 / 5)
    return shared.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))


def linked(docs: DataFrame, reps: DataFrame, percent: int = 75, trees: int = 16, node_limit: int = 32, block: int = 256) -> DataFrame:
    """Components (doc_id, comp) of the representatives that have links; reps has doc_id and tokens."""
    likely = percent / 100
    least = int(TOKENS * likely - 5 * (TOKENS * likely * (1 - likely)) ** 0.5)
    roots = _grown(reps, trees)
    nodes = roots.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(roots.join(nodes, "path"), "members")
    best = stored(_best_pivots(members, trees), "best")
    comps = components(_pivots_confirmed(best, docs, percent))
    groups = components(best.select("a", "b")).withColumnRenamed("comp", "group")
    current = members.drop("n").join(comps, "doc_id", "left").join(groups, "doc_id", "left").withColumns({"comp": F.coalesce("comp", "doc_id"), "group": F.coalesce("group", "doc_id")})
    found: list[DataFrame] = []
    dense: list[DataFrame] = []
    for level in range(1, TOKENS):
        info = current.groupBy("path").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("path", "n")
        open_ = stored(current.join(info, "path").join(reps.select("doc_id", "tokens"), "doc_id"), "nodes")
        found.append(_leaf_pairs(open_.filter(F.col("n") <= node_limit), least))
        large = open_.filter(F.col("n") > node_limit)
        if large.isEmpty():
            break
        stays = (F.col("n") * 3 >= F.col("above") * 2) | F.lit(level == TOKENS - 1)
        stuck = large.filter(stays)
        keys = stuck.groupBy("path", "group").agg(F.count("*").alias("n")).groupBy("path").agg(F.max_by("group", F.struct("n", -F.col("group"))).alias("key"))
        dense.append(stuck.join(keys, "path").select("key", "doc_id", "comp", "group").distinct())
        on = large.filter(~stays)
        grown = _grown(on.select("path", "used", "doc_id", "n", "tokens"))
        current = stored(grown.join(on.select("doc_id", "comp", "group").distinct(), "doc_id"), "grown")
    if dense:
        every = stored(reduce(DataFrame.union, dense).distinct(), "dense")
        found.append(_block_pairs(every.join(reps.select("doc_id", "tokens"), "doc_id"), least, block))
    # All pairs that may be linked lie within a component of pivots' and nodes' candidates; what they connect is confirmed there.
    clusters = components(_as_links(groups).union(reduce(DataFrame.union, found))).withColumnRenamed("comp", "cluster")
    named = clusters.join(comps, "doc_id", "left").select("cluster", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))
    mixed_ones = named.groupBy("cluster").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("cluster")
    second = _links_within(stored(named.join(mixed_ones, "cluster"), "clusters"), docs, percent, block)
    return components(_as_links(comps).union(second))


def near_duplicates(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    rows = prepared(docs)
    real = rows.filter("doc_id is not null and n_shingles > 0")
    classes = stored(real.groupBy("set_one", "set_two", "n_shingles").agg(F.min(F.struct("doc_id", "tokens")).alias("rep")).select("set_one", "set_two", "n_shingles", "rep.doc_id", "rep.tokens"), "classes")
    comps = linked(docs, classes.select("doc_id", "tokens"), **options)
    # rows that share an id, by classes with the same first id or by several classes of one id, share a component
    named = classes.join(comps, "doc_id", "left").select("set_one", "set_two", "n_shingles", F.coalesce("comp", "doc_id").alias("comp"))
    seen = rows.join(named, ["set_one", "set_two", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
    return seen.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, **options: int) -> DataFrame:
    """The rows whose id is the smallest of their component; of rows that repeat such an id, one stays. Rows with null ids stay."""
    seen = near_duplicates(docs, **options).filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.bool_and("kept").alias("__kept"), F.count("*").alias("__n"))
    marks = stored(seen.filter("not __kept or __n > 1"), "marks")
    marked = apart(docs, id=F.col("doc_id").cast("long")).join(marks, F.col("id") == F.col("__id"), "left").filter("__id is null or __kept")
    if not marks.filter("__kept").isEmpty():
        marked = marked.filter("__id is null").select("row").union(marked.filter("__id is not null").dropDuplicates(["__id"]).select("row"))
    return marked.select("row.*")


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = d.doc_id
"""

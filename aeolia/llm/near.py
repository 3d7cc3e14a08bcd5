"""N-gram Jaccard join through a token-group matrix.

1. Texts with equal shingle sets are one class; its smallest id stands for it from here on.
2. Any two sets that link share one of their first tokens in any order that all sets use, if
   each gives its first n - ceil(t * n) + 1, and j of them if each gives j - 1 more. A set of
   whose first tokens fewer than j are in any other set links with nothing. The order puts tokens by how common they are
   (a bounded table of frequent ones) and then by hash. Only sets that share such a token
   with another set go on. Parity bits of each set bound what two sets can share; whole token
   arrays are made only for sets that this bound leaves.
3. Sets that share a first token form groups of similar sets. A few rounds compare every
   member with one set of its group only, so that most links fall inside known components.
4. Exact pass. The sets of each component are cut into groups of at most ``GROUP`` members;
   a matrix row keeps a group's token union and the smallest size in it. A set is compared
   with those groups of other components that share a first token, first through the bound
   |set & union|, and only qualifying groups are opened. Found links merge components. The
   place of a shared token in the order bounds what can follow it, so a pair that is too far
   apart drops out before the join where its rare tokens come first.

The result has every document with its set's size and the smallest id in its component. A
text without words has an empty set and links with nothing. Rows without id are returned with
their set's size, linked with nothing and without a component;
rows that repeat an id are told apart by text only through their class, so that each gets the
component of the id. Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolia.llm.tables import dropped, most_frequent, shared_folder, table, written
from aeolia.llm.words import mix, slices, windows

GROUP = 64
#: Tokens that at least this many sets of some megabytes of text have may enter the table of frequent ones.
OFTEN, MOST_FREQUENT = 4, 1 << 18
ROUNDS = 2
#: Parity bits of a set; a power of 2.
BITS = 2048
SCALE = 100


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ends, tokens) slice by slice: ascending distinct tokens of each text."""
    for at, _, w in slices(column):
        h, n = w.hashes(), len(w.offsets) - 1
        s, ok = windows(h, w.row, list(range(k)))
        row = w.row[ok]
        first = w.first
        size = np.diff(first)
        short = np.flatnonzero((size > 0) & (size < k))
        if len(short):  # the whole sequence is one shingle
            extra = []
            for r in short.tolist():
                one, _ = windows(h[first[r] : first[r + 1]], w.row[first[r] : first[r + 1]], list(range(int(size[r]))))
                extra.append(one[0] ^ np.uint64(int(size[r]) * 0x5851F42D4C957F2D % (1 << 64)))
            s, row = np.concatenate([s, np.array(extra, np.uint64)]), np.concatenate([row, short])
        order = np.lexsort((s, row))
        s, row = s[order], row[order]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
        s, row = s[keep], row[keep]
        yield at, np.searchsorted(row, np.arange(1, n + 1)), s


def parity_bits(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each set BITS bits, each the parity of the number of tokens that fall on it."""
    n = len(ends)
    row = np.repeat(np.arange(n), np.diff(np.r_[0, ends]))
    hit = np.bincount(row * BITS + (tokens >> np.uint64(23)).astype(np.int64) % BITS, minlength=n * BITS)
    return np.packbits((hit & 1).astype(bool).reshape(n, BITS), axis=1)


def most_common(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bound on the tokens that two sets share: each differing bit is a token of one of them alone."""
    return (n + m - np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)) // 2


def _classes(docs: DataFrame, k: int) -> DataFrame:
    """(d, n, a, b, bits): size, two independent sums over the set's tokens, and parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ends, s in shingle_sets(batch.column(1), k):
                begin = np.r_[0, ends[:-1]]
                sums = []
                for v in (s, mix(s ^ np.uint64(0xD6E8FEB86659FD93))):
                    total = np.zeros(len(v) + 1, np.uint64)
                    np.cumsum(v, dtype=np.uint64, out=total[1:])
                    sums.append(pa.array((total[ends] - total[begin]).view(np.int64)))
                bits = pa.array([x.tobytes() for x in parity_bits(s, ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ends)), pa.array(ends - begin), *sums, bits], names=["d", "n", "a", "b", "bits"])

    return docs.mapInArrow(run, "d long, n long, a long, b long, bits binary")


def _frequent(docs: DataFrame, k: int) -> DataFrame:
    """(token, df): in how many texts it is, counted where it is common among some megabytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[np.ndarray] = []
            for at, ends, s in shingle_sets(batch.column(1), k):
                held.append(s)
                if len(held) == 8 or at + len(ends) == batch.num_rows:
                    u, n = np.unique(np.concatenate(held), return_counts=True)
                    often = n >= OFTEN
                    yield pa.RecordBatch.from_arrays([pa.array(u[often].view(np.int64)), pa.array(n[often])], names=["token", "df"])
                    held = []

    total = docs.mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))
    return total


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """n - ceil(n * percent / 100) + 1, and none of an empty set: two sets that link share one of these."""
    return np.where(n > 0, n - -(-n * percent // SCALE) + 1, 0)


def _more(n: np.ndarray) -> np.ndarray:
    """How many tokens beyond prefix_size each set gives."""
    return np.maximum(1, n // 10) - 1


def _first_tokens(docs: DataFrame, k: int, percent: int, frequent) -> DataFrame:
    """(d, n, tokens): each set's first tokens in order, those of prefix_size and then ``_more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, level = frequent.value
        maybe = np.zeros(1 << 22, bool)
        maybe[common >> np.uint64(42)] = True
        for batch in batches:
            d = batch.column(0).to_numpy(zero_copy_only=False)
            for at, ends, s in shingle_sets(batch.column(1), k):
                begin = np.r_[0, ends[:-1]]
                n = ends - begin
                row = np.repeat(np.arange(len(n)), n)
                rank = np.zeros(len(s), np.uint8)
                few = np.flatnonzero(maybe[s >> np.uint64(42)])
                if len(few) and len(common):
                    p = np.minimum(np.searchsorted(common, s[few]), len(common) - 1)
                    rank[few] = np.where(common[p] == s[few], level[p], 0)
                order = np.lexsort((rank, row))  # stable: equal ranks stay by hash
                place = np.arange(len(s)) - np.repeat(begin, n)
                taken = place < np.repeat(prefix_size(n, percent) + _more(n), n)
                upto = np.r_[0, np.cumsum(np.bincount(row[taken], minlength=len(n)))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(s[order][taken].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(d[at : at + len(n)]), pa.array(n.astype(np.int64)), lists], names=["d", "n", "tokens"])

    return docs.mapInArrow(run, "d long, n long, tokens array<long>")


def _plausible(sets: DataFrame, percent: int) -> DataFrame:
    """Sets that share enough of their first tokens with any other sets.

    Two sets share as many as the smaller of them gives beyond prefix_size, and one more; the
    smaller has at least percent / 100 of the tokens of the larger. A repeated id counts its own
    tokens again, which keeps more sets and never fewer.
    """
    tokens = sets.select(F.explode("tokens").alias("token"), "d")
    shared = tokens.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    enough = tokens.join(shared, "token", "left_semi").groupBy("d").agg(F.count("*").alias("k"))
    return sets.join(enough, "d").where(f"k >= greatest(1, (n * {percent} div {SCALE}) div 10)").drop("k")


def _basic(sets: DataFrame, percent: int) -> DataFrame:
    """(token, d, n, at): the tokens of prefix_size and how many come before each."""
    return sets.select("d", "n", F.posexplode("tokens").alias("at", "token")).where(f"at < n - (n * {percent} + {SCALE - 1}) div {SCALE} + 1")


def _token_arrays(docs: DataFrame, k: int) -> DataFrame:
    """(d, n, s): the set as the bytes of its ascending tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, sizes = [], []
            for _, ends, s in shingle_sets(batch.column(1), k):
                sets += [x.tobytes() for x in np.split(s, ends[:-1])]
                sizes += np.diff(np.r_[0, ends]).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], names=["d", "n", "s"])

    return docs.mapInArrow(run, "d long, n long, s binary")


def common_tokens(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _stacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), BITS // 8)


def _likely(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """Those (x, y) that sizes and parity bits don't rule out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, m = pdf["n"].to_numpy(), pdf["m"].to_numpy()
            both = np.minimum(most_common(n, m, _stacked(pdf["p"]), _stacked(pdf["q"])), np.minimum(n, m))
            yield pdf.loc[SCALE * both >= percent * (n + m - both), ["x", "y"]]

    left = sketch.select(F.col("d").alias("x"), "n", F.col("bits").alias("p"))
    right = sketch.select(F.col("d").alias("y"), F.col("n").alias("m"), F.col("bits").alias("q"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "n", "m", "p", "q").mapInPandas(run, "x long, y long")


def _links(pairs: DataFrame, docs: DataFrame, sketch: DataFrame, k: int, percent: int, folder: str, name: str) -> DataFrame:
    """Those (x, y) whose sets link; whole sets are made only for pairs that the bits leave."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for a, b in zip(pdf["sa"], pdf["sb"], strict=True):
                u, v = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = common_tokens(u, v)
                ok.append(SCALE * both >= percent * (len(u) + len(v) - both))
            yield pdf.loc[np.array(ok, bool), ["x", "y"]]

    pairs = written(_likely(pairs, sketch, percent), folder, f"likely-{name}")
    sets = _sets_of(docs, pairs.select(F.explode(F.array("x", "y")).alias("d")).distinct(), k)
    sets = written(sets, folder, f"sets-{name}")
    left = sets.select(F.col("d").alias("x"), F.col("s").alias("sa"))
    right = sets.select(F.col("d").alias("y"), F.col("s").alias("sb"))
    return written(pairs.join(left, "x").join(right, "y").select("x", "y", "sa", "sb").mapInPandas(run, "x long, y long"), folder, f"links-{name}")


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(d, n, s) of the given ids; a repeated id gives its first set by bytes."""
    return _token_arrays(docs.join(ids, "d", "left_semi"), k).groupBy("d").agg(F.min_by(F.struct("n", "s"), F.struct("n", "s")).alias("v")).select("d", "v.*")


def components(nodes: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """(d, c): the smallest id that links reach, by large-star and small-star steps.

    Each step writes its edges to the shared folder; it ends when a step changes none, which
    takes about the logarithm of the longest chain.
    """
    edges = written(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u != v").distinct(), folder, f"{name}-0")
    step, last = 0, None
    while True:
        step += 1
        # Large star: every larger neighbour of a node is tied to the node's smallest.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, folder, f"{name}-{step}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == last:
            break
        last = now
    return nodes.join(edges.groupBy("u").agg(F.min("v").alias("v")), nodes["d"] == F.col("u"), "left").select("d", F.coalesce("v", "d").alias("c"))


def _likely_groups(rows: DataFrame, members: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """Those (x, g) with a member that sizes and parity bits don't rule out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for n, p, sizes, bits in zip(pdf["n"], pdf["bits"], pdf["sizes"], pdf["members"], strict=True):
                m = np.asarray(sizes)
                both = np.minimum(most_common(n, m, np.frombuffer(p, np.uint8), np.frombuffer(b"".join(bits), np.uint8).reshape(len(m), -1)), np.minimum(n, m))
                ok.append(bool((SCALE * both >= percent * (n + m - both)).any()))
            yield pdf.loc[np.array(ok, bool), ["x", "g"]]

    packed = members.select("d", "g").join(sketch, "d").groupBy("g").agg(F.collect_list("n").alias("sizes"), F.collect_list("bits").alias("members"))  # about GROUP each
    left = sketch.select(F.col("d").alias("x"), "n", "bits")
    return rows.join(left, "x").join(packed, "g").select("x", "g", "n", "bits", "sizes", "members").mapInPandas(run, "x long, g long")


def _group_links(rows: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The exact pass over (set, group) candidates: bound by the union, then open."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for x, n, s, ids, sizes, members, union in zip(*(pdf[c] for c in ("x", "n", "s", "ids", "sizes", "members", "union")), strict=True):
                mine = np.frombuffer(s, np.uint64)
                reach = common_tokens(mine, np.frombuffer(union, np.uint64))
                # Two sets that link share at least percent / 100 of the larger one.
                if SCALE * reach < percent * max(n, min(sizes)):
                    continue
                for y, m, t in zip(ids, sizes, members, strict=True):
                    if SCALE * min(reach, n, m) < percent * max(n, m):
                        continue
                    both = common_tokens(mine, np.frombuffer(t, np.uint64))
                    if SCALE * both >= percent * (n + m - both):
                        found.append((x, y))
            yield pd.DataFrame(found, columns=["x", "y"], dtype="int64")

    left = sets.select(F.col("d").alias("x"), "n", "s")
    return rows.join(groups, "g").join(left, "x").select("x", "n", "s", "ids", "sizes", "members", "union").mapInPandas(run, "x long, y long")


def _matrix(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, ids, sizes, members, union): a row of the token-group matrix for each group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["union"] = [np.unique(np.concatenate([np.frombuffer(t, np.uint64) for t in m])).tobytes() for m in pdf["members"]]
            yield pdf

    packed = members.join(sets, "d").groupBy("g").agg(F.collect_list(F.struct("d", "n", "s")).alias("r"))  # at most GROUP each
    packed = packed.select("g", F.col("r.d").alias("ids"), F.col("r.n").alias("sizes"), F.col("r.s").alias("members"))
    return packed.mapInPandas(run, "g long, ids array<long>, sizes array<long>, members array<binary>, union binary")


def jaccard_components(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id); sets of k words link at a Jaccard similarity of percent / 100."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    whole = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    docs = whole.where(F.col("d").isNotNull())
    classes = written(_classes(docs, k), folder, "classes")
    # A set of no tokens links with nothing: it is a class for each id.
    key = ["n", "a", "b", F.when(F.col("n") == 0, F.col("d")).alias("e")]
    least = classes.groupBy(*key).agg(F.min("d").alias("r"))
    rep = written(least.where("n > 0"), folder, "representatives")
    common = written(_frequent(docs, k), folder, "common")
    top = most_frequent(common, "df", MOST_FREQUENT).toPandas()  # at most MOST_FREQUENT rows
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    level = np.minimum(255, 1 + 4 * np.log2(np.maximum(1, top["df"].to_numpy(float)))).astype(np.uint8)
    frequent = spark.sparkContext.broadcast((token[order], level[order]))
    firsts = _first_tokens(docs, k, percent, frequent).join(rep.select(F.col("r").alias("d")), "d", "left_semi")
    firsts = written(firsts, folder, "tokens")
    # What chance alone shares goes in two steps: without the sets that the first rules out,
    # fewer tokens of the others are shared.
    firsts = written(_plausible(firsts, percent), folder, "plausible-1")
    dropped(spark, f"{folder}/tokens")
    firsts = written(_plausible(firsts, percent), folder, "plausible-2")
    dropped(spark, f"{folder}/plausible-1")
    tokens = _basic(firsts, percent)
    shared = tokens.groupBy("token").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a < b").select("token")
    tokens = written(tokens.join(shared, "token", "left_semi"), folder, "shared")
    dropped(spark, f"{folder}/plausible-2")
    near = tokens.select("d").distinct()
    sketch = classes.join(near, "d", "left_semi").groupBy("d").agg(F.min_by(F.struct("n", "bits"), F.struct("n", "a", "b")).alias("v")).select("d", "v.*")
    sketch = written(sketch, folder, "sketch")

    parts = near.withColumn("c", F.col("d"))
    links = None
    for turn in range(ROUNDS):
        # Every member against one set of its group: in the first round the one with the fewest
        # tokens before the shared one, later the first that another component has.
        labelled = tokens.join(parts, "d")
        by = F.struct("at", "d", "n", "c") if turn == 0 else F.struct(F.xxhash64("c", "token"), "at", "d", "n", "c")
        pivot = labelled.groupBy("token").agg(F.min(by).alias("p"), F.count_distinct("c").alias("k")).where("k > 1")
        pivot = pivot.select("token", F.col("p.d").alias("y"), F.col("p.n").alias("m"), F.col("p.c").alias("other"))
        pairs = labelled.join(pivot, "token").where("c != other").where(f"{SCALE} * least(n, m) >= {percent} * greatest(n, m)")
        pairs = pairs.select(F.least("d", "y").alias("x"), F.greatest("d", "y").alias("y")).distinct()
        found = _links(pairs, docs, sketch, k, percent, folder, str(turn))
        links = found if links is None else links.unionByName(found)
        parts = written(components(near, links, folder, f"stars-{turn}"), folder, f"parts-{turn}")

    # Groups: a component's sets hashed into twice as many groups as would do, so that none is
    # far beyond GROUP and a component of any number of sets is never sorted in one task.
    many = parts.groupBy("c").agg(F.count("*").alias("k"))
    sized = parts.join(sketch.select("d", "n"), "d").join(many, "c")
    of = F.pmod(F.xxhash64("d"), F.ceil(F.col("k") * 2 / GROUP))
    members = written(sized.select("d", "c", "n", F.struct("k", "c").alias("rank"), F.xxhash64("c", of).alias("g")), folder, "members")
    # The sets of the smaller component ask the groups of the larger one. Where a token's sets
    # are nearly all of one component, that component asks nothing and only the rest does.
    # At the first token of the order that two sets share, each has enough tokens left for a
    # link: (SCALE + percent) * left >= percent * (n + m). What is left beyond its own size is ``spare``.
    spare = F.expr(f"{SCALE + percent} * (n - at) - {percent} * n")
    of_group = tokens.select("token", "d", "n", spare.alias("spare")).join(members.drop("n"), "d")
    index = of_group.groupBy("token", "g", "rank").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("spare").alias("most_spare"))
    open_ = index.groupBy("token").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).where("least < most")
    index = index.join(open_, "token").where("rank > least").select("token", "g", "rank", "low", "high", "most_spare")
    asks = of_group.join(open_, "token").where("rank < most").select("token", F.col("d").alias("x"), F.col("rank").alias("mine"), "n", "spare")
    rows = asks.join(index, "token").where(f"mine < rank and spare >= {percent} * low and most_spare >= {percent} * n")
    rows = rows.where(f"{SCALE} * least(n, high) >= {percent} * greatest(n, low)")
    rows = rows.select("x", "g").distinct()
    rows = written(_likely_groups(rows, members, sketch, percent), folder, "likely-exact")
    opened = members.select("d", "g").join(rows.select("g").distinct(), "g", "left_semi")
    sets = written(_sets_of(docs, opened.select("d").unionByName(rows.select(F.col("x").alias("d"))).distinct(), k), folder, "sets-exact")
    links = links.unionByName(written(_group_links(rows, _matrix(opened, sets), sets, percent), folder, "links-exact"))
    parts = components(near, links, folder, "stars-exact")

    named = rep.join(parts, rep["r"] == parts["d"], "left").select("n", "a", "b", F.coalesce("c", "r").alias("c"))
    out = classes.join(named, ["n", "a", "b"], "left")
    unnamed = _classes(whole.where(F.col("d").isNull()), k).select("d", "n", F.lit(None).cast("long").alias("c"))
    out = out.select("d", "n", F.coalesce("c", "d").alias("c")).unionByName(unnamed)
    return out.select(F.col("d").alias(id_col), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


_SQL_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w WHERE w IS NOT NULL),
n AS (SELECT doc_id, len(s) AS n FROM sets WHERE doc_id IS NOT NULL),
t AS (SELECT doc_id, unnest(s) AS t FROM sets WHERE doc_id IS NOT NULL),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM t AS a JOIN t AS b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY x, y),
links AS (SELECT x, y FROM met JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(d, r) AS (SELECT x, x FROM edges UNION SELECT reach.d, edges.y FROM reach JOIN edges ON edges.x = reach.r),
least AS (SELECT d, min(r) AS c FROM reach GROUP BY d)
SELECT documents.doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, coalesce(c, documents.doc_id) AS component_id
FROM documents LEFT JOIN sets ON sets.doc_id = documents.doc_id LEFT JOIN least ON d = documents.doc_id
"""

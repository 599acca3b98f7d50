"""Exact vector search, fusion of vector spaces, and groups of candidates."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.session import prepared

#: Vectors of queries that a task holds.
BLOCK_BYTES = 16 << 20
#: Queries and gallery rows whose scores a task holds at once, and pairs that are scored anew at once.
QUERIES, PIECE, PAIRS = 512, 2048, 1 << 16


def best(df: DataFrame, k: int, by: str = "score", query: str = "q", tie: str = "g") -> DataFrame:
    """The k best rows of each query, numbered from 1 as rank; ties by the smaller id."""
    order = Window.partitionBy(query).orderBy(F.desc(by), tie)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def unit(x: np.ndarray, by_row: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in single precision, brought to length 1 (each, or else the longest), and what they were divided by. Nothing overflows."""
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1, initial=0.0)
        top = top if by_row else np.full(len(x), top[np.isfinite(top)].max(initial=0.0))
        top = np.where((top > 0) & np.isfinite(top), top, 1.0)
        x = x / top[:, None]
        size = np.sqrt(np.einsum("ij,ij->i", x, x))
        size = size if by_row else np.full(len(x), size[np.isfinite(size)].max(initial=0.0))
        size = np.where((size > 0) & np.isfinite(size), size, 1.0)
        return np.ascontiguousarray(x / size[:, None], np.float32), top * size


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up in one order whatever their places."""
    with np.errstate(all="ignore"):
        return np.einsum("ij,ij->i", a, b)


def copies(y: np.ndarray) -> np.ndarray:
    """How many rows before each are equal to it."""
    words = np.ascontiguousarray(y).view(np.uint64)
    sums = words @ (np.random.default_rng(1).integers(0, 1 << 63, words.shape[1], np.uint64) | np.uint64(1))
    if len(np.unique(sums)) == len(y):
        return np.zeros(len(y), np.int64)
    _, same = np.unique(words, axis=0, return_inverse=True)
    order = np.argsort(same.ravel(), kind="stable")
    n = np.bincount(same.ravel())
    out = np.empty(len(y), np.int64)
    out[order] = np.arange(len(y)) - np.repeat(np.cumsum(n) - n, n)
    return out


class Nearest:
    """The k best gallery rows of each query in one of several spaces, while the gallery passes in batches; ties by the smaller id.

    Scores in single precision, whose error is bounded, only tell which pairs can't be among the k best. All others are scored in double precision, in the
    same way wherever they stand, so equal vectors have equal scores. Scores that are no number are left out.
    """

    def __init__(self, tables: list[np.ndarray], space: int, ids: np.ndarray, k: int, exclude_self: bool):
        self.tables, self.space, self.ids, self.k, self.exclude_self = tables, space, ids, k, exclude_self
        x = tables[space]
        self.small, self.size = unit(x, True)
        self.odd = np.isinf(x).any(axis=1)
        self.slack = (x.shape[1] + 16) * 2.0**-22
        self.least = np.where(np.isnan(x).any(axis=1), np.inf, -np.inf)  # the k-th best score so far; without any number nothing counts
        self.kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(tables)))
        self.new, self.n_new, self.seen = [], 0, 0
        self.scores = np.empty(QUERIES * PIECE, np.float32)

    def add(self, tables: list[np.ndarray], ids: np.ndarray) -> None:
        """Gallery rows, in ascending order of ids."""
        y = tables[self.space]
        use = ~np.isnan(y).any(axis=1)
        if len(np.unique(ids)) == len(ids):  # of equal vectors the first k can count, and one more where the query itself is among them
            use &= copies(y) <= self.k
        tables, ids = [x[use] for x in tables], ids[use]
        if not len(ids):
            return
        small, size = unit(tables[self.space], False)
        odd = np.isinf(tables[self.space]).any(axis=1)
        b = 0
        while b < len(ids):
            step = min(PIECE, max(PIECE // 8, self.seen), len(ids) - b)
            piece = slice(b, b + step)
            for a in range(0, len(self.ids), QUERIES):
                self.screen(slice(a, min(a + QUERIES, len(self.ids))), [x[piece] for x in tables], ids[piece], small[piece], size[0], odd[piece])
                if self.n_new > max(4 * PAIRS, 4 * self.k * len(self.ids)):
                    self.merge()
            b += step
            self.seen += step
            if self.n_new >= self.k * len(self.ids) or self.n_new and self.seen <= 2 * PIECE:
                self.merge()

    def screen(self, at: slice, tables: list[np.ndarray], ids: np.ndarray, small: np.ndarray, longest: float, odd: np.ndarray) -> None:
        rare = odd.any() or self.odd[at].any()
        with np.errstate(all="ignore"):
            m, n = at.stop - at.start, len(ids)
            score = np.matmul(self.small[at], small.T, out=self.scores[: m * n].reshape(m, n))
            least = self.least[at] / (self.size[at] * longest) - self.slack
            if (least == -np.inf).any():
                if self.exclude_self:
                    score[self.ids[at][:, None] == ids[None, :]] = -np.inf
                if score.shape[1] > self.k and not rare:
                    score[np.isnan(score)] = -np.inf
                    least = np.fmax(least, np.partition(score, -self.k, axis=1)[:, -self.k] - 2 * self.slack)
            if rare:  # infinite numbers
                score[:, odd] = np.inf
                score[self.odd[at]] = np.inf
            least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
            few = np.flatnonzero(score.max(axis=1) >= least)  # most queries have no row in a piece
            found = np.flatnonzero(score[few] >= least[few, None])
        for c in range(0, len(found), PAIRS):
            row, column = np.divmod(found[c : c + PAIRS], score.shape[1])
            row = few[row]
            own = dots(self.tables[self.space][row + at.start], tables[self.space][column])
            keep = (own >= self.least[row + at.start]) & (own > -np.inf)
            if self.exclude_self:
                keep &= self.ids[row + at.start] != ids[column]
            row, column = row[keep] + at.start, column[keep]
            self.new.append((row, ids[column], np.column_stack([own[keep] if s == self.space else dots(x[row], y[column]) for s, (x, y) in enumerate(zip(self.tables, tables, strict=True))])))
            self.n_new += len(row)

    def merge(self) -> None:
        who, what, how = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        short = who.astype(np.uint16) if len(self.ids) <= 1 << 16 else who  # sorted by their digits
        order = np.argsort(-how[:, self.space])
        order = order[np.argsort(short[order], kind="stable")]
        score = how[order, self.space]
        if ((score[1:] == score[:-1]) & (who[order[1:]] == who[order[:-1]])).any():
            order = np.lexsort((what, -how[:, self.space], who))
        who, what, how = who[order], what[order], how[order]
        n = np.bincount(who, minlength=len(self.ids))
        place = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        last = place == self.k - 1
        self.least[who[last]] = how[last, self.space]
        self.kept = who[place < self.k], what[place < self.k], how[place < self.k]
        self.new, self.n_new = [], 0


def united(found: list[Nearest]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the query, id and scores of what is among the k best in some space, once each."""
    for f in found:
        f.merge()
    who, what, how = (np.concatenate(x) for x in zip(*(f.kept for f in found), strict=True))
    if len(found) > 1:
        order = np.lexsort((*how.T, what, who))
        who, what, how = who[order], what[order], how[order]
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1]) | ((how[1:] != how[:-1]) & ~(np.isnan(how[1:]) & np.isnan(how[:-1]))).any(axis=1)
        who, what, how = who[new], what[new], how[new]
    return who, what, how


def table_of(column, d: int) -> np.ndarray:
    """An Arrow column of lists of d numbers; a null list is a row without a number."""
    given = np.asarray(column.is_valid().to_numpy(zero_copy_only=False))
    out, lists = np.full((len(given), d), np.nan), column.drop_null()
    if (np.diff(lists.offsets.to_numpy()) != d).any():
        raise ValueError(f"vectors of {d} numbers are asked for")
    out[given] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return out


def nearest(queries: DataFrame, gallery: DataFrame, spaces: list[str], k: int, exclude_self: bool, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """q, g and the score in each space of all that is among the k best of some space. Exact.

    Queries are dealt to blocks by a hash; a task holds one block, and the gallery passes it in batches. What is shuffled is the queries once and the
    gallery for each block. Nothing passes through the driver but a count and a length. Rows without an id are left out; a null vector has no score.
    """
    spark = prepared(queries.sparkSession)
    queries, gallery = (x.select(F.col(n).cast("long").alias("id"), *spaces).filter("id is not null") for x, n in ((queries, "q"), (gallery, "g")))
    size = queries.select(*(F.size(s).alias(s) for s in spaces))
    dims = [r[s] if (r := size.filter(F.col(s) >= 0).select(s).first()) else 0 for s in spaces]
    rows, tasks = queries.count(), spark.sparkContext.defaultParallelism
    n = max(1, -(-rows * sum(dims) * 8 // block_bytes), min(2 * tasks, -(-rows // 256)))
    columns = ["id", *(c if queries.schema[s].dataType == gallery.schema[s].dataType else c.cast("array<double>") for s in spaces for c in [F.col(s)])]
    left = queries.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("i"), F.lit(0).alias("side"), *columns)
    right = gallery.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.lit(1).alias("side"), *columns)
    names = [f"s{i}" for i in range(len(spaces))]
    dealt = left.toDF("i", "side", "id", *names).unionByName(right.toDF("i", "side", "id", *names)).repartitionById(n, F.col("i")).sortWithinPartitions("i", "side")

    def run(batches):
        import pyarrow as pa

        def result(ids, found):
            who, what, how = united(found)
            for a in range(0, len(who), 10_000):
                part = slice(a, a + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[who[part]]), pa.array(what[part]), *(pa.array(c) for c in how[part].T)], names=["q", "g", *names])

        block, asked, found, ids = None, [], None, None
        for batch in batches:
            key = batch.column("i").to_numpy() * 2 + batch.column("side").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in itertools.pairwise(edges) if len(key) else ():
                i, side = divmod(int(key[a]), 2)
                if i != block:
                    if found:
                        yield from result(ids, found)
                    block, asked, found = i, [], None
                part = batch.slice(a, b - a)
                if side == 0:
                    asked.append((part.column("id").to_numpy(), [table_of(part.column(c), d) for c, d in zip(names, dims, strict=True)]))
                elif asked:
                    if found is None:
                        ids, tables = np.concatenate([x for x, _ in asked]), [np.concatenate(x) for x in zip(*(y for _, y in asked), strict=True)]
                        found = [Nearest(tables, s, ids, k, exclude_self) for s in range(len(names))]
                    own, order = part.column("id").to_numpy(), np.argsort(part.column("id").to_numpy(), kind="stable")
                    tables = [table_of(part.column(c), d)[order] for c, d in zip(names, dims, strict=True)]
                    for f in found:
                        f.add(tables, own[order])
        if found:
            yield from result(ids, found)

    out = dealt.mapInArrow(run, "q long, g long, " + ", ".join(f"{c} double" for c in names))
    return out.select("q", "g", *(F.when(~F.isnan(c), F.col(c)).alias(s) for c, s in zip(names, spaces, strict=True)))


def vector_topk(queries: DataFrame, gallery: DataFrame, k: int, exclude_self: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """q, g, score, rank: the k gallery rows (g, vec) of largest dot product for each query (q, vec). Exact. Rows with a null id or vector are left out."""
    return best(nearest(queries, gallery, ["vec"], k, exclude_self, block_bytes).withColumnRenamed("vec", "score"), k)


def merged_lists(queries: DataFrame, gallery: DataFrame, spaces: list[str], k: int, exclude_self: bool = False) -> DataFrame:
    """q, g and the score in each space of all that is among the k best of some space: the spaces are searched side by side, and a pair is scored in all
    of them where both its vectors are. queries: q and a vector column for each space; gallery: g and the same."""
    return nearest(queries, gallery, spaces, k, exclude_self)


def hybrid_topk(queries: DataFrame, gallery: DataFrame, spaces: list[str], k: int, exclude_self: bool = False) -> DataFrame:
    """q, g, score, rank and a column for each space: the k best of the merged lists by the mean over the spaces."""
    merged = merged_lists(queries, gallery, spaces, k, exclude_self)
    return best(merged.withColumn("score", sum(F.col(s) for s in spaces) / len(spaces)), k)


def accepted_or_rejected(queries: DataFrame, hits: DataFrame, threshold: float) -> DataFrame:
    """q, best, accepted, detail: a query without hits, or whose best score is below the threshold, is rejected as a whole."""
    top = hits.groupBy("q").agg(F.max("score").alias("best"))
    out = queries.select("q").join(top, "q", "left")
    ok = F.coalesce(F.col("best") >= threshold, F.lit(False))
    return out.withColumn("accepted", ok).withColumn("detail", rejection(F.col("best"), threshold))


def rejection(best_score, threshold: float):
    """The text that goes with a rejection."""
    return F.when(best_score.isNull(), "no result").when(best_score < threshold, F.format_string("best %.3f is below %.3f", best_score, F.lit(threshold)))


def group_scores(hits: DataFrame, top_groups: int = 5) -> DataFrame:
    """q, grp, gscore, grank: a group scores as its best hit."""
    scored = hits.groupBy("q", "grp").agg(F.max("score").alias("gscore"))
    order = Window.partitionBy("q").orderBy(F.desc("gscore"), "grp")
    return scored.withColumn("grank", F.row_number().over(order)).filter(F.col("grank") <= top_groups)


def kept_groups(groups: DataFrame, threshold: float, margin: float | None) -> DataFrame:
    """Groups that reach the threshold and lie within the margin of the query's best group."""
    top = F.max("gscore").over(Window.partitionBy("q"))
    near = F.lit(True) if margin is None else F.col("gscore") >= F.col("top") - margin
    return groups.withColumn("top", top).filter((F.col("gscore") >= threshold) & near).drop("top")


#: Members of a group that travel together.
MEMBERS = 4096


def numbered(members: DataFrame) -> DataFrame:
    """grp, g, pos, nth: a group's members by id, counted from 1 as rows and as ids."""
    order = Window.partitionBy("grp").orderBy("g")
    return members.select("grp", "g").filter("grp is not null").withColumns({"pos": F.row_number().over(order), "nth": F.dense_rank().over(order)})


def laid_out(kept: DataFrame, hits: DataFrame, members: DataFrame, exclude_self: bool = False) -> DataFrame:
    """q, grp, gscore, hits, skip, n, before, lead of each kept group with a candidate: its hits (score, g) in order, the places of members that
    don't stand behind them (hits, and the query itself), how many candidates it has, how many stand before, and its first. A row a group, whatever its size."""
    at = numbered(members)
    sizes = at.groupBy("grp").agg(F.count("*").alias("size"), F.min("g").alias("one"), F.min(F.when(F.col("nth") == 2, F.col("g"))).alias("two"))
    found = hits.select("q", "g", F.col("score").alias("hit")).filter("hit is not null")
    if exclude_self:
        found = found.filter("q <> g").unionByName(kept.select("q", F.col("q").alias("g"), F.lit(None).cast("double").alias("hit")).distinct())
    marks = found.join(at.select("grp", "g", "pos"), "g").groupBy("q", "grp").agg(F.collect_list(F.struct((-F.col("hit")).alias("low"), "g", "pos", "hit")).alias("marks"))
    out = kept.join(marks, ["q", "grp"], "left").join(sizes, "grp")
    ordered = F.array_sort(F.filter("marks", lambda m: m["hit"].isNotNull()))
    other = F.when(F.col("one") != F.col("q"), F.col("one")).otherwise(F.col("two")) if exclude_self else F.col("one")
    out = out.withColumn("marks", F.coalesce("marks", F.array().cast(marks.schema["marks"].dataType))).select(
        "q", "grp", "gscore", "grank", "size", F.transform(ordered, lambda m: F.struct(m["hit"].alias("score"), m["g"].alias("g"))).alias("hits"),
        F.array_sort(F.transform("marks", lambda m: m["pos"])).alias("skip"), (F.col("size") - F.size(F.filter("marks", lambda m: m["hit"].isNull()))).alias("n"), other.alias("other"),
    ).filter("n > 0")
    earlier = Window.partitionBy("q").orderBy("grank").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.when(F.size("hits") > 0, F.col("hits")[0]["g"]).otherwise(F.col("other"))
    return out.select("q", "grp", "gscore", "hits", "skip", "n", "size", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), lead.alias("lead"))


def heads(kept: DataFrame, hits: DataFrame, members: DataFrame, exclude_self: bool = False) -> DataFrame:
    """q, grp, n, only, place: of the candidates that expanded gives, how many each group has, its first, and the place of that. No member is joined."""
    out = laid_out(kept, hits, members, exclude_self)
    return out.select("q", "grp", "n", F.col("lead").alias("only"), (F.col("before") + 1).alias("place"))


def expanded(kept: DataFrame, hits: DataFrame, members: DataFrame, exclude_self: bool = False, first: int | None = None, shown: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """q, grp, g, score, retrieved, place: all members (g, grp) of the kept groups, or those at the first places. Members that weren't retrieved stand
    behind the others, with their group's score. shown is applied to scores once a hit and once a group, not once a member.

    Rows are made where they are read: places follow from the places of hits among the members, so neither sort nor shuffle sees a member of a query's group.
    """
    groups = laid_out(kept, hits, members, exclude_self)
    if first is not None:
        groups = groups.filter(F.col("before") < first)
    own = groups.select("q", "grp", "before", F.posexplode("hits").alias("i", "h"))
    own = own.select("q", "grp", F.col("h")["g"].alias("g"), shown(F.col("h")["score"]).alias("score"), F.lit(True).alias("retrieved"), (F.col("before") + F.col("i") + 1).alias("place"))
    own = own if first is None else own.filter(F.col("place") <= first)

    # the rest lies between the marks: of a group's ids in order, those from one mark to the next keep their distance
    at = numbered(members)
    at = at if first is None else at.filter(F.col("nth") <= first + 1)  # as many are enough behind the hits, and one for the query
    tasks = kept.sparkSession.sparkContext.defaultParallelism
    deals, parts = max(16, 2 * tasks), 4 * tasks  # groups may be few, and what is joined is small beside what is made of it: left to itself, Spark puts it into a few tasks
    lists = at.groupBy("grp", F.floor((F.col("pos") - 1) / MEMBERS).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", "g"))).alias("e"))
    lists = lists.select("grp", (F.col("chunk") * MEMBERS).alias("base"), F.transform("e", lambda x: x["g"]).alias("ids"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    dealt = groups.select("q", "grp", shown(F.col("gscore")).alias("gscore"), "skip", "size", (F.col("before") + F.size("hits")).alias("behind"), F.pmod(F.xxhash64("q"), F.lit(deals)).cast("int").alias("deal"))
    edge = lambda j, step: F.when(j < F.size("skip"), F.get("skip", j)).otherwise(F.col("size") + 1) if step else F.when(j > 0, F.get("skip", j - 1)).otherwise(F.lit(0))
    limit = F.lit((1 << 63) - 1) if first is None else F.lit(first) - F.col("behind")
    part = lambda j: F.struct(
        F.greatest(edge(j, 0) + 1, F.col("base") + 1).cast("long").alias("low"),
        F.least(edge(j, 1) - 1, F.col("base") + F.size("ids"), *([] if first is None else [limit + j])).cast("long").alias("high"), j.alias("j"),
    )
    spans = F.filter(F.transform(F.sequence(F.lit(0), F.size("skip")), part), lambda x: x["high"] >= x["low"])
    rest = dealt.repartition(parts, "grp", "deal").join(lists.repartition(parts, "grp", "deal"), ["grp", "deal"]).select("q", "grp", "gscore", "behind", "base", "ids", F.explode(spans).alias("x"))
    rest = rest.select("q", "grp", "gscore", (F.col("behind") + F.col("x")["low"] - F.col("x")["j"]).alias("from"), F.posexplode(F.slice("ids", (F.col("x")["low"] - F.col("base")).cast("int"), (F.col("x")["high"] - F.col("x")["low"] + 1).cast("int"))).alias("i", "g"))
    rest = rest.select("q", "grp", "g", F.col("gscore").alias("score"), F.lit(False).alias("retrieved"), (F.col("from") + F.col("i")).alias("place"))
    return own.unionByName(rest)


def member_lists(rows: DataFrame, member: str, group: str) -> DataFrame:
    """Each row with the ordered list of its group's members. The list is made once a group and joined back."""
    lists = rows.groupBy(group).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return rows.join(lists, group)


def incomplete_groups(found: DataFrame, declared: DataFrame) -> DataFrame:
    """grp of groups whose found members (grp, g) aren't exactly the declared ones, each once."""
    a = found.groupBy("grp").agg(F.array_sort(F.collect_list("g")).alias("have"))
    b = declared.groupBy("grp").agg(F.array_sort(F.collect_set("g")).alias("want"))
    return a.join(b, "grp", "left").filter(~F.col("have").eqNullSafe(F.col("want"))).select("grp")


def margins(hits: DataFrame) -> DataFrame:
    """q, top1, margin: best score, and how far it is ahead of the second."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    return hits.groupBy("q").agg(at(1).alias("top1"), (at(1) - at(2)).alias("margin"))

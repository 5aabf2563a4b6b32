"""Retrieval: scores, ranked lists, fusion, diversification.

Query sets are small next to the corpus and are broadcast only after ``bounded`` has counted them; beyond the bound Spark
picks the join.  Ties are always broken by id, after scores are rounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra import config
from attestra.tables import written

MOST_BROADCAST = 10_000
ITEM_BLOCK, QUERY_BLOCK = 4096, 512  # vectors that one matrix product takes from either side
QUERY_GROUP, TERM_BLOCK = 4096, 1024  # queries that meet a block of items in one group; terms of a sparse product
TOKEN_BLOCK = 512  # documents whose tokens meet those of a fourth as many queries in one product
TOKEN_GROUP, TOKEN_GROUPS = 16_384, 32  # documents, or queries, that a task holds at most, and groups that documents are dealt into at least


def bounded(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; as it is otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def top_k(scored: DataFrame, k: int, query: str = "query_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """The k best items of each query with ``rank``; a window group limit prunes before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(item).asc())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dense_scores(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, item_id, score): exact cosine of every query with every item, from (id, vector) tables.

    Norms are computed once a row; the query side is broadcast when it is small enough.
    """
    unit = lambda df, name: df.select(F.col("id").alias(name), F.col("vector").alias(f"{name}_v"), F.sqrt(dot(F.col("vector"), F.col("vector"))).alias(f"{name}_n"))
    pairs = unit(items, "item_id").join(bounded(unit(queries, "query_id")), F.lit(True))
    norms = F.col("item_id_n") * F.col("query_id_n")
    return pairs.select("query_id", "item_id", F.round(F.when(norms == 0, 0.0).otherwise(dot(F.col("item_id_v"), F.col("query_id_v")) / norms), 6).alias("score"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    flat = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _block_by_block(items: DataFrame, queries: DataFrame, sizes: tuple[int, int], each, schema: str) -> DataFrame:
    """``each`` over every block of items with every block of queries, tables with an ``id``, of about ``sizes`` rows.

    Blocks are dealt by a hash of the id, and a block of either side goes to a group once for each block of the other, so a
    task holds one group at a time, however many rows there are."""
    n, m = (max(1, -(-df.count() // size)) for df, size in zip((items, queries), sizes, strict=True))
    dealt = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = items.withColumn("_item", dealt(n)).withColumn("_query", every(m))
    named = queries.select([F.col(c).alias(c) for c in queries.columns])  # both sides may come from one table, whose columns Spark would confuse
    right = named.withColumn("_query", dealt(m)).withColumn("_item", every(n))
    return left.groupBy("_item", "_query").cogroup(right.groupBy("_item", "_query")).applyInArrow(each, schema)


def _best_rows(items: pa.Table, queries: pa.Table, score, k: int) -> pa.Table:
    """(query_id, item_id, score) of the k best items of each query; ``score(a, b)`` has a row for each of the queries a to b."""
    order = np.argsort(items.column("id").to_numpy(), kind="stable")
    names, asked = items.column("id").to_numpy()[order], queries.column("id").to_numpy()
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(asked) if len(names) else 0, QUERY_BLOCK):
        for query, row in zip(asked[a : a + QUERY_BLOCK], score(a, a + QUERY_BLOCK)[:, order], strict=True):
            pick = best_of(names, row, k)
            pick = pick[row[pick] > -np.inf]
            out.append((np.full(len(pick), query), names[pick], row[pick]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, np.float64)]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "item_id", "score"])


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by id; ``ids`` ascend."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def dense_top_k(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, score, rank): the k items of greatest cosine of each query, exact, from (id, vector) tables.

    Blocks of items meet blocks of queries, as matrix products that leave k rows a query and block, so what is shuffled
    is vectors and k rows a query and block, never the pairs, and a task holds one group.  Scores are rounded to six
    digits, ties go by id, a vector of norm 0 scores 0.  Vectors have one length; null ones are left out.
    """

    def unit(column):
        body = _matrix(column)
        norm = np.sqrt((body * body).sum(1, keepdims=True))
        return body / np.where(norm == 0, 1, norm)

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        x, q = unit(left.column("vector")), unit(right.column("vector"))
        return _best_rows(left, right, lambda a, b: np.round(q[a:b] @ x.T, 6), k)

    known = lambda df: df.filter(F.col("vector").isNotNull() & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "vector")
    return top_k(_block_by_block(known(items), known(queries), (ITEM_BLOCK, QUERY_GROUP), each, "query_id long, item_id long, score double"), k)


def sparse_top_k(postings: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, score, rank): ``top_k`` of ``sparse_scores``, exact, without a row for each pair.

    Items and queries become rows of terms and weights; blocks of either meet as matrix products over the terms that the
    queries have, a part of the terms at a time.  Items that share no term with a query are none of its items.  Ids are
    long; rows with nulls are left out.
    """

    def matrix(rows: np.ndarray, codes: np.ndarray, weights: np.ndarray, n: int, start: int, width: int):
        own = (codes >= start) & (codes < start + width)
        at, has = np.zeros((n, width)), np.zeros((n, width), np.float32)
        np.add.at(at, (rows[own], codes[own] - start), weights[own])
        has[rows[own], codes[own] - start] = 1
        return at, has

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        (l_terms, l_weights, l_sizes), (r_terms, r_weights, r_sizes) = (
            (c["terms"].flatten(), c["weights"].flatten().to_numpy(zero_copy_only=False).astype(np.float64), pc.list_value_length(c["terms"]).to_numpy(zero_copy_only=False))
            for c in ({name: pa.concat_arrays(t.column(name).chunks) if t.num_rows else pa.array([], t.schema.field(name).type) for name in ("terms", "weights")} for t in (left, right))
        )
        known = pc.unique(r_terms)
        place = lambda x: pc.fill_null(pc.index_in(x, known), -1).to_numpy(zero_copy_only=False)
        l_codes, r_codes = place(l_terms), place(r_terms)
        l_rows, r_rows = np.repeat(np.arange(len(l_sizes)), l_sizes), np.repeat(np.arange(len(r_sizes)), r_sizes)
        width = min(len(known), TERM_BLOCK) or 1
        parts = range(0, len(known), width)
        held = matrix(l_rows, l_codes, l_weights, left.num_rows, 0, width) if len(parts) == 1 else None

        def score(a, b):
            b = min(b, right.num_rows)
            own = (r_rows >= a) & (r_rows < b)
            total, shared = np.zeros((b - a, left.num_rows)), np.zeros((b - a, left.num_rows), np.float32)
            for start in parts:
                x, has = held or matrix(l_rows, l_codes, l_weights, left.num_rows, start, width)
                q, asks = matrix(r_rows[own] - a, r_codes[own], r_weights[own], b - a, start, width)
                total += q @ x.T
                shared += asks @ has.T
            return np.where(shared > 0, np.round(total, 6), -np.inf)

        return _best_rows(left, right, score, k)

    def packed(df, name):
        rows = df.select(F.col(name).cast("long").alias("id"), "term", F.col("weight").cast("double").alias("weight")).dropna()
        lists = rows.groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("p"))
        return lists.select("id", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights"))

    return top_k(_block_by_block(packed(postings, "item_id"), packed(terms, "query_id"), (ITEM_BLOCK, QUERY_GROUP), each, "query_id long, item_id long, score double"), k)


def nearest_numbers(items: DataFrame, asked: Column, k: int) -> DataFrame:
    """(query_id, item_id, score, rank): the k ids nearest to each id that is ``asked``, itself included, ties by id; score is minus
    the distance.  ``items`` has ``item_id``, whole numbers.

    Ids are ranked over the whole table; the k nearest are among the k before and after, so blocks of k ranks meet their
    neighbours only."""
    rows = written(items.filter(F.col("item_id").isNotNull()).repartitionByRange("item_id").select("item_id", F.spark_partition_id().alias("_part")), "numbers-in-order")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("item_id"))
    placed = rows.withColumn("_nth", nth).join(F.broadcast(before), "_part").select("item_id", F.floor((F.col("_before") + F.col("_nth") - 1) / k).alias("_block"))
    queries = placed.filter(asked).select(F.col("item_id").alias("query_id"), F.explode(F.array(*[F.col("_block") + i for i in (-1, 0, 1)])).alias("_block"))
    return top_k(queries.join(placed, "_block").select("query_id", "item_id", (-F.abs(F.col("item_id") - F.col("query_id"))).alias("score")), k)


def sparse_scores(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, item_id, score) from postings (item_id, term, weight) and query terms (query_id, term, weight)."""
    q = terms.select("query_id", "term", F.col("weight").alias("q_weight"))
    return postings.join(q, "term").groupBy("query_id", "item_id").agg(F.round(F.sum(F.col("weight") * F.col("q_weight")), 6).alias("score"))


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = config.RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over ranked lists of (query_id, item_id, rank)."""
    rows = lists[0].select("query_id", "item_id", "rank")
    for more in lists[1:]:
        rows = rows.unionByName(more.select("query_id", "item_id", "rank"))
    return rows.groupBy("query_id", "item_id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"))


def rank_visuals(candidates: DataFrame, score: Column) -> DataFrame:
    """``candidates`` (query_id, item_id, score, ...) with ``visual_rank``: the place of each among its query's visuals, null for
    those whose ``visual_score`` is null.  Equal ones go by their relevance, then by id."""
    rows = candidates.withColumn("_v", score)
    order = Window.partitionBy("query_id", F.col("_v").isNull()).orderBy(F.col("_v").desc(), F.col("score").desc(), F.col("item_id").asc())
    return rows.withColumn("visual_rank", F.when(F.col("_v").isNotNull(), F.row_number().over(order))).drop("_v")


def candidate_gate(fused: DataFrame, most: int = config.FUSION_CANDIDATES) -> DataFrame:
    """The ``most`` best fused items of each query (query_id, item_id, score, visual_rank) with ``slot``.

    The first visual takes the last slot if it is beyond, whatever other visuals are inside, so that the gate keeps its
    size; ``visual_rank`` is null for items that the question does not call for."""
    query = Window.partitionBy("query_id")
    ranked = fused.withColumn("rank", F.row_number().over(query.orderBy(F.col("score").desc(), F.col("item_id").asc())))
    best = F.min(F.when(F.col("visual_rank") == 1, F.col("rank"))).over(query)
    beyond = F.coalesce(F.col("best") > most, F.lit(False))
    kept = (F.col("rank") < most) | ((F.col("rank") == most) & ~beyond) | (beyond & (F.col("rank") == F.col("best")))
    return ranked.withColumn("best", best).filter(kept).withColumn("slot", F.least("rank", F.lit(most))).drop("best", "rank", "visual_rank")


def rerank(gate: DataFrame, tokens: DataFrame, k: int = config.RRF_K) -> DataFrame:
    """Gate rows in the order of MaxSim alone, with reciprocal scores: (query_id, item_id, max_sim, rank, score).

    ``tokens`` has (id, tokens array<array>); it is joined by key, so only pairs of the gate are scored."""
    asked = tokens.select(F.col("id").alias("query_id"), F.col("tokens").alias("_q"))
    items = tokens.select(F.col("id").alias("item_id"), F.col("tokens").alias("_d"))
    best = F.transform("_q", lambda q: F.array_max(F.transform("_d", lambda t: dot(t, q))))
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size("_q")
    scored = gate.select("query_id", "item_id").join(asked, "query_id").join(items, "item_id").select("query_id", "item_id", F.round(mean, 6).alias("max_sim"))
    order = Window.partitionBy("query_id").orderBy(F.col("max_sim").desc(), F.col("item_id").asc())
    return scored.withColumn("rank", F.row_number().over(order)).withColumn("score", F.round(1.0 / (F.lit(k) + F.col("rank")), 9))


def multi_query_fusion(lists: DataFrame, request: str, k: int = config.RRF_K) -> DataFrame:
    """(request, item_id, score, rank): reciprocal ranks summed over the final lists of a request's queries."""
    fused = lists.groupBy(request, "item_id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"))
    order = Window.partitionBy(request).orderBy(F.col("score").desc(), F.col("item_id").asc())
    return fused.withColumn("rank", F.row_number().over(order))


def reserved_visuals(ranked: DataFrame, request: str, most: int = 2) -> DataFrame:
    """(request, item_id, place): the first visual of each query, ``most`` of a request at most.

    ``ranked``: request, query_id, item_id, visual_rank, explicit (whether the query names a table or figure).  Visuals of explicit
    queries come first, in the order of the queries; the others by how many queries they are first for, then by id."""
    first = ranked.filter(F.col("visual_rank") == 1)
    told = F.min(F.when(F.coalesce("explicit", F.lit(False)), F.col("query_id")))
    each = first.groupBy(request, "item_id").agg(told.alias("told"), F.count(F.lit(1)).alias("times"))
    order = Window.partitionBy(request).orderBy(F.col("told").asc_nulls_last(), F.col("times").desc(), F.col("item_id").asc())
    return each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select(request, "item_id", "place")


def reserve(selected: DataFrame, reserved: DataFrame) -> DataFrame:
    """``selected`` (query_id, item_id, rank) with the ``reserved`` items (query_id, item_id, place) a query lacks.

    They take the places of the last items that are not reserved and come after the rest, in the order of ``place``;
    a selection that holds only reserved items does not grow."""
    marked = selected.join(reserved.select("query_id", "item_id", F.lit(True).alias("held")), ["query_id", "item_id"], "left")
    free = F.coalesce(F.col("held"), F.lit(False)) == F.lit(False)
    missing = reserved.join(selected, ["query_id", "item_id"], "left_anti")
    wanted = missing.groupBy("query_id").agg(F.count("*").alias("wanted"))
    tail = Window.partitionBy("query_id").orderBy(F.col("rank").desc())
    later = F.sum(free.cast("int")).over(tail.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = marked.withColumn("free", free).withColumn("later", later).join(wanted, "query_id", "left")
    kept = ranked.filter(~F.col("free") | (F.col("later") > F.coalesce("wanted", F.lit(0)))).select("query_id", "item_id", F.lit(0).alias("new"), F.col("rank").alias("at"))
    room = ranked.groupBy("query_id").agg(F.sum(F.col("free").cast("int")).alias("room"))
    added = missing.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).join(room, "query_id").filter("n <= room")
    both = kept.unionByName(added.select("query_id", "item_id", F.lit(1).alias("new"), F.col("n").alias("at")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("new", "at"))).drop("new", "at")


def max_sim(doc_tokens: DataFrame, query_tokens: DataFrame) -> DataFrame:
    """(query_id, item_id, score): mean over query tokens of the best dot product with a document's tokens; tables (id, pos, vector).

    Every pair of a query and a document is scored.  Large groups of documents meet large groups of queries, so few copies of
    either are shuffled; a task holds the vectors of one group of each and hands on its pairs product by product.  Scores are
    rounded to six digits.  Vectors have one length; null ones are left out."""
    ids = {name: df.schema["id"].dataType.simpleString() for name, df in (("query_id", query_tokens), ("item_id", doc_tokens))}

    def tokens(rows: pa.Table):
        """Vectors in the order of ids and places, and where each place and each id begins, the end included."""
        lists = pa.concat_arrays(rows.column("t").chunks)
        flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
        starts = np.append(0, ends)
        pos = flat.field("pos").to_numpy(zero_copy_only=False)
        new = np.append(True, pos[1:] != pos[:-1])
        new[starts[:-1]] = True
        return _matrix(pa.chunked_array([flat.field("vector")])), np.append(np.flatnonzero(new), len(pos)), starts

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        left, right = table.filter(pc.invert(table.column("_asked"))), table.filter(table.column("_asked"))
        if not left.num_rows or not right.num_rows:
            return
        sizes = pc.list_value_length(left.column("t")).to_numpy()
        left = left.take(pa.array(np.argsort(sizes, kind="stable")))  # as many tokens in each document of a product
        (d, _, docs), (q, places, queries) = tokens(left), tokens(right)
        sizes, asked = np.diff(docs), max(1, TOKEN_BLOCK // 4)
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1), len(sizes)]
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            for a in range(first, last, TOKEN_BLOCK):
                b = min(a + TOKEN_BLOCK, last)
                nth = [np.ascontiguousarray(x.T) for x in d[docs[a] : docs[b]].reshape(b - a, sizes[a], -1).transpose(1, 0, 2)]
                items = left.column("item_id").take(pa.array(np.tile(np.arange(a, b), min(asked, right.num_rows)))).combine_chunks()
                for x in range(0, right.num_rows, asked):
                    y = min(x + asked, right.num_rows)
                    own = q[queries[x] : queries[y]]
                    best = own @ nth[0]
                    for other in nth[1:]:
                        np.maximum(best, own @ other, out=best)
                    at = places[np.searchsorted(places, queries[x]) : np.searchsorted(places, queries[y])]
                    if len(at) < len(own):
                        best = np.maximum.reduceat(best, at - queries[x], axis=0)
                    starts = np.searchsorted(at, queries[x:y])
                    scores = np.add.reduceat(best, starts, axis=0) / np.diff(np.append(starts, len(at)))[:, None]
                    names = right.column("query_id").take(pa.array(np.repeat(np.arange(x, y), b - a))).combine_chunks()
                    yield pa.RecordBatch.from_arrays([names, items[: len(names)], pa.array(np.round(scores, 6).ravel())], names=["query_id", "item_id", "score"])

    packed = lambda df: df.filter(F.col("vector").isNotNull()).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "vector"))).alias("t"))
    whole = lambda n, size: max(1, -(-n // size))
    items, queries = packed(doc_tokens), packed(query_tokens)
    n, m = items.count(), whole(queries.count(), TOKEN_GROUP)
    n = max(whole(n, TOKEN_GROUP), min(whole(n, TOKEN_BLOCK), TOKEN_GROUPS))

    def side(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        """Each row with the group it is dealt to, once for each group of the other side."""
        names = [(F.col("id") if f"{own}_id" == name else F.lit(None).cast(kind)).alias(name) for name, kind in ids.items()]
        return df.select(F.lit(own == "query").alias("_asked"), *names, "t", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(f"_{own}"), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(f"_{other}"))

    both = side(items, "item", n, "query", m).unionByName(side(queries, "query", m, "item", n))
    grouped = both.withColumn("_group", F.col("_item") * m + F.col("_query")).drop("_item", "_query").repartitionById(n * m, F.col("_group"))
    return grouped.groupBy("_group").applyInArrow(each, f"query_id {ids['query_id']}, item_id {ids['item_id']}, score double")


def mmr(candidates: DataFrame, k: int, lam: float = config.MMR_LAMBDA) -> DataFrame:
    """Greedy maximal marginal relevance over each query's candidates (query_id, item_id, score, vector).

    A query's candidates are bounded by the fusion gate; they are folded in one expression.  Ties: relevance, then id.
    """
    packed = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "score", "vector"))).alias("c"), F.max("score").alias("top"))

    def value(state, x):
        redundancy = F.coalesce(F.array_max(F.transform(state, lambda s: F.round(cosine(s["vector"], x["vector"]), 6))), F.lit(0.0))
        return F.round(F.lit(lam) * x["score"] / F.col("top") - F.lit(1 - lam) * redundancy, 9)

    def step(state, _):
        chosen = F.transform(state, lambda s: s["item_id"])
        left = F.filter(F.col("c"), lambda x: ~F.array_contains(chosen, x["item_id"]))
        ranked = F.transform(left, lambda x: F.struct((-value(state, x)).alias("m"), (-x["score"]).alias("r"), x["item_id"].alias("item_id"), x["score"].alias("score"), x["vector"].alias("vector")))
        best = F.array_min(ranked)
        pick = F.struct(best["item_id"].alias("item_id"), best["score"].alias("score"), best["vector"].alias("vector"))
        return F.when(F.size(left) > 0, F.concat(state, F.array(pick))).otherwise(state)

    kind = candidates.select("item_id", "score", "vector").schema.simpleString()
    out = packed.select("query_id", F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array().cast(f"array<{kind}>"), step).alias("chosen"))
    return out.select("query_id", F.posexplode("chosen").alias("pos", "x")).select("query_id", F.col("x.item_id").alias("item_id"), (F.col("pos") + 1).alias("rank"))


def retrieval_metrics(hits: DataFrame, golden: DataFrame, k: int = 10) -> DataFrame:
    """recall and nDCG at k by query: hits (query_id, item_id, rank), golden (query_id, item_id)."""
    found = golden.join(hits.filter(F.col("rank") <= k), ["query_id", "item_id"], "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.count("*"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    gain = F.coalesce(F.sum(F.when(F.col("rank").isNotNull(), 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0))
    return found.groupBy("query_id").agg(F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("recall"), F.round(gain / ideal, 6).alias("ndcg"))


def label_metrics(hits: DataFrame, items: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``retrieval_metrics`` where the golden items of a query (query_id, label) are all ``items`` (item_id, label) of its label.

    Labels are counted and only hits are looked up, so the pairs are never made; ids are unique, a null label has no items."""
    sizes = items.groupBy("label").agg(F.count("*").alias("n"))
    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    found = hits.filter(F.col("rank") <= k).join(queries, "query_id").join(items, ["item_id", "label"]).groupBy("query_id").agg(F.count("*").alias("found"), F.sum(gain).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    rows = queries.join(sizes, "label").join(found, "query_id", "left")
    return rows.select("query_id", F.round(F.coalesce("found", F.lit(0)) / F.col("n"), 6).alias("recall"), F.round(F.coalesce("gain", F.lit(0.0)) / ideal, 6).alias("ndcg"))

"""Retrievers: for all queries at once, the best chunks by overlap, Jaccard, BM25, vectors or concept graph.

Queries are rows (query_id, query), results rows (query_id, chunk_id, score, rank). Equal scores rank by chunk_id, descending.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from veriframe.functions import text as T
from veriframe.functions.vectors import cosine, norm
from veriframe.operators import products
from veriframe.operators.chunking import document_frequency, exploded, tokenised
from veriframe.operators.fuzzy import expanded
from veriframe.operators.joins import broadcast_blocks, broadcast_if_small, is_small
from veriframe.operators.patterns import contained
from veriframe.operators.scan import best_by_bm25, counted, token_lines
from veriframe.sources.shared import cut

DECAY = 0.8
FALLBACK_FACTOR = 0.9
#: What bounds of scores may be off by rounding.
SLACK = 1e-6
#: A score above a rounded one by at most this ranks with it.
SAME_RANK = 4e-10
#: Queries of a block that meets all rows of the other side.
BLOCK_ROWS = 10_000
#: Vectors of a block that meets such a block as one matrix product.
BLOCK_VECTORS = 20_000
#: Lengths of vectors between which no square or product leaves the range of doubles.
SAFE_NORMS = (1e-100, 1e100)
#: Parts of a concept's chunks that are joined one by one where the other side is too large for a broadcast.
CONCEPT_PARTS = 64
#: Tokens that a plan may name, so that a scan gives out no others.
PLAN_TOKENS = 5_000


def top_k(scored: DataFrame, k: int, score: str | Column = "score", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best rows of each query with their rank; partial group limits prune before the shuffle."""
    key = F.col(score) if isinstance(score, str) else score
    order = Window.partitionBy(*by).orderBy(T.rank_key(key).desc(), F.desc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _asked(queries: DataFrame, words: DataFrame, weight: Column) -> DataFrame:
    """(query_id, token, place, earlier, later, n_query, n_known, weights): a row per distinct query token that some chunk has, the rarest first.

    ``words`` is (query_id, token, n_query, df, ...). earlier and later are the query's tokens on either side of place, weights their
    ``weight`` from place on.
    """
    entry = F.struct("df", "token", weight.alias("weight"))
    listed = words.groupBy("query_id", "n_query").agg(F.sort_array(F.collect_list(entry)).alias("known"))
    rows = listed.select("query_id", "n_query", "known", F.posexplode("known").alias("place", "own"))
    names = F.transform("known", lambda x: x["token"])
    return rows.select(
        "query_id",
        F.col("own.token").alias("token"),
        "place",
        F.slice(names, F.lit(1), F.col("place")).alias("earlier"),
        F.slice(names, F.col("place") + 2, F.size("known")).alias("later"),
        "n_query",
        F.size("known").alias("n_known"),
        F.slice("known", F.col("place") + 1, F.size("known")).alias("weights"),
    )


class Search(NamedTuple):
    """How pairs are ranked: a pair's ``score`` from its value, what bounds the scores at a query's place (``best``), and what bounds a pair's there (``reach``)."""

    score: Callable[[Column], Column]
    best: Column
    reach: Column


def _best(asked: DataFrame, documents: DataFrame, k: int, value: Column, searches: dict[str, Search], limited: bool = False) -> DataFrame:
    """(kind, query_id, chunk_id, score, rank): the k best chunks of each query by each of ``searches``, in two rounds: chunks with a query's rarest token,
    then those that only have others.

    ``documents`` is (chunk_id, tokens, ...), where tokens are distinct and may lack those that no query asks for; if they do (``limited``), joins find a round's tokens faster than a filter.
    A chunk's tokens are all in its row, so a pair is met there once, at the first of the tokens that it shares, and its ``value`` serves all searches: nothing is
    counted across rows, and a task passes on k pairs a query. In the second round what can't come before the k-th of the first, by score and then id, goes
    before anything is computed, by its bound: most pairs of common words; what is left goes by its score, before anything is sorted.
    """
    new, by = ~F.arrays_overlap("earlier", "tokens"), ("kind", "query_id")

    def met(rows: DataFrame, possible: Column, beats: Callable[[str, Column], Column]) -> DataFrame:
        each = documents.withColumn("each", F.col("tokens") if limited else _known(F.col("tokens"), rows))
        found = exploded(each, "each", "token").join(broadcast_if_small(rows), "token").filter(possible).filter(new)
        scores = [F.when(beats(kind, x.score(F.col("value"))), F.struct(F.lit(kind).alias("kind"), x.score(F.col("value")).alias("score"))) for kind, x in searches.items()]
        pairs = exploded(found.withColumn("value", value).select("query_id", "chunk_id", F.array(*scores).alias("scored")), "scored", "pair")
        return top_k(pairs.select("pair.kind", "query_id", "chunk_id", "pair.score"), k, by=by).drop("rank")

    first = cut(met(asked.filter("place = 0"), F.lit(True), lambda *_: F.lit(True)))
    own = {kind: F.when(F.col("kind") == kind, F.struct(T.rank_key(F.col("score")).alias("score"), "chunk_id")) for kind in searches}
    least = first.groupBy("query_id").agg(*(F.when(F.count(x) == k, F.min(x)).alias(f"least_{kind}") for kind, x in own.items()))

    def some(test: Callable[[str, Column], Column]) -> Column:
        return reduce(Column.__or__, (F.col(f"least_{kind}").isNull() | test(kind, F.col(f"least_{kind}.score")) for kind in searches))

    def later(kind: str) -> Column:
        return F.col("chunk_id") > F.col(f"least_{kind}.chunk_id")

    def better(kind: str, least: Column) -> Column:
        reach = searches[kind].reach
        return (reach > least + SAME_RANK) | (reach >= least - SLACK) & later(kind)

    def beats(kind: str, score: Column) -> Column:
        least, key = F.col(f"least_{kind}.score"), T.rank_key(score)
        return least.isNull() | (score > least + SLACK) | (score >= least - SLACK) & ((key > least) | (key == least) & later(kind))

    rest = cut(asked.filter("place > 0").join(least, "query_id", "left").filter(some(lambda kind, x: searches[kind].best >= x - SLACK)))
    return top_k(first.unionByName(met(rest, some(better), beats)), k, by=by)


def _known(tokens: Column, rows: DataFrame) -> Column:
    """``tokens`` that ``rows`` ask for, if those are few enough to be part of the plan; else all, and the join finds them."""
    names = [r["token"] for r in rows.select("token").distinct().limit(PLAN_TOKENS + 1).collect()]
    return F.filter(tokens, lambda t: t.isin(names)) if len(names) <= PLAN_TOKENS else tokens


def _frequencies(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """(token, df) of the tokens of ``wanted``; no others leave the scan."""
    present = exploded(terms.select(_known(F.array_distinct("all"), wanted).alias("tokens")), "tokens", "token")
    return document_frequency(present.join(broadcast_if_small(wanted.select("token").distinct()), "token", "left_semi"))


class Asked(NamedTuple):
    """What the lexical and the Jaccard search ask for, and (chunk_id, n_tokens, tokens): of every chunk how many distinct tokens it has, and those asked for."""

    words: DataFrame
    documents: DataFrame


def asked_tokens(queries: DataFrame, terms: DataFrame) -> Asked:
    """Made once, it serves both searches, which then read no other token; ``terms`` is read once and needn't be stored."""
    words = cut(queries.select("query_id", T.tokens(F.col("query")).alias("tokens")).select("query_id", F.size("tokens").alias("n_query"), F.explode("tokens").alias("token")))
    distinct = terms.select("chunk_id", F.array_distinct("all").alias("tokens"))
    documents = cut(distinct.select("chunk_id", F.size("tokens").alias("n_tokens"), _known(F.col("tokens"), words).alias("tokens"))).filter(F.size("tokens") > 0)
    present = exploded(documents.select("tokens"), "tokens", "token")
    frequency = document_frequency(present.join(broadcast_if_small(words.select("token").distinct()), "token", "left_semi"))
    return Asked(cut(_asked(queries, words.join(frequency, "token"), F.lit(1.0))), documents)


def _shared() -> Column:
    """Tokens that a pair shares; it is scored at the first of them."""
    return 1 + F.size(F.array_intersect("later", "tokens"))


def _most() -> Column:
    """Tokens that a query can share from a place on."""
    return F.col("n_known") - F.col("place")


def _within() -> Column:
    """Those that it can share with a chunk, which has so many of those asked for."""
    return F.least(_most(), F.size("tokens"))


def _lexical() -> Search:
    return Search(lambda n: n.cast("double"), _most(), _within())


def _jaccard() -> Search:
    reach = _within() / (F.col("n_query") + F.col("n_tokens") - _within())
    return Search(lambda n: n / (F.col("n_query") + F.col("n_tokens") - n), _most() / F.col("n_query"), reach)


def overlap_searches(queries: DataFrame, terms: DataFrame, k: int) -> dict[str, DataFrame]:
    """The results of ``lexical_top_k`` and ``jaccard_top_k``, by "lexical" and "jaccard", stored; every pair is met once for both."""
    asked, searches = asked_tokens(queries, terms), {"lexical": _lexical(), "jaccard": _jaccard()}
    found = cut(_best(asked.words, asked.documents, k, _shared(), searches, limited=True))
    return {kind: found.filter(F.col("kind") == kind).drop("kind") for kind in searches}


def lexical_top_k(queries: DataFrame, terms: DataFrame, k: int, asked: Asked | None = None) -> DataFrame:
    """Ranked by the number of distinct tokens shared; ``terms`` is (chunk_id, all) as ``chunking.tokenised`` gives it."""
    asked = asked or asked_tokens(queries, terms)
    return _best(asked.words, asked.documents, k, _shared(), {"lexical": _lexical()}, limited=True).drop("kind")


def jaccard_top_k(queries: DataFrame, terms: DataFrame, k: int, asked: Asked | None = None) -> DataFrame:
    """Ranked by the Jaccard similarity of the distinct tokens."""
    asked = asked or asked_tokens(queries, terms)
    return _best(asked.words, asked.documents, k, _shared(), {"jaccard": _jaccard()}, limited=True).drop("kind")


def bm25_top_k(queries: DataFrame, terms: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, fuzzy: bool = False, analyse: Callable[[Column], Column] = T.all_tokens) -> DataFrame:
    """BM25 over ``terms`` (chunk_id, all), or over chunks (chunk_id, text), which are then tokenised here; ``fuzzy`` also matches terms within one edit (from 3 letters) or two (from 6).

    ``analyse`` turns the queries into tokens as it did the chunks, for instance ``stemming.english_tokens``. Document
    frequencies are counted for asked tokens only (for all with ``fuzzy``).
    """
    wanted = cut(queries.select("query_id", F.explode(F.array_distinct(analyse(F.col("query")))).alias("token")))
    if fuzzy:
        lines = cut(token_lines(terms, analyse))
        counts = cut(counted(lines))
        totals, frequency = counts.agg(F.sum("chunks").alias("chunks"), (F.sum("size") / F.nullif(F.sum("sized"), F.lit(0))).alias("avg_dl")), counts.filter("token IS NOT NULL").select("token", "df")
        wanted = expanded(wanted, frequency)
    else:
        terms = terms if "all" in terms.columns else tokenised(terms, analyse)
        totals, frequency = terms.agg(F.count("*").alias("chunks"), F.avg(F.size("all")).alias("avg_dl")), _frequencies(wanted, terms)
    totals = totals.first()
    chunks, avg_dl = totals["chunks"] or 0, float(totals["avg_dl"] or 0)
    idf = F.log(1 + (chunks - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if fuzzy:
        return top_k(best_by_bm25(lines, wanted.join(frequency, "token").withColumn("weight", idf), k, avg_dl or 1.0, k1, b), k)
    asked = cut(_asked(queries, wanted.join(frequency, "token").withColumn("n_query", F.lit(0)), idf))
    long = k1 * (1 - b + b * F.size("all") / avg_dl) if avg_dl else F.lit(0.0)

    def part(t: Column) -> Column:
        return T.once(F.size(F.filter("all", lambda x: x == t["token"])), lambda tf: t["weight"] * tf * (k1 + 1) / (tf + long))

    score = F.aggregate("weights", F.lit(0.0), lambda s, t: s + part(t))
    reach = F.aggregate("weights", F.lit(0.0), lambda s, t: s + t["weight"] * (k1 + 1))
    return _best(asked, terms.select("chunk_id", "all", F.array_distinct("all").alias("tokens")), k, score, {"bm25": Search(lambda v: v, reach, reach)}).drop("kind")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact cosine search: (query_id, embedding) against (chunk_id, embedding), every query with every vector, as products of blocks.

    Pairs whose vectors' lengths leave SAFE_NORMS (not finite ones among them) are scored one by one.
    """
    asked, rows = (_normed(df) for df in (queries.select("query_id", "embedding"), vectors.select("chunk_id", "embedding")))
    plain = F.col("norm").between(*SAFE_NORMS)
    odd = ~plain & (F.col("norm") != 0)
    parts = [_block_products(asked.filter(plain), rows.filter(plain), k)]
    for some, others in ((asked.filter(odd), rows), (asked.filter(~odd), rows.filter(odd))):
        if not some.isEmpty() and not others.isEmpty():
            parts += _pairwise(some, others, k)
    return top_k(_union(parts), k)


def _normed(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", F.col("embedding").cast("array<double>")).withColumn("norm", norm(F.col("embedding")))


def _pairwise(queries: DataFrame, vectors: DataFrame, k: int) -> list[DataFrame]:
    blocks = broadcast_blocks(queries.select("query_id", F.col("embedding").alias("asked")), "query_id", BLOCK_ROWS)
    scored = [vectors.join(block).select("query_id", "chunk_id", cosine(F.col("asked"), F.col("embedding")).alias("score")) for block in blocks]
    return [top_k(s.filter(F.col("score").isNotNull()), k).drop("rank") for s in scored]


def _block_products(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score): for each block of vectors and queries all pairs that can be among the k best of a query."""
    sizes = {side: -(-df.count() // most) or 1 for side, df, most in (("q", queries, BLOCK_ROWS), ("v", vectors, BLOCK_VECTORS))}

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        # a row's own block, with each block of the other side
        every = F.explode(F.sequence(F.lit(0), F.lit(sizes[other] - 1))).alias(other)
        return df.select(key, "embedding", F.size("embedding").alias("size"), F.pmod(F.xxhash64(key), F.lit(sizes[own])).cast("int").alias(own), every).groupBy("size", "q", "v")

    schema = StructType([queries.schema["query_id"], vectors.schema["chunk_id"], StructField("score", DoubleType())])
    return dealt(queries, "query_id", "q", "v").cogroup(dealt(vectors, "chunk_id", "v", "q")).applyInArrow(products.best_of(k), schema)


def match_concepts(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, concept): a concept is named in the query, or holds one of its tokens.

    One automaton over the concepts runs over the queries, one over the queries' tokens over the distinct concepts: no query meets every concept.
    """
    concepts = cut(edges.select("concept").distinct())
    named = contained(queries.select(F.col("query_id").alias("id"), F.lower("query").alias("text")), concepts.withColumnRenamed("concept", "pattern"))
    asked = cut(exploded(queries.select("query_id", T.tokens(F.col("query")).alias("tokens")), "tokens", "token"))
    holding = contained(concepts.select(F.col("concept").alias("id"), F.col("concept").alias("text")), asked.withColumnRenamed("token", "pattern"))
    held = holding.toDF("concept", "token").join(asked, "token").select("query_id", "concept")
    return named.toDF("query_id", "concept").unionByName(held).distinct()


def concept_hops(queries: DataFrame, edges: DataFrame, max_hops: int = 3, named: DataFrame | None = None) -> DataFrame:
    """(query_id, concept, hop): the first hop at which a query's traversal reaches each concept's chunks.

    Chunks are neighbours through a shared concept, so the search runs over concepts that occur together, not
    over chunks: a concept of very many chunks costs no more than any other. ``named`` may be the queries' concepts, stored.
    """
    reached = (named or cut(match_concepts(queries, edges))).withColumn("hop", F.lit(0))
    if max_hops > 1:
        a, b = edges.select("chunk_id", F.col("concept").alias("concept")), edges.select("chunk_id", F.col("concept").alias("beside"))
        together = cut(a.join(b, "chunk_id").filter("concept <> beside").select("concept", "beside").distinct())
        front = reached
        for hop in range(1, max_hops):
            front = front.join(together, "concept").select("query_id", F.col("beside").alias("concept"), F.lit(hop).alias("hop")).distinct()
            reached = reached.unionByName(front)
    return reached.groupBy("query_id", "concept").agg(F.min("hop").alias("hop"))


def graph_candidates(queries: DataFrame, edges: DataFrame, k: int | None, max_hops: int = 3, decay: float = DECAY, step: int = 1, named: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score): the chunks that can be among a query's k best, at decay ** (step * hop).

    All chunks of a concept score alike, so beyond the k greatest ids of a concept none can be needed (k None: all are
    given). ``step`` 2 counts path lengths of a bipartite graph of chunks and concepts instead of hops between chunks.
    """
    hops, first = concept_hops(queries, edges, max_hops, named), edges.select("concept", "chunk_id")
    if k is not None:
        order = Window.partitionBy("concept").orderBy(F.desc("chunk_id"))
        hits = hops.join(first.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k), "concept")
    else:
        hits = _reached(hops, first)
    return hits.groupBy("query_id", "chunk_id").agg(F.max(F.pow(F.lit(decay), F.col("hop") * step)).alias("score"))


def _reached(hops: DataFrame, edges: DataFrame) -> DataFrame:
    """All chunks of the concepts of ``hops``. Edges are dealt by chunk and not by concept: no task has all chunks of a concept, and a pair's rows are in one task."""
    hops, dealt = cut(hops), edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk_id").distinct()
    if is_small(hops):
        return dealt.join(F.broadcast(hops), "concept")
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(CONCEPT_PARTS)).cast("int")
    spread = hops.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(CONCEPT_PARTS - 1))))
    return dealt.withColumn("part", part).join(spread, ["concept", "part"])


def graph_top_k(queries: DataFrame, edges: DataFrame, lexical: DataFrame, k: int, max_hops: int = 3, decay: float = DECAY, step: int = 1) -> DataFrame:
    """Concept-graph search; queries that reach no chunk get their ``lexical`` results instead, whose order is that of the
    overlap, at nine tenths."""
    named = cut(match_concepts(queries, edges))
    found = top_k(graph_candidates(queries, edges, k, max_hops, decay, step, named), k)
    rest = lexical.join(named.select("query_id").distinct(), "query_id", "left_anti")
    return found.unionByName(rest.select("query_id", "chunk_id", (F.col("score") * FALLBACK_FACTOR).alias("score"), "rank"))


def union_results(lexical: DataFrame, semantic: DataFrame, graph: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, source, src_ord, rank): all results, in the order of the retrievers."""
    parts = [df.select("query_id", "chunk_id", "score", F.lit(name).alias("source"), F.lit(k).alias("src_ord"), "rank") for k, (name, df) in enumerate((("lexical", lexical), ("semantic", semantic), ("graph", graph)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fallback_results(queries: DataFrame, results: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """For queries without any result: chunks at score 0 in their order, as many as can still be ranked."""
    lost = queries.select("query_id").join(results.select("query_id").distinct(), "query_id", "left_anti")
    first = chunks.select("chunk_id").orderBy("chunk_id").limit(k)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy("chunk_id")))  # k rows
    rows = lost.crossJoin(F.broadcast(ranked))
    return rows.select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.lit("fallback").alias("source"), F.lit(0).alias("src_ord"), "rank")

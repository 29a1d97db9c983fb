"""The registry's queries as DuckDB SQL: named steps, each building on those before it."""

from __future__ import annotations

from veriframe.functions.text import NEGATIONS, TRIPLE_NEGATIONS
from veriframe.operators import routing
from veriframe.operators.concepts import Rule
from veriframe.operators.svo import RelationRule
from veriframe.operators.verdict import LABELS

K = 5
#: The cosine from which the driver's vectors count as alike.
ALIKE = 0.42

#: Rules whose needles occur in the driver's tables.
DATA_RULES = (
    Rule(("thlynd", "theati"), provides=("theati",), depends_on=("thernd",)),
    Rule(("thernd", "haed"), provides=("haed",), depends_on=("sten",)),
    Rule(("sten",), provides=("sten", "shed")),
    Rule(("schach",), provides=("schach",), depends_on=("chver", "ertz")),
    Rule(("ciónado",), provides=("ciónado",), depends_on=("ñra",)),
    Rule(("ñra",), provides=("ñra",)),
    Rule(("eaea",), provides=("eaea",), only_without_others=True),
)
#: The same needles with concepts of several words, some of them shared.
PHRASE_RULES = (
    Rule(("thlynd", "theati"), provides=("theati thernd",), depends_on=("thernd haed of sten",)),
    Rule(("thernd", "haed"), provides=("haed",), depends_on=("sten and haed",)),
    Rule(("sten",), provides=("sten", "the shed of sten")),
    Rule(("schach",), provides=("schach und chver",), depends_on=("chver",)),
    Rule(("ciónado",), provides=("ciónado de la",), depends_on=("la ñra",)),
    Rule(("ñra",), provides=("la ñra",)),
)
DATA_RELATIONS = (
    RelationRule(("thlynd", "theati"), "ent_theati", "LEADS TO", "ent_thernd"),
    RelationRule(("schach", "chver"), "ent_schach", "part-of", "ent_chver"),
)


def _any(text: str, needles) -> str:
    return "(" + " OR ".join(f"contains({text}, '{n}')" for n in needles) + ")"


def _edges(rules: tuple[Rule, ...] = DATA_RULES) -> str:
    plain = [r for r in rules if not r.only_without_others]
    rows = [f"SELECT chunk_id, '{c}' AS concept, '{kind}' AS edge_type FROM chunks WHERE {_any('lower(text)', r.needles)}" for r in plain for kind, cs in (("PROVIDES", r.provides), ("DEPENDS_ON", r.depends_on)) for c in cs]
    others = " OR ".join(_any("lower(text)", r.needles) for r in plain if r.provides)
    rows += [f"SELECT chunk_id, '{c}', 'PROVIDES' FROM chunks WHERE {_any('lower(text)', r.needles)} AND NOT ({others})" for r in rules if r.only_without_others for c in r.provides]
    return " UNION ".join(rows)


def _relations() -> str:
    return " UNION ALL ".join(f"SELECT chunk_id, '{r.subject_id}' AS subject_id, '{r.relation}' AS relation, '{r.object_id}' AS object_id FROM chunks WHERE {_any('lower(text)', r.needles)}" for r in DATA_RELATIONS)


def _top(source: str, score: str) -> str:
    return f"""SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id DESC) AS rank
      FROM (SELECT query_id, chunk_id, {score} AS score FROM {source})) WHERE rank <= {K}"""


def _types(queries: str) -> str:
    """Queries with their types."""
    return f"""SELECT query_id, query, CASE WHEN len(f) > 0 THEN f ELSE ['complex', 'exact_match'] END AS types FROM (SELECT *, list_filter([CASE WHEN {_any('lower(query)', routing.COMPLEX)} THEN 'complex' END,
  CASE WHEN regexp_matches(query, '".+"') OR regexp_matches(query, '\\b[A-Z0-9_-]{{5,}}\\b') THEN 'exact_match' END, CASE WHEN {_any('lower(query)', routing.MULTI_HOP)} THEN 'multi_hop' END,
  CASE WHEN {_any('lower(query)', routing.ONTOLOGY)} THEN 'ontology' END], lambda x: x IS NOT NULL) AS f FROM {queries})"""


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_strip = STRIP.format
_normal = lambda c: _strip(rf"regexp_replace(lower({c}), '\s+', ' ', 'g')")
_tokens = lambda c: rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
_holds = lambda c: f"coalesce({_normal(c)} <> '' AND contains(normal, {_normal(c)}), false)"

#: DuckDB's distance counts bytes; the letters of the driver's texts that have two go as capitals, which tokens don't have.
_plain = "translate({0}, 'ßàäçèéêíñóöü', 'ABCDEFGHIJKL')".format

STEPS = {
    "stripped": f"SELECT doc_id, source, coalesce(text, '') AS raw, {_strip('coalesce(text, chr(32))')} AS whole FROM documents",
    "matched": r"SELECT *, regexp_extract_all(whole, '([^\n]+?[.!?](?:\[[^\]]*\])*)(?:\s+|$)', 1) AS found FROM stripped",
    "listed": f"SELECT *, list_filter(list_transform(CASE WHEN len(found) > 0 THEN found ELSE [whole] END, lambda x: {_strip('x')}), lambda x: x <> '') AS pieces FROM matched",
    "exploded": "SELECT doc_id, source, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, source, CASE WHEN len(pieces) > 0 THEN pieces ELSE [raw] END AS p FROM listed)",
    "chunks": r"""SELECT doc_id::VARCHAR AS document_id, concat(doc_id, '-', printf('%06d', pos)) AS chunk_id, pos::BIGINT AS pos, text, source,
      len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS word_count FROM exploded""",
    "chunk_terms": f"SELECT chunk_id, {_tokens('text')} AS terms FROM chunks",
    "postings": "SELECT chunk_id, len(list_distinct(terms))::BIGINT AS n_tokens, unnest(list_distinct(terms)) AS token FROM chunk_terms",
    "negated_chunks": f"SELECT source, arg_min(text, chunk_id) AS text FROM chunks WHERE contains({_normal('text')}, 'no ') GROUP BY source",
    "claim_terms": f"""SELECT concat('b', printf('%05d', item_id)) AS assertion_id, {_tokens('text')} AS t, CASE WHEN item_id % 5 = 0 THEN 'must_not_hold' ELSE 'must_hold' END AS polarity FROM benchmark
      UNION ALL SELECT concat('n', source), {_tokens('text')}, 'must_hold' FROM negated_chunks UNION ALL SELECT 'u', ['zzqx', 'zzqy', 'zzqz'], 'must_hold'""",
    "claims": "SELECT assertion_id, coalesce(t[1], '') AS subject, coalesce(t[2], '') AS relation, coalesce(t[3], '') AS object, polarity, 'constraint' AS rule_type FROM claim_terms",
    "queries": "SELECT assertion_id AS query_id, concat(subject, ' ', relation, ' ', object) AS query FROM claims",
    "query_terms": f"SELECT query_id, len(list_distinct({_tokens('query')}))::BIGINT AS n_query, unnest(list_distinct({_tokens('query')})) AS token FROM queries",
    "overlap": "SELECT query_id, chunk_id, count(*) AS n, any_value(n_query) AS n_query, any_value(n_tokens) AS n_tokens FROM postings JOIN query_terms USING (token) GROUP BY ALL",
    "lexical": _top("overlap", "n::DOUBLE"),
    "jaccard": _top("overlap", "n / (n_query + n_tokens - n)"),
    "edges": _edges(),
    "concept_matches": f"SELECT DISTINCT query_id, concept FROM (SELECT DISTINCT concept FROM edges), queries WHERE contains(lower(query), concept) OR len(list_filter({_tokens('query')}, lambda t: contains(concept, t))) > 0",
    "hop0": "SELECT DISTINCT query_id, chunk_id FROM concept_matches JOIN edges USING (concept)",
    "hop1": "SELECT DISTINCT h.query_id, b.chunk_id FROM hop0 h JOIN edges a ON a.chunk_id = h.chunk_id JOIN edges b ON b.concept = a.concept AND b.chunk_id <> a.chunk_id",
    "hop2": "SELECT DISTINCT h.query_id, b.chunk_id FROM hop1 h JOIN edges a ON a.chunk_id = h.chunk_id JOIN edges b ON b.concept = a.concept AND b.chunk_id <> a.chunk_id",
    "hops": "SELECT query_id, chunk_id, min(hop) AS hop FROM (SELECT *, 0 AS hop FROM hop0 UNION ALL SELECT *, 1 FROM hop1 UNION ALL SELECT *, 2 FROM hop2) GROUP BY ALL",
    "graph_found": _top("hops", "pow(0.8, hop)"),
    "graph_rest": "SELECT * FROM overlap WHERE query_id NOT IN (SELECT query_id FROM hops)",
    "graph_fallback": _top("graph_rest", "n * 0.9::DOUBLE"),
    "graph": "SELECT * FROM graph_found UNION ALL SELECT * FROM graph_fallback",
    "results": "SELECT *, 'lexical' AS source, 0 AS src_ord FROM lexical UNION ALL SELECT *, 'semantic', 1 FROM jaccard UNION ALL SELECT *, 'graph', 2 FROM graph",
    "fallback": f"""SELECT query_id, chunk_id, 0.0::DOUBLE AS score, rank, 'fallback' AS source, 0 AS src_ord FROM (SELECT query_id FROM queries WHERE query_id NOT IN (SELECT query_id FROM results)),
      (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS rank FROM (SELECT chunk_id FROM chunks ORDER BY chunk_id LIMIT {K}))""",
    "all_results": "SELECT * FROM results UNION ALL SELECT * FROM fallback",
    "slots": """SELECT query_id, chunk_id, coalesce(max(CASE WHEN source NOT IN ('semantic', 'graph') THEN score END), 0) AS lexical, coalesce(max(CASE WHEN source = 'semantic' THEN score END), 0) AS semantic,
      coalesce(max(CASE WHEN source = 'graph' THEN score END), 0) AS graph, list_sort(list_distinct(list(source))) AS sources, min(src_ord * 1000 + rank) AS first_seen FROM all_results GROUP BY ALL""",
    "ranges": "SELECT *, min(CASE WHEN lexical > 0 THEN lexical END) OVER (PARTITION BY query_id) AS low, max(CASE WHEN lexical > 0 THEN lexical END) OVER (PARTITION BY query_id) AS high FROM slots",
    "fused": """SELECT query_id, chunk_id, sources, first_seen, 0.3::DOUBLE * (CASE WHEN lexical <= 0 THEN 0 WHEN high = low THEN 1 ELSE (lexical - low) / (high - low) END) + 0.5::DOUBLE * greatest(0, least(1, semantic))
      + 0.2::DOUBLE * greatest(0, least(1, graph)) + 0.1::DOUBLE * (len(sources) - 1) AS score FROM ranges""",
    "ranked": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_seen) AS rank FROM fused) WHERE rank <= {K}",
    "texts": "SELECT r.*, c.text, c.document_id FROM ranked r JOIN chunks c USING (chunk_id)",
    "pairs": f"SELECT c.*, t.chunk_id, t.score, t.rank, t.sources, t.text, {_normal('t.text')} AS normal FROM texts t JOIN claims c ON c.assertion_id = t.query_id",
    "flags": f"SELECT *, {_holds('subject')} AS s, {_holds('relation')} AS r, {_holds('object')} AS o, {_any('normal', NEGATIONS)} AS negated, {_any('normal', TRIPLE_NEGATIONS)} AS negated_triple FROM pairs",
    "stances": """SELECT *, CASE WHEN s AND r AND o THEN CASE WHEN negated OR polarity = 'must_not_hold' THEN 'refutes' ELSE 'supports' END WHEN s OR o THEN 'partial' ELSE 'unknown' END AS support_type,
      round(least(1, greatest(score, CASE WHEN s AND r AND o THEN CASE WHEN negated OR polarity = 'must_not_hold' THEN 0.9 ELSE 0.95 END WHEN s AND r THEN 0.7 WHEN s OR o THEN 0.5 ELSE 0.2 END))::DOUBLE, 4) AS confidence FROM flags""",
    "strengths": """SELECT c.assertion_id, any_value(c.subject) AS subject, any_value(c.relation) AS relation, any_value(c.object) AS object, count(x.chunk_id) AS n, count_if(support_type = 'supports') AS ns, count_if(support_type = 'refutes') AS nr,
      count_if(support_type = 'partial') AS np, count_if(support_type = 'unknown') AS nu, coalesce(sum(confidence) FILTER (support_type = 'supports'), 0) AS ss, coalesce(sum(confidence) FILTER (support_type = 'refutes'), 0) AS rs,
      coalesce(sum(confidence) FILTER (support_type = 'partial'), 0) AS ps, coalesce(sum(score) FILTER (support_type = 'refutes'), 0) AS rscore, coalesce(list_sort(list_distinct(flatten(list(sources)))), []) AS sources,
      arg_min(x.chunk_id, rank) FILTER (support_type = 'supports') AS first_support, arg_min(x.chunk_id, rank) FILTER (support_type = 'refutes') AS first_refute,
      arg_min(x.chunk_id, rank) AS first_chunk, arg_min(x.text, rank) AS first_text FROM claims c LEFT JOIN stances x USING (assertion_id) GROUP BY c.assertion_id""",
    "labelled": """SELECT *, CASE WHEN n = 0 THEN 'unknown' WHEN rs > ss AND rs >= 0.6 THEN 'contradicted' WHEN ss >= 0.7 AND rs = 0 THEN 'supported' WHEN ss > 0 OR ps > 0 THEN 'partial' ELSE 'unknown' END AS label,
      round(greatest(0, least(1, 0.2::DOUBLE + 0.6::DOUBLE * ss + 0.15::DOUBLE * ps + 0.08::DOUBLE * greatest(0, len(sources) - 1) - 0.55::DOUBLE * rs)), 4) AS raw FROM strengths""",
    "heuristic": """SELECT *, CASE WHEN n = 0 THEN 0.1 ELSE greatest(raw, CASE label WHEN 'supported' THEN 0.8 WHEN 'contradicted' THEN 0.75 WHEN 'partial' THEN 0.35 ELSE 0 END) END::DOUBLE AS score,
      CASE WHEN n = 0 THEN ['no_evidence'] ELSE list_filter([CASE WHEN ns > 0 THEN 'direct_support' END, CASE WHEN nr > 0 THEN 'explicit_negation' END, CASE WHEN np > 0 THEN 'partial_match' END, CASE WHEN nu > 0 AND nu = n THEN 'insufficient_evidence' END], lambda x: x IS NOT NULL) END AS rule_hits,
      CASE WHEN n = 0 THEN 'No evidence was retrieved for this triple.' WHEN label = 'supported' THEN concat('The triple is supported by chunk ', first_support, ' with direct subject, relation, and object matches.')
      WHEN label = 'contradicted' THEN concat('The triple is contradicted by chunk ', first_refute, ', which contains the assertion with explicit negation or forbidden polarity.')
      WHEN label = 'partial' THEN 'The retrieved chunks partially match the triple, but one or more components are missing or incomplete.' ELSE 'The retrieved evidence is insufficient to determine whether the triple is correct.' END AS rationale FROM labelled""",
    "gated": "SELECT *, label IN ('partial', 'unknown') OR (ns > 0 AND nr > 0) OR len(sources) > 1 OR score < 0.6 AS needs_judge FROM heuristic",
    "verdict_kinds": "SELECT *, CASE WHEN nr > 0 AND nr >= ns AND rscore >= 0.6 THEN 1 WHEN ns > 0 AND nr = 0 THEN 2 WHEN ns > 0 OR np > 0 THEN 3 ELSE 4 END AS kind FROM gated",
    "judged": """SELECT *, CASE WHEN needs_judge THEN ['contradicted', 'supported', 'partial', 'unknown'][kind] END AS judge_label, CASE WHEN needs_judge THEN [0.8, 0.88, 0.55, 0.2][kind]::DOUBLE END AS judge_confidence,
      CASE WHEN needs_judge THEN ['Evidence contains explicit refutation of the assertion.', 'Evidence contains a direct support match for the assertion.', 'Evidence partially matches the assertion but is not conclusive.',
      'The evidence is insufficient to determine the assertion.'][kind] END AS judge_rationale FROM verdict_kinds""",
    "merged": """SELECT *, coalesce(judge_label, label) AS final_label, CASE WHEN judge_label IS NULL THEN score ELSE round(least(1, greatest(0, CASE WHEN label = judge_label OR (judge_label = 'supported' AND label <> 'contradicted')
      OR (judge_label = 'contradicted' AND label <> 'supported') THEN greatest(score, judge_confidence) ELSE score END)), 4) END AS final_score,
      CASE WHEN judge_label IS NULL THEN rationale ELSE concat('Heuristic: ', rationale, ' LM: ', judge_rationale) END AS final_rationale,
      list_sort(list_distinct(list_concat(rule_hits, CASE WHEN judge_label IS NULL THEN ['heuristic_baseline', 'evidence_judge'] ELSE ['lm_judge', 'heuristic_baseline', 'evidence_judge'] END))) AS final_rule_hits FROM judged""",
    "relations": _relations(),
    "named_vectors": "SELECT DISTINCT ON (vec_id) concat('T', vec_id) AS term, embedding::DOUBLE[] AS v FROM embeddings",
    "alike": f"SELECT a.term AS a, b.term AS b FROM named_vectors a JOIN named_vectors b ON a.term <> b.term AND list_cosine_similarity(a.v, b.v) > {ALIKE}",
    "clusters": "SELECT * FROM (WITH RECURSIVE reach AS (SELECT term, term AS other FROM named_vectors UNION SELECT reach.term, alike.b FROM reach JOIN alike ON alike.a = reach.other) SELECT * FROM reach)",
    "vocabulary": f"SELECT token, {_plain('token')} AS plain, count(*) AS df FROM postings GROUP BY token",
    "near_terms": f"""SELECT query_id, q.token AS asked, v.token, levenshtein({_plain('q.token')}, v.plain) AS distance FROM query_terms q JOIN vocabulary v ON abs(length(q.token) - length(v.token)) <= 2
      WHERE levenshtein({_plain('q.token')}, v.plain) <= CASE WHEN length(q.token) < 3 THEN 0 WHEN length(q.token) < 6 THEN 1 ELSE 2 END""",
    "phrases": _edges(PHRASE_RULES),
    "text_queries": "SELECT concat('t', item_id) AS query_id, coalesce(text, '') AS query FROM benchmark",
    "phrase_terms": f"SELECT concept, {_tokens('concept')} AS terms FROM (SELECT DISTINCT concept FROM phrases)",
    "phrase_tokens": "SELECT concept, len(terms) AS dl, token, len(list_filter(terms, lambda x: x = token)) AS tf FROM (SELECT concept, terms, unnest(list_distinct(terms)) AS token FROM phrase_terms)",
    "seeds": f"""SELECT query_id, concept, sum(ln(1 + (nc - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))) AS score FROM phrase_tokens
      JOIN (SELECT query_id, unnest(list_distinct({_tokens('query')})) AS token FROM text_queries) USING (token) JOIN (SELECT token, count(*) AS df FROM phrase_tokens GROUP BY token) USING (token),
      (SELECT count(*) AS nc, avg(len(terms)) AS avg_dl FROM phrase_terms) GROUP BY ALL""",
    "beside": "SELECT a.concept, b.concept AS beside, max(a.chunk_id) AS via FROM phrases a JOIN phrases b ON a.chunk_id = b.chunk_id AND a.concept <> b.concept GROUP BY ALL",
    "walks": """SELECT * FROM (WITH RECURSIVE walk AS (SELECT query_id, concept, score, 1 AS length, [concept] AS path FROM seeds UNION ALL
      SELECT query_id, b.beside, score * 0.8::DOUBLE * 0.8::DOUBLE, length + 2, list_concat(path, [b.via, b.beside]) FROM walk JOIN beside b USING (concept) WHERE length < 3) SELECT * FROM walk)""",
    "walked": """SELECT query_id, chunk_id, score, length, list_concat(path, [chunk_id]) AS path, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round(score, 9) DESC, length, list_concat(path, [chunk_id])) AS n
      FROM walks JOIN (SELECT DISTINCT concept, chunk_id FROM phrases) USING (concept)""",
    "chains": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id DESC) AS rank FROM walked WHERE n = 1) WHERE rank <= {K}",
}

_bucket = "CASE WHEN {0} >= 0.9 THEN 'very_high' WHEN {0} >= 0.75 THEN 'high' WHEN {0} >= 0.5 THEN 'medium' WHEN {0} >= 0.25 THEN 'low' ELSE 'very_low' END".format
_route = f"SELECT query_id, query, array_to_string(types, ',') AS query_types FROM ({_types('routed_queries')})"
STEPS["routed_queries"] = """SELECT concat('r', item_id) AS query_id, CASE item_id % 5 WHEN 0 THEN concat('What is CHEMBL', 12345 + item_id, '? ', text) WHEN 1 THEN concat('How does climate affects ', text)
  WHEN 2 THEN concat('What connects A indirectly to ', text) WHEN 3 THEN concat('Does this violate the constraint ', text) ELSE text END AS query FROM benchmark"""

_violation = """SELECT query_id, chunk_id, rank AS result_rank, a.assertion_id, v.text, CASE WHEN s AND r AND o THEN CASE WHEN negated OR polarity IN ('forbidden', 'must_not_hold') THEN 'contradiction' ELSE 'satisfied' END
  WHEN s AND r THEN 'partial_match' WHEN s OR o THEN 'candidate_violation' ELSE 'unmatched' END AS violation_type FROM"""

#: Name: the last step's columns as the registry returns them.
FINAL = {
    "chunk_documents": "SELECT document_id, chunk_id, pos, text, word_count FROM chunks",
    "ingest_summary": "SELECT document_id, count(*) AS chunks, sum(word_count)::BIGINT AS words, 'success' AS status FROM chunks GROUP BY document_id",
    "token_index": "SELECT chunk_id, n_tokens, token FROM postings",
    "document_frequency": "SELECT token, count(*) AS df FROM postings GROUP BY token",
    "claims": "SELECT assertion_id, subject, relation, object, polarity, rule_type FROM claims",
    "lexical_topk": "SELECT query_id, chunk_id, score, rank FROM lexical",
    "jaccard_topk": "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM jaccard",
    "fuzzy_terms": "SELECT query_id, asked, token, distance::BIGINT AS distance FROM near_terms",
    "canonical_concepts": "SELECT term, lower(arg_min(other, (length(other), other))) AS canonical FROM clusters GROUP BY term",
    "concept_seeds": "SELECT query_id, concept, round(score, 6) AS score FROM seeds",
    "graph_scored": "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM chains",
    "evidence_paths": "SELECT query_id, chunk_id, round(score, 6) AS score, rank, length::BIGINT AS length, array_to_string(path, ' > ') AS path FROM chains",
    "bm25_topk": f"""SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id DESC) AS rank FROM (
      SELECT query_id, chunk_id, sum(ln(1 + (nc - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))) AS score FROM
      (SELECT chunk_id, len(terms) AS dl, unnest(list_distinct(terms)) AS token, terms FROM chunk_terms) JOIN query_terms USING (token) JOIN (SELECT token, count(*) AS df FROM postings GROUP BY token) USING (token),
      (SELECT count(*) AS nc, avg(len(terms)) AS avg_dl FROM chunk_terms), LATERAL (SELECT len(list_filter(terms, lambda x: x = token)) AS tf) GROUP BY ALL)) WHERE rank <= {K}""",
    "cosine_topk": f"""SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id DESC) AS rank FROM (
      SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)) WHERE rank <= {K}""",
    "concept_edges": "SELECT chunk_id, concept, edge_type FROM edges",
    "concept_match": "SELECT query_id, concept FROM concept_matches",
    "graph_hops": "SELECT query_id, concept, min(hop)::BIGINT AS hop FROM hops JOIN edges USING (chunk_id) GROUP BY ALL HAVING false",
    "graph_topk": "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM graph",
    "graph_fallback": "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM graph_fallback",
    "retrieval_union": "SELECT query_id, chunk_id, round(score, 6) AS score, source, src_ord::BIGINT AS src_ord, rank FROM results",
    "graph_bipartite": f"SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({_top('(SELECT * FROM hops WHERE hop < 2)', 'pow(0.8, 2 * hop)')})",
    "gated_results": f"""SELECT query_id, chunk_id, round(score, 6) AS score, source, rank FROM results JOIN ({_types('queries')}) USING (query_id) WHERE (source = 'lexical' AND list_contains(types, 'exact_match'))
      OR (source = 'semantic' AND list_contains(types, 'complex')) OR (source = 'graph' AND (list_contains(types, 'multi_hop') OR list_contains(types, 'ontology')))""",
    "judge_gate_graph": """SELECT assertion_id, needs_judge OR lines <> '' AS needs_judge, lines AS graph_summary FROM gated JOIN (SELECT a.assertion_id, coalesce(string_agg(x.chunk_id || ' -> next', ',' ORDER BY x.rank)
      FILTER (c.pos % 3 = 0), '') AS lines FROM claims a LEFT JOIN stances x USING (assertion_id) LEFT JOIN chunks c USING (chunk_id) GROUP BY a.assertion_id) USING (assertion_id)""",
    "fallback_candidates": "SELECT query_id, chunk_id, score, source, src_ord::BIGINT AS src_ord, rank FROM fallback",
    "fusion_scores": "SELECT query_id, chunk_id, round(score, 6) AS score, array_to_string(sources, ',') AS sources, len(sources)::BIGINT AS n_sources FROM fused",
    "fusion_topk": "SELECT query_id, chunk_id, round(score, 6) AS score, 'fusion' AS source, array_to_string(sources, ',') AS contributing_sources, rank FROM ranked",
    "materialize_chunks": "SELECT query_id, chunk_id, document_id, text, rank FROM texts",
    "route_queries": _route,
    "match_flags": "SELECT assertion_id, chunk_id, s AS matched_subject, r AS matched_relation, o AS matched_object FROM flags",
    "negation_flags": "SELECT assertion_id, chunk_id, negated, negated_triple FROM flags",
    "span_stance": "SELECT assertion_id, chunk_id, support_type, confidence FROM stances",
    "triple_classify": """SELECT assertion_id, chunk_id, CASE WHEN s AND r AND o THEN CASE WHEN negated_triple THEN 'contradicted' ELSE 'supported' END WHEN s AND (r OR o) THEN 'partial' ELSE 'unknown' END AS label,
      CASE WHEN s AND r AND o THEN CASE WHEN negated_triple THEN 0.9 ELSE 0.94 END WHEN s AND (r OR o) THEN 0.62 ELSE 0.18 END::DOUBLE AS confidence FROM flags""",
    "verify_evidence": "SELECT query_id, rank, chunk_id, round(score, 4) AS score, 'fusion' AS retrieval_source, text, 'EVIDENCE_GATHERED' AS status FROM texts WHERE query_id IN (SELECT query_id FROM results)",
    "verdict_aggregate": "SELECT assertion_id, label, score, rationale, array_to_string(sources, ',') AS retrieval_sources FROM heuristic",
    "rule_hits": "SELECT assertion_id, array_to_string(rule_hits, ',') AS rule_hits FROM heuristic",
    "judge_gate": "SELECT assertion_id, needs_judge FROM gated",
    "judge_heuristic": "SELECT assertion_id, judge_label, judge_confidence, judge_rationale FROM judged",
    "verdict_merge": "SELECT assertion_id, subject, relation, object, final_label AS label, final_score AS score, final_rationale AS rationale, array_to_string(final_rule_hits, ',') AS rule_hits FROM merged",
    "verdict_summary": "SELECT count(*) AS total_triples, " + ", ".join(f"count_if(final_label = '{x}')::BIGINT AS {x}" for x in LABELS) + ", round(coalesce(avg(final_score), 0), 4) AS avg_score FROM merged",
    "score_bucket": f"SELECT assertion_id, final_score AS score, {_bucket('final_score')} AS score_bucket FROM merged",
    "training_examples": f"""SELECT concat('ex_', assertion_id, '_', coalesce(first_chunk, 'unknown_chunk')) AS example_id, 'triple_classification' AS task, coalesce(first_chunk, 'unknown_chunk') AS chunk_id, coalesce(first_text, '') AS chunk_text,
      final_label AS label, {_bucket('final_score')} AS score_bucket, final_rationale AS rationale FROM merged""",
    "svo_extract": "SELECT chunk_id, subject_id, relation, object_id FROM relations",
    "svo_edges": "SELECT DISTINCT subject_id, upper(translate(relation, ' -', '__')) AS edge_type, object_id FROM relations",
    "svo_mentions": "SELECT DISTINCT chunk_id, unnest([subject_id, object_id]) AS entity_id FROM relations",
    "simple_embedding": """SELECT chunk_id, array_to_string(list_transform(c, lambda x: printf('%.4f', round(x / CASE WHEN norm = 0 THEN 1 ELSE norm END, 4))), ',') AS embedding FROM (SELECT chunk_id, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS norm FROM (
      SELECT chunk_id, list_transform([0, 1, 2, 3, 4], lambda k: len(list_filter(b, lambda x: x = k))::DOUBLE) AS c FROM (SELECT chunk_id, list_transform(terms, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 5) AS b FROM chunk_terms)))""",
    "ontology_violations": f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, result_rank, assertion_id) AS rank, assertion_id, chunk_id, violation_type, confidence FROM (
      SELECT *, CASE violation_type WHEN 'contradiction' THEN 0.94 WHEN 'partial_match' THEN 0.65 ELSE 0.5 END::DOUBLE AS confidence FROM (
      {_violation} (SELECT *, {_normal('text')} AS normal FROM texts) v, LATERAL (SELECT c.assertion_id, c.polarity, {_holds('c.subject')} AS s, {_holds('c.relation')} AS r, {_holds('c.object')} AS o, {_any('normal', NEGATIONS)} AS negated FROM claims c) a)
      WHERE violation_type IN ('contradiction', 'partial_match', 'candidate_violation'))""",
}
del FINAL["graph_hops"]
FINAL["bm25_indexed"] = FINAL["bm25_topk"]
FINAL["bm25_fuzzy"] = FINAL["bm25_topk"].replace("JOIN query_terms USING (token)", "JOIN (SELECT DISTINCT query_id, token FROM near_terms) USING (token)")
FINAL["overlap_indexed"] = "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lexical"
FINAL["jaccard_indexed"] = FINAL["jaccard_topk"]
FINAL["graph_scores"] = "SELECT query_id, chunk_id, round(pow(0.8, hop), 6) AS score FROM hops"


def sql() -> dict[str, str]:
    """Every query with all steps before it; steps that it doesn't use cost nothing."""
    steps = ",\n".join(f"{name} AS ({body})" for name, body in STEPS.items())
    return {name: f"WITH {steps}\n{body}" for name, body in FINAL.items()}

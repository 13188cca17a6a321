"""The catalogue's queries in DuckDB SQL, built from named common table expressions."""

from __future__ import annotations

from ..sources.driver_tables import CHUNK_SQL
from .catalogue import WANT_FY, WANT_TYPE
from .models import NO_ANSWER

TOKENS = "list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '')"
PAGE = "coalesce(nullif(page_number, 0), nullif(start_page, 0))"
BODY = "coalesce(coalesce(nullif(text_nl, ''), text), '')"
LEXICAL = "coalesce(CASE WHEN chunk_type = 'table' THEN coalesce(nullif(text_nl, ''), text) WHEN coalesce(section_breadcrumb, '') <> '' THEN concat(section_breadcrumb, chr(10), chr(10), text) ELSE text END, '')"
HEAD = "concat_ws(chr(10), CASE WHEN trim(coalesce(section_breadcrumb, '')) <> '' THEN concat('Section: ', trim(section_breadcrumb)) END, CASE WHEN chunk_type = 'table' AND trim(coalesce(table_title, '')) <> '' AND coalesce(text_nl, '') = '' THEN concat('Table: ', trim(table_title)) END)"
EMBED_BODY = "CASE WHEN chunk_type = 'table' THEN coalesce(nullif(text_nl, ''), text) ELSE text END"
EMBED = f"CASE WHEN {HEAD} = '' THEN {EMBED_BODY} ELSE concat({HEAD}, chr(10), chr(10), {EMBED_BODY}) END"
#: Word boundaries here are those of all letters, so acronyms are found as whole runs of word characters.
KEYWORDS = "coalesce(nullif(array_to_string(list_concat(list_filter(string_split(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: regexp_full_match(x, '[A-Z]{{2,}}')), regexp_extract_all({0}, '\\$?[\\d,]+\\.?\\d*%?')), ' '), ''), {0})"

CHUNKS = "chunks AS (" + CHUNK_SQL.format(array="[", end="]", div="//") + ")"
MANIFEST = f"manifest AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS index, c.*, {PAGE} AS page, {EMBED} AS embed_text, e.embedding FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.ord WHERE chunk_type IN ('narrative', 'table'))"
QUESTIONS = f"questions AS (SELECT item_id AS query_id, b.text AS question, e.embedding AS qvec, h.embedding AS hvec, {KEYWORDS.format('b.text')} AS keywords, CASE WHEN item_id % 2 = 0 THEN '{WANT_FY}' END AS want_fy FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = item_id LEFT JOIN embeddings h ON h.vec_id = item_id + 2)"
LEX = f"""toks AS (SELECT index, unnest({TOKENS.format(LEXICAL)}) AS term FROM manifest),
postings AS (SELECT term, index, count(*) AS tf FROM toks GROUP BY ALL),
lengths AS (SELECT index, count(*) AS dl FROM toks GROUP BY ALL),
stat AS (SELECT (SELECT count(*) FROM manifest) AS n, (SELECT count(*) FROM toks) / (SELECT count(*) FROM manifest) AS avgdl),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf0 FROM postings, stat GROUP BY term),
terms AS (SELECT term, df, CASE WHEN idf0 < 0 THEN 0.25 * (SELECT avg(idf0) FROM raw) ELSE idf0 END AS idf FROM raw)"""
BASE = ",\n".join((CHUNKS, MANIFEST, QUESTIONS, LEX))


def scores(name: str, text: str = "question", asked: str = "questions") -> str:
    return f"""{name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format(text)}) AS term FROM {asked}) GROUP BY ALL),
{name} AS (SELECT query_id, index, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM {name}_q JOIN terms USING (term) JOIN postings USING (term) JOIN lengths USING (index), stat GROUP BY ALL)"""


def best(name: str, scored: str, k: int) -> str:
    return f"{name} AS (SELECT query_id, rank, score, index, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, index DESC) AS rank FROM ({scored})) WHERE rank <= {k})"


def bm25(name: str, k: int, where: str = "true", text: str = "question", asked: str = "questions") -> str:
    every = f"SELECT q.query_id, m.index, m.chunk_id, coalesce(s.score, 0) AS score FROM {asked} q JOIN manifest m ON {where} LEFT JOIN {name}_s s ON s.query_id = q.query_id AND s.index = m.index"
    return scores(f"{name}_s", text, asked) + ",\n" + best(name, every, k)


def dense(name: str, k: int, where: str = "true", vec: str = "qvec", asked: str = "questions", rows: str = "manifest") -> str:
    every = f"SELECT q.query_id, m.index, m.chunk_id, list_dot_product(CAST(q.{vec} AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])) AS score FROM {asked} q JOIN {rows} m ON {where} WHERE q.{vec} IS NOT NULL AND m.embedding IS NOT NULL"
    return best(name, every, k)


def fused(name: str, a: str, b: str, k: int | None = None) -> str:
    cut = f" WHERE rank <= {k}" if k else ""
    side = lambda t, n: f"(SELECT query_id, chunk_id, sum(1.0 / CAST(60 + rank AS DOUBLE)) AS s{n}, min(rank) AS r{n}, max(index) AS i{n} FROM {t} GROUP BY ALL)"
    return f"""{name} AS (SELECT query_id, rank, score, index, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1 ASC NULLS LAST, r2 ASC NULLS FIRST) AS rank FROM (
SELECT query_id, chunk_id, coalesce(s1, 0) + coalesce(s2, 0) AS score, r1, r2, coalesce(i1, i2) AS index FROM {side(a, 1)} FULL JOIN {side(b, 2)} USING (query_id, chunk_id))){cut})"""


def deduplicated(name: str, t: str, k: int | None = None) -> str:
    both = "len(list_intersect(a.toks, b.toks))"
    cut = f" WHERE rank <= {k}" if k else ""
    return f"""{name}_t AS MATERIALIZED (SELECT query_id, rank, toks, len(toks) AS m FROM (SELECT query_id, rank, list_distinct({TOKENS.format(BODY)}) AS toks FROM {t} LEFT JOIN chunks USING (chunk_id))),
{name}_p AS (SELECT a.query_id, b.rank, list(a.rank) AS dups FROM {name}_t a JOIN {name}_t b ON a.query_id = b.query_id AND a.rank < b.rank AND a.m > 0 AND least(a.m, b.m) >= 0.85 * greatest(a.m, b.m) WHERE {both} / (a.m + b.m - {both}) >= 0.85 GROUP BY ALL),
{name}_l AS (SELECT query_id, list([{{'rank': rank, 'dups': coalesce(dups, [])}}] ORDER BY rank) AS l FROM {name}_t LEFT JOIN {name}_p USING (query_id, rank) GROUP BY ALL),
{name}_k AS (SELECT query_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: list_contains(x[1].dups, k.rank))) > 0 THEN acc ELSE list_concat(acc, x) END)) AS s FROM {name}_l),
{name} AS (SELECT * FROM (SELECT r.query_id, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS rank, score, index, chunk_id FROM {t} r JOIN {name}_k d ON d.query_id = r.query_id AND d.s.rank = r.rank){cut})"""


def reordered(name: str, t: str) -> str:
    return f"{name} AS (SELECT query_id, CAST(1 + CASE WHEN n <= 2 THEN i WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END AS BIGINT) AS rank, score, index, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM {t}))"


def query(last: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((BASE, *ctes)) + "\n" + last


def out(name: str, places: int = 5) -> str:
    return f"SELECT query_id, rank, round(score, {places}) AS score, index, chunk_id FROM {name}"


ON_FILTER = f"m.fiscal_year = '{WANT_FY}' AND m.chunk_type = '{WANT_TYPE}'"
ON_YEAR = "(q.want_fy IS NULL OR m.fiscal_year = q.want_fy)"


def hybrid(name: str, k: int, asked: str = "questions", where: str = "true", rows: str = "manifest") -> tuple[str, ...]:
    pool = max(4 * k, 20)
    return dense(f"{name}_d", pool, where, asked=asked, rows=rows), bm25(f"{name}_b", pool, where, asked=asked), fused(name, f"{name}_d", f"{name}_b", k)


def hyde(name: str, k: int, where: str = "true", asked: str = "questions", rows: str = "manifest") -> tuple[str, ...]:
    pool = max(4 * k, 50)
    return (
        dense(f"{name}_d", pool, where, asked=asked, rows=rows),
        bm25(f"{name}_b", pool, where, asked=asked),
        dense(f"{name}_h", pool, where, "hvec", asked, rows),
        fused(f"{name}_1", f"{name}_d", f"{name}_b"),
        fused(f"{name}_2", f"{name}_1", f"{name}_h"),
        deduplicated(f"{name}_3", f"{name}_2", k),
        reordered(name, f"{name}_3"),
    )


FIVE = hybrid("r", 5)
OWN = "own AS (SELECT r.query_id, r.rank, r.chunk_id, c.related_chunk_ids, c.parent_chunk_id, c.chunk_type, c.fiscal_year, c.page_number, " + PAGE + " AS page FROM r JOIN chunks c USING (chunk_id))"
SIGNAL = "CASE rank % 3 WHEN 1 THEN 'YES' WHEN 2 THEN 'NEED_ADJACENT' ELSE 'NOT_FOUND' END"
REL = f"rel AS (SELECT *, {SIGNAL} AS signal FROM r WHERE rank % 3 <> 0)"
NUMBERED = "numbered AS (SELECT split_part(chunk_id, '_', 1) AS pre, CAST(split_part(chunk_id, '_', -1) AS INT) AS num, arg_max(chunk_id, ord) AS ctx_id FROM chunks GROUP BY ALL)"


def near(t: str, radius: int, where: str = "true") -> str:
    return f"SELECT query_id, rank, 6 AS part, CAST(d AS BIGINT) AS pos, ctx_id FROM (SELECT *, split_part(chunk_id, '_', 1) AS p_, CAST(split_part(chunk_id, '_', -1) AS INT) AS n_ FROM {t} WHERE {where}), (SELECT unnest(range(-{radius}, {radius + 1})) AS d) JOIN numbered ON pre = p_ AND num = n_ + d WHERE d <> 0"


def page_tables(t: str) -> str:
    return f"SELECT a.query_id, a.rank, 7 AS part, o.ord AS pos, o.chunk_id AS ctx_id FROM {t} a JOIN chunks c ON c.chunk_id = a.chunk_id AND c.chunk_type = 'table' JOIN chunks o ON o.chunk_type = 'table' AND coalesce(o.page_number, 0) = coalesce(c.page_number, 0) AND o.chunk_id <> c.chunk_id WHERE NOT EXISTS (SELECT 1 FROM {t} x WHERE x.query_id = a.query_id AND x.chunk_id = o.chunk_id)"


FOUND = f"found AS ({near('rel', 1, chr(39).join(('signal = ', 'NEED_ADJACENT', '')))} UNION ALL {page_tables('rel')})"
DESCRIBED = f"shown AS (SELECT r.*, m.chunk_type, m.fiscal_year, m.page, m.section_breadcrumb, m.table_title, {BODY} AS body, coalesce(text, '') AS full_text FROM r JOIN manifest m USING (index, chunk_id))"
LABEL = "'FY ', {0}fiscal_year, ' | p.', coalesce(CAST({0}page AS VARCHAR), 'None'), ' | ', left(coalesce({0}section_breadcrumb, ''), 60), chr(10), "
OVERLAP = f"CASE WHEN len(list_distinct({TOKENS.format('question')})) = 0 THEN 0 ELSE len(list_intersect(list_distinct({TOKENS.format('question')}), list_distinct({TOKENS.format('doc')}))) / len(list_distinct({TOKENS.format('question')})) END"

PARENT = """SELECT query_id, rank, part, pos, ctx_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY part, pos) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank, ctx_id ORDER BY part, pos) AS k FROM (
SELECT query_id, rank, 1 AS part, CAST(i - 1 AS BIGINT) AS pos, related_chunk_ids[i] AS ctx_id FROM own, (SELECT unnest(range(1, 4)) AS i) WHERE i <= len(related_chunk_ids) AND related_chunk_ids[i] IN (SELECT chunk_id FROM chunks)
UNION ALL SELECT query_id, rank, 2, 0, parent_chunk_id FROM own WHERE parent_chunk_id IN (SELECT chunk_id FROM chunks)
UNION ALL SELECT query_id, rank, 3, c.ord, c.chunk_id FROM own JOIN chunks c ON c.parent_chunk_id = own.parent_chunk_id AND c.chunk_id <> own.chunk_id
UNION ALL SELECT query_id, rank, 4, c.ord, c.chunk_id FROM own JOIN chunks c ON c.parent_chunk_id = own.chunk_id)) WHERE k = 1) WHERE n <= 6"""

SAID = "concat(CASE turn % 6 WHEN 0 THEN ' yes, clearly' WHEN 1 THEN 'need more' WHEN 2 THEN 'Adjacent page' WHEN 3 THEN 'maybe' WHEN 4 THEN 'no: see the adjacent one' ELSE '' END, ' ', coalesce(text, ''))"
NORMAL = f"upper(trim({SAID}))"

# --- staged answers, with the stand-ins in place of models -------------------------------


def hashed(text: str) -> str:
    """The hashing stand-in's unit vector of a text."""
    places = f"list_transform({TOKENS.format(text)}, lambda w: CAST('0x' || left(md5(w), 7) AS INT) % 64)"
    return f"(SELECT list_transform(n, lambda c: CAST(c / greatest(sqrt(list_sum(list_transform(n, lambda x: x * x))), 1e-9) AS FLOAT)) FROM (SELECT list_transform(range(64), lambda i: len(list_filter(p, lambda x: x = i))) AS n FROM (SELECT {places} AS p)))"


def shared(question: str, text: str) -> str:
    """Share of the question's distinct tokens that the text has."""
    q, t = (f"list_distinct({TOKENS.format(x)})" for x in (question, text))
    return f"CASE WHEN len({q}) = 0 THEN 0 ELSE len(list_intersect({q}, {t})) / len({q}) END"


def reranked(name: str, found: str, asked: str, k: int) -> tuple[str, ...]:
    """Variants' rankings merged, each chunk once at its first place, then by the pair stand-in."""
    return (
        f"{name}_m AS (SELECT of AS query_id, row_number() OVER (PARTITION BY of ORDER BY variant, rank) AS was, index, chunk_id FROM (SELECT f.*, a.of, a.variant, row_number() OVER (PARTITION BY a.of, f.chunk_id ORDER BY a.variant, f.rank) AS n FROM {found} f JOIN {asked} a USING (query_id)) WHERE n = 1)",
        f"{name}_s AS (SELECT query_id, was, index, chunk_id, {shared('question', 'doc')} AS score FROM (SELECT m.*, question, trim(concat_ws(chr(10), nullif(coalesce(section_breadcrumb, ''), ''), left({BODY}, 2000))) AS doc FROM {name}_m m JOIN chunks USING (chunk_id) JOIN requests USING (query_id)))",
        best_of(name, f"{name}_s", k),
    )


def best_of(name: str, scored: str, k: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) AS rank, score, index, chunk_id FROM {scored}) WHERE rank <= {k})"


def answered(name: str, results: str, radius: int) -> tuple[str, ...]:
    """{name}_j: results with signals; {name}: one row for each question that has results."""
    near_of = "true" if radius > 1 else "signal = 'NEED_ADJACENT'"
    join = "concat(chr(10), chr(10), '---', chr(10), chr(10))"
    return (
        f"{name}_j AS (SELECT *, CASE WHEN o >= 0.5 THEN 'YES' WHEN o >= 0.3 THEN 'NEED_ADJACENT' ELSE 'NOT_FOUND' END AS signal FROM (SELECT *, {shared('question', 'body')} AS o FROM (SELECT r.*, question, m.chunk_type, m.fiscal_year, m.page, m.section_breadcrumb, m.table_title, {BODY} AS body FROM {results} r JOIN manifest m USING (index, chunk_id) JOIN requests USING (query_id))))",
        f"{name}_r AS (SELECT query_id, rank, chunk_id, signal FROM {name}_j WHERE signal <> 'NOT_FOUND')",
        f"{name}_f AS ({near(f'{name}_r', radius, near_of)} UNION ALL {page_tables(f'{name}_r')})",
        f"{name}_b AS (SELECT query_id, rank, 0 AS part, 0 AS pos, concat('[', rank, '] ', {LABEL.format('')}body) AS block FROM {name}_j WHERE signal <> 'NOT_FOUND' UNION ALL SELECT query_id, rank, part, pos, concat('[', rank, '+adj] ', {LABEL.format('x.')}x.body) FROM {name}_f JOIN (SELECT chunk_id AS ctx_id, fiscal_year, {PAGE} AS page, section_breadcrumb, {BODY} AS body FROM chunks) x USING (ctx_id))",
        f"{name}_c AS (SELECT query_id, string_agg(block, {join} ORDER BY rank, part, pos, block) AS context FROM {name}_b GROUP BY 1)",
        f"{name}_w AS (SELECT query_id, left(string_agg(concat('[', rank, '] ', {LABEL.format('')}CASE WHEN length(body) <= 2000 THEN body ELSE left(body, 1500) END), concat(chr(10), chr(10)) ORDER BY rank), 4000) AS seen FROM {name}_j GROUP BY 1)",
        f"{name}_a AS (SELECT q.*, CASE WHEN {shared('question', 'context')} >= 0.3 THEN trim('See ' || left(context, 80)) END AS said, seen FROM requests q LEFT JOIN {name}_c USING (query_id) LEFT JOIN {name}_w USING (query_id))",
        f"{name} AS (SELECT query_id, question, power, coalesce(said, '{NO_ANSWER}') AS answer, said IS NULL AS abstained, CASE WHEN said IS NOT NULL THEN contains(coalesce(seen, ''), substr(said, 5, 80)) END AS faithful FROM {name}_a)",
    )


INSTRUCTED = "concat('Find passages of reports that answer the question.', chr(10), 'Question: ', {0})"
ASKED = (
    f"hmanifest AS MATERIALIZED (SELECT * REPLACE ({hashed('embed_text')} AS embedding) FROM manifest)",
    "requests AS (SELECT item_id AS query_id, trim(coalesce(text, '')) AS question, item_id % 2 = 1 AS power, nullif(regexp_extract(text, '\\b(20\\d\\d-20\\d\\d)\\b', 1), '') AS want_fy FROM benchmark WHERE trim(coalesce(text, '')) <> '')",
    "worded AS (SELECT query_id AS of, power, want_fy, unnest(l) AS question, generate_subscripts(l, 1) - 1 AS variant FROM (SELECT *, list_concat([question], list_filter([lower(question), list_last(string_split(question, ' ')), question], lambda x: trim(x) <> '' AND trim(x) <> trim(question))) AS l FROM requests))",
    f"coded AS MATERIALIZED (SELECT *, of * 10 + variant AS query_id, {hashed(INSTRUCTED.format('question'))} AS qvec FROM worded)",
    "plain AS (SELECT * FROM coded WHERE NOT power)",
    "wide AS (SELECT * FROM coded WHERE power)",
    NUMBERED,
    *hybrid("h1", 5, "plain", ON_YEAR, "hmanifest"),
    *reranked("r1", "h1", "plain", 5),
    *answered("a1", "r1", 1),
    *hybrid("h2", 10, "wide", ON_YEAR, "hmanifest"),
    *reranked("r2", "h2", "wide", 10),
    *answered("a2", "r2", 3),
    "early AS MATERIALIZED (SELECT *, 1 AS search_stage FROM a1 WHERE NOT power UNION ALL SELECT *, 2 FROM a2 WHERE power)",
    f"again AS MATERIALIZED (SELECT query_id, q.question, want_fy, {hashed(INSTRUCTED.format('q.question'))} AS qvec, {hashed('concat(' + chr(39) + 'It is said that ' + chr(39) + ', q.question)')} AS hvec, array_to_string(list_transform(range(1, least(5, len(d)) + 1), lambda i: d[i]), ' ') AS keywords FROM (SELECT *, list_filter({TOKENS.format('question')}, lambda x, i: list_position({TOKENS.format('question')}, x) = i) AS d FROM requests) q JOIN early e USING (query_id) WHERE e.abstained)",
    *hyde("y", 50, ON_YEAR, "again", "hmanifest"),
    bm25("w", 50, ON_YEAR, "keywords", "again"),
    fused("z1", "y", "w"),
    "free AS (SELECT * FROM again WHERE want_fy IS NOT NULL)",
    dense("u", 25, asked="free", rows="hmanifest"),
    fused("z2", "z1", "u"),
    deduplicated("z", "z2", 10),
    *answered("a3", "z", 3),
    "taken AS (SELECT * FROM a3 WHERE NOT abstained AND query_id IN (SELECT query_id FROM again))",
)
SOURCE = "query_id, rank, fiscal_year, chunk_type, page, section_breadcrumb, coalesce(table_title, '') AS table_title, round(score, 4) AS score, left(body, 300) AS snippet, signal"

ORACLES: dict[str, str] = {
    "chunk_scan": query("SELECT chunk_id, chunk_type, fiscal_year, text FROM chunks WHERE chunk_type IN ('narrative', 'table')"),
    "chunk_dedupe": query("SELECT concat_ws('_', source_file, chunk_type) AS chunk_id, max(ord) AS line, arg_max(fiscal_year, ord) AS fiscal_year FROM chunks GROUP BY 1"),
    "type_counts": query("SELECT chunk_type, count(*) AS n FROM chunks WHERE chunk_type IN ('narrative', 'table') GROUP BY 1"),
    "embed_text": query(f"SELECT chunk_id, {PAGE} AS page, CAST(length({EMBED}) AS INT) AS embed_chars, md5({EMBED}) AS text_md5 FROM chunks"),
    "bm25_text": query(f"SELECT chunk_id, md5({LEXICAL}) AS text_md5, length({LEXICAL}) AS n FROM chunks"),
    "query_text": query("SELECT query_id, md5(concat('Find passages of reports that answer the question.', chr(10), 'Question: ', question)) AS text_md5 FROM questions"),
    "tokenize_counts": f"SELECT term, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY 1",
    "keyword_fallback": f"SELECT conv_id, turn, {KEYWORDS.format('text')} AS keywords FROM conversations",
    "resume_todo": query("SELECT chunk_id FROM chunks WHERE chunk_type IN ('narrative', 'table') AND chunk_id NOT IN (SELECT chunk_id FROM manifest WHERE embedding IS NOT NULL)"),
    "index_per_type": query("SELECT chunk_id, chunk_type, index, row_number() OVER (PARTITION BY chunk_type ORDER BY index) - 1 AS local_index, page, CAST(length(embed_text) AS INT) AS embed_chars, table_title FROM manifest"),
    "bm25_stats": query("SELECT term, df, round(idf, 6) AS idf FROM terms"),
    "bm25_scores": query("SELECT query_id, index, round(score, 5) AS score FROM s", scores("s")),
    "bm25_topk": query(out("r"), bm25("r", 10)),
    "bm25_topk_filtered": query(out("r"), bm25("r", 10, ON_FILTER)),
    "dense_topk": query(out("r", 5), dense("r", 10)),
    "dense_topk_filtered": query(out("r", 5), dense("r", 10, ON_FILTER)),
    "vector_functions": "SELECT vec_id, round(2 * d, 5) AS dot, round(d / sqrt(d), 5) AS cosine FROM (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS d FROM embeddings)",
    "rrf_fuse": query(out("r"), dense("d", 20), bm25("b", 20), fused("r", "d", "b")),
    "rrf_nested": query(out("r"), dense("d", 20), bm25("b", 20), dense("h", 20, vec="hvec"), fused("f", "d", "b"), fused("r", "f", "h")),
    "hybrid_topk": query(out("r"), *FIVE),
    "multi_query_merge": query(
        "SELECT query_id, rank, round(score, 5) AS score, index, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY variant, was) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY variant, was) AS k FROM (SELECT query_id, 0 AS variant, rank AS was, score, index, chunk_id FROM r UNION ALL SELECT query_id, 1, rank, score, index, chunk_id FROM v)) WHERE k = 1) WHERE rank <= 5",
        *FIVE,
        f"other AS (SELECT item_id AS query_id, {KEYWORDS.format('text')} AS question, e.embedding AS qvec FROM benchmark LEFT JOIN embeddings e ON e.vec_id = item_id + 1)",
        *hybrid("v", 5, "other"),
    ),
    "dedup_greedy": query(out("k"), *hybrid("r", 20), deduplicated("k", "r")),
    "edge_reorder": query(out("k"), *FIVE, reordered("k", "r")),
    "hyde_pipeline": query(out("y"), *hyde("y", 5)),
    "stage3_pipeline": query(
        f"SELECT query_id, rank, round(score, 5) AS score, index, concat_ws(' ', z.chunk_id, (SELECT string_agg(o.chunk_id, ' ' ORDER BY o.ord) FROM paged o JOIN paged c ON c.chunk_id = z.chunk_id AND o.fiscal_year = c.fiscal_year AND o.page = c.page AND o.chunk_id <> c.chunk_id)) AS chunk_id FROM z",
        f"paged AS (SELECT chunk_id, ord, fiscal_year, {PAGE} AS page FROM chunks)",
        *hyde("y", 50, ON_YEAR),
        bm25("w", 50, ON_YEAR, "keywords"),
        fused("z1", "y", "w"),
        "free AS (SELECT * FROM questions WHERE want_fy IS NOT NULL)",
        dense("u", 25, asked="free"),
        fused("z2", "z1", "u"),
        deduplicated("z", "z2", 10),
    ),
    "listwise_rerank_apply": query(
        "SELECT query_id, CASE WHEN query_id % 3 = 0 THEN rank ELSE place END AS rank, round(CASE WHEN query_id % 3 = 0 THEN score WHEN rank IN (1, 3) THEN n - place + 1 ELSE 0 END, 5) AS score, index, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE rank WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END, rank) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM r)",
        *FIVE,
    ),
    "rerank_pairs": query(
        "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rank, round(s, 5) AS score, index, chunk_id FROM p",
        *hybrid("r", 10),
        f"p0 AS (SELECT r.*, question, trim(concat_ws(chr(10), nullif(coalesce(section_breadcrumb, ''), ''), left({BODY}, 2000))) AS doc FROM r JOIN chunks USING (chunk_id) JOIN questions USING (query_id))",
        f"p AS (SELECT *, {OVERLAP} AS s FROM p0)",
    ),
    "expand_parent_child": query(PARENT, *FIVE, OWN),
    "expand_full_page": query(f"SELECT query_id, rank, 5 AS part, c.ord AS pos, c.chunk_id AS ctx_id FROM own JOIN chunks c ON c.fiscal_year = own.fiscal_year AND coalesce(nullif(c.page_number, 0), nullif(c.start_page, 0)) = own.page AND c.chunk_id <> own.chunk_id", *FIVE, OWN),
    "expand_neighbours": query(near("r", 3), *FIVE, NUMBERED),
    "expand_same_page_tables": query(page_tables("r"), *FIVE),
    "expand_policy": query("SELECT * FROM found", *FIVE, REL, NUMBERED, FOUND),
    "verdict_normalise": f"SELECT conv_id, turn, CASE WHEN {NORMAL} LIKE 'YES%' THEN 'YES' WHEN {NORMAL} LIKE '%ADJACENT%' OR {NORMAL} LIKE 'NEED%' THEN 'NEED_ADJACENT' ELSE 'NOT_FOUND' END AS signal FROM conversations",
    "id_parts": query("SELECT chunk_id, CASE WHEN chunk_id LIKE '%#_%' ESCAPE '#' AND TRY_CAST(split_part(chunk_id, '_', -1) AS INT) IS NOT NULL THEN split_part(chunk_id, '_', 1) END AS prefix, CASE WHEN chunk_id LIKE '%#_%' ESCAPE '#' THEN TRY_CAST(split_part(chunk_id, '_', -1) AS INT) END AS number FROM (SELECT chunk_id FROM chunks UNION ALL SELECT concat_ws('_', source, lang) FROM documents)"),
    "image_decode": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END AS mime, md5(text) AS data_md5 FROM documents",
    "two_way_softmax": "SELECT vec_id, round(1 / (1 + exp(CAST(embedding[2] AS DOUBLE) - CAST(embedding[1] AS DOUBLE))), 6) AS p FROM embeddings",
    "reduce_context": query(
        "SELECT query_id, md5(string_agg(block, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank, part, pos, block)) AS context_md5, length(string_agg(block, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank, part, pos, block)) AS n FROM blocks GROUP BY 1",
        *FIVE,
        REL,
        NUMBERED,
        FOUND,
        DESCRIBED,
        f"blocks AS (SELECT query_id, rank, 0 AS part, 0 AS pos, concat('[', rank, '] ', {LABEL.format('')}body) AS block FROM shown WHERE rank % 3 <> 0 UNION ALL SELECT query_id, rank, part, pos, concat('[', rank, '+adj] ', {LABEL.format('x.')}x.body) FROM found JOIN (SELECT chunk_id AS ctx_id, fiscal_year, {PAGE} AS page, section_breadcrumb, {BODY} AS body FROM chunks) x USING (ctx_id))",
    ),
    "faithfulness_context": query(
        "SELECT query_id, md5(left(t, 4000)) AS context_md5, length(left(t, 4000)) AS n FROM (SELECT query_id, string_agg(block, concat(chr(10), chr(10)) ORDER BY rank) AS t FROM blocks GROUP BY 1)",
        *FIVE,
        DESCRIBED,
        f"blocks AS (SELECT query_id, rank, concat('[', rank, '] ', {LABEL.format('')}CASE WHEN length(body) <= 2000 THEN body ELSE left(body, 1500) END) AS block FROM shown)",
    ),
    "source_rows": query(
        f"SELECT query_id, rank, fiscal_year, chunk_type, page, section_breadcrumb, coalesce(table_title, '') AS table_title, round(score, 4) AS score, left(body, 300) AS snippet, full_text, CASE WHEN rank < 5 THEN {SIGNAL} ELSE 'UNKNOWN' END AS signal FROM shown", *FIVE, DESCRIBED
    ),
    "format_results": query(
        "SELECT query_id, rank, printf('%.4f', score) AS score_text, fiscal_year, chunk_type, CASE WHEN chunk_type = 'table' THEN coalesce('Table: ' || left(nullif(table_title, ''), 55), 'Table') ELSE coalesce('p.' || CAST(nullif(page, 0) AS VARCHAR), '') END AS label, left(coalesce(section_breadcrumb, ''), 70) AS breadcrumb, concat(replace(left(told, 300), chr(10), ' '), CASE WHEN length(told) > 300 THEN '...' ELSE '' END) AS snippet FROM (SELECT *, CASE WHEN chunk_type = 'table' THEN body ELSE full_text END AS told FROM shown)",
        *FIVE,
        DESCRIBED,
    ),
    "ask_staged": query(
        "SELECT query_id, question, answer, abstained, faithful, CAST(NULL AS VARCHAR) AS faithfulness_issues, false AS clarification_needed, CAST(NULL AS VARCHAR) AS clarification_question, search_stage, CAST(NULL AS VARCHAR) AS error FROM (SELECT query_id, question, answer, abstained, faithful, CASE WHEN abstained THEN 3 ELSE search_stage END AS search_stage FROM early WHERE query_id NOT IN (SELECT query_id FROM taken) UNION ALL SELECT query_id, question, answer, abstained, faithful, 3 FROM taken) UNION ALL SELECT item_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'No question provided' FROM benchmark WHERE trim(coalesce(text, '')) = ''",
        *ASKED,
    ),
    "ask_sources": query(
        f"SELECT {SOURCE} FROM a1_j WHERE query_id NOT IN (SELECT query_id FROM taken) UNION ALL SELECT {SOURCE} FROM a2_j WHERE query_id NOT IN (SELECT query_id FROM taken) UNION ALL SELECT {SOURCE} FROM a3_j WHERE query_id IN (SELECT query_id FROM taken)",
        *ASKED,
    ),
}

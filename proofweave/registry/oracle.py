"""DuckDB SQL that states each registered query's result independently."""

from __future__ import annotations

from proofweave import constants as K
from proofweave.functions.identity import ChunkerConfig

AS_OF = "TIMESTAMP '2026-06-30 00:00:00'"

# The same whitespace classes as the column expressions, in RE2 form.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
INLINE = r"\t \x1F\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
ANY = r"\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}" + INLINE


def words(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{ANY}]+|[{ANY}]+$', '', 'g')"


def normalize(x: str) -> str:
    x = rf"regexp_replace({x}, '{LINE_BREAK}', E'\n', 'g')"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '[{INLINE}]*\n[{INLINE}]*', E'\n', 'g')"
    return rf"regexp_replace({strip(x)}, '\n{{3,}}', E'\n\n', 'g')"


def format_uuid(h: str) -> str:
    parts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return "(" + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in parts) + ")"


def text_uuid(x: str) -> str:
    return format_uuid(f"md5({x})")


def raw_uuid(x: str) -> str:
    return f"unhex(replace({x}, '-', ''))"


def framed(*parts: str) -> str:
    return " || ".join(f"unhex(printf('%016x', octet_length({p}))) || {p}" for p in parts)


def uuid5(name: str) -> str:
    h = f"sha1(unhex('{K.VERSION_NAMESPACE.replace('-', '')}') || encode({name}))"
    variant = f"substr('89ab', (('0x' || substr({h}, 17, 1))::INT % 4) + 1, 1)"
    return format_uuid(
        f"(substr({h}, 1, 12) || '5' || substr({h}, 14, 3) || {variant} || substr({h}, 18, 15))"
    )


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{K.TOKEN_PATTERN}')"


def search_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{K.WORD_PATTERN}')"


def title(x: str) -> str:
    return rf"regexp_extract({x}, '^[^.\n]*')"


def focused(x: str) -> str:
    kept = (
        f"list_filter({tokens(x)}, lambda t: NOT list_contains([{words(K.NOISE_WORDS)}], t)"
        f" AND length(t) >= {K.MIN_FOCUS_LENGTH})"
    )
    joined = f"array_to_string(({kept})[1:{K.FOCUS_TERMS}], ' ')"
    return f"CASE WHEN len({kept}) > 0 AND {joined} <> lower({x}) THEN {joined} END"


CONFIG = ChunkerConfig()
STOP = f"[{words(K.ENGLISH_STOP_WORDS)}]"

# name -> (names it reads, select)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, reads: tuple[str, ...], select: str) -> None:
    CTES[name] = (reads, select)


def build(select: str, *reads: str) -> str:
    """Prefix ``select`` with the named expressions it needs, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in reads:
        visit(name)
    if not ordered:
        return select
    body = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in ordered)
    return f"WITH {body}\n{select}"


cte(
    "editions",
    (),
    f"""
    WITH labelled AS (
      SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
    twice AS (
      SELECT *, 'v1' AS version_label, '' AS addition, 0 AS delay FROM labelled
      UNION ALL
      SELECT *, 'v2', E'\\nRevised.', 30 FROM labelled WHERE quality IS NOT NULL)
    SELECT doc_id, {text_uuid('source')} AS enterprise_id,
      {text_uuid("'doc:' || doc_id")} AS document_id,
      {title('text')} AS title, 'corpus://documents/' || doc_id AS source_uri, version_label,
      {normalize('text || addition')} AS normalized,
      TIMESTAMP '2024-01-01' + to_days((doc_id % 900)::INT) + to_days(delay) AS published_at,
      coalesce(0.70::DOUBLE + quality * 0.25::DOUBLE, 0.85::DOUBLE) AS source_authority,
      coalesce(0.9::DOUBLE - toxic * 0.3::DOUBLE, 0.9::DOUBLE) AS extraction_quality,
      CASE WHEN quality = 1 THEN ['group:' || lang, 'role:builder']
           ELSE ['group:' || lang] END AS principals
    FROM twice""",
)
cte(
    "identified",
    ("editions",),
    f"""
    SELECT *, {uuid5("enterprise_id || ':' || document_id || ':' || version_hash")} AS version_id
    FROM (SELECT *, sha256({framed(raw_uuid('document_id'), 'encode(version_label)',
                                   'encode(normalized)')}) AS version_hash
          FROM editions WHERE normalized <> '')""",
)


def chunked(source: str) -> str:
    return f"""
    SELECT *, sha256({framed(raw_uuid('enterprise_id'), 'unhex(version_hash)', 'encode(locator)',
                             'encode(content)', f"unhex('{CONFIG.hash_hex}')")}) AS chunk_id
    FROM (
      SELECT *, 'char:' || start_offset || '-' || end_offset || ':ordinal:' || ordinal AS locator
      FROM (
        SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY start_offset) - 1 AS ordinal
        FROM (
          SELECT * EXCLUDE (normalized), least(start_offset + {CONFIG.size}, length(normalized))
              AS end_offset,
            {strip(f'substr(normalized, start_offset + 1, {CONFIG.size})')} AS content
          FROM (SELECT *, unnest(range(0, length(normalized), {CONFIG.step})) AS start_offset
                FROM {source}))
        WHERE content <> ''))"""


cte("all_chunks", ("identified",), chunked("identified"))
cte(
    "active",
    ("identified",),
    """SELECT * FROM identified
       QUALIFY row_number() OVER (PARTITION BY enterprise_id, document_id
                                  ORDER BY version_label DESC) = 1""",
)
cte("chunks", ("active",), chunked("active"))
cte(
    "asked_questions",
    (),
    f"""
    SELECT 'turn-' || conv_id || '-' || turn AS question_id,
      {text_uuid(f"'src' || (conv_id % 20)")} AS enterprise_id,
      'user-' || conv_id AS actor_id,
      CASE WHEN conv_id % 2 = 0 THEN ['group:en', 'role:builder'] ELSE ['group:en'] END
        AS principals,
      text AS query_text
    FROM conversations WHERE role = 'user'
    UNION ALL
    SELECT CASE WHEN quality IS NULL THEN 'values-' ELSE 'title-' END || doc_id,
      {text_uuid('source')}, 'reader-' || lang, ['group:' || lang],
      CASE WHEN quality IS NULL THEN {title('text')} || ': what is the '
          || CASE WHEN lang = 'en' THEN 'total' ELSE 'average' END || ' of the values?'
        ELSE {title('text')} END
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
cte(
    "judged_questions",
    ("asked_questions",),
    f"""
    SELECT *, concat_ws('; ',
        CASE WHEN length(query_text) NOT BETWEEN {K.MIN_QUERY} AND {K.MAX_QUERY} THEN 'query length' END,
        CASE WHEN {strip('query_text')} = '' THEN 'blank query' END) AS reason
    FROM asked_questions""",
)
cte(
    "questions",
    ("judged_questions",),
    "SELECT * EXCLUDE (reason) FROM judged_questions WHERE reason = ''",
)


cte(
    "compute_questions",
    (),
    """
    SELECT 'order-' || o_orderkey AS question_id,
      'How many days between ' || strftime(o_orderdate, '%Y-%m-%d') || ' and '
        || strftime(max(l_shipdate), '%Y-%m-%d') || '?' AS query_text
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate
    UNION ALL
    SELECT 'event-' || event_id,
      'What is the ' || CASE WHEN event_type IN ('purchase', 'click') THEN 'total'
        ELSE 'average' END || ' of ' || printf('%.2f', value) || ' and -'
        || regexp_extract(props, '[0-9]+') || '?'
    FROM events""",
)
cte(
    "all_questions",
    ("questions", "compute_questions"),
    """SELECT question_id, query_text FROM questions
       UNION ALL SELECT question_id, query_text FROM compute_questions""",
)
cte(
    "question_words",
    ("all_questions",),
    rf"""
    SELECT question_id, pos, word, lower(regexp_replace(word, '[^a-zA-Z]', '', 'g')) AS bare FROM (
      SELECT question_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (
        SELECT question_id, list_filter(regexp_split_to_array(query_text, '[{ANY}]+'),
            lambda x: x <> '') AS w FROM all_questions))""",
)


def longest_block(alo: str, ahi: str, blo: str, bhi: str) -> str:
    """Longest common block of entry[alo:ahi] and bare[blo:bhi], the first of
    equals: its length, 99 - start in entry and 99 - start in bare in two digits each."""
    return f"""list_max(flatten(list_transform(range({alo}, {ahi}), lambda i: flatten(
      list_transform(range({blo}, {bhi}), lambda j: list_transform(
        range(1, least({ahi} - i, {bhi} - j) + 1), lambda k: CASE
          WHEN substr(entry, (i + 1)::BIGINT, k::BIGINT) = substr(bare, (j + 1)::BIGINT, k::BIGINT)
          THEN k * 10000 + (99 - i) * 100 + 99 - j END))))))"""


cte(
    "nearest_words",
    ("question_words",),
    f"""
    WITH RECURSIVE near AS (
      SELECT bare, entry FROM (SELECT DISTINCT bare FROM question_words
                               WHERE length(bare) >= {K.MIN_SPELLED_LENGTH}),
        (SELECT unnest([{words(K.SPELLING_LEXICON)}]) AS entry)
      -- letters in common, in any order, bound the ratio from above
      WHERE 2.0::DOUBLE * least(length(bare), length(entry)) >= {K.SPELLING_CUTOFF} * (length(bare) + length(entry))
        AND 2.0::DOUBLE * list_sum(list_transform(list_distinct(string_split(entry, '')), lambda c: least(
              length(entry) - length(replace(entry, c, '')), length(bare) - length(replace(bare, c, '')))))
            >= {K.SPELLING_CUTOFF} * (length(bare) + length(entry))),
    blocks AS (
      SELECT *, {longest_block('alo', 'ahi', 'blo', 'bhi')} AS best
      FROM (SELECT bare, entry, 0::BIGINT AS alo, length(entry) AS ahi, 0::BIGINT AS blo, length(bare) AS bhi FROM near)
      UNION ALL
      SELECT *, {longest_block('alo', 'ahi', 'blo', 'bhi')} AS best
      FROM (
        SELECT bare, entry, CASE WHEN side = 0 THEN alo ELSE a + k END AS alo,
          CASE WHEN side = 0 THEN a ELSE ahi END AS ahi, CASE WHEN side = 0 THEN blo ELSE b + k END AS blo,
          CASE WHEN side = 0 THEN b ELSE bhi END AS bhi
        FROM (SELECT *, best // 10000 AS k, 99 - (best // 100) % 100 AS a, 99 - best % 100 AS b,
                unnest([0, 1]) AS side FROM blocks WHERE best IS NOT NULL))
      WHERE alo < ahi AND blo < bhi),
    ratios AS (
      SELECT bare, entry, 2.0::DOUBLE * sum(best // 10000) / (length(bare) + length(entry)) AS ratio
      FROM blocks WHERE best IS NOT NULL GROUP BY bare, entry)
    SELECT bare, entry FROM (
      SELECT *, row_number() OVER (PARTITION BY bare ORDER BY ratio DESC, entry DESC) AS place
      FROM ratios WHERE ratio >= {K.SPELLING_CUTOFF})
    WHERE place = 1 AND entry <> bare""",
)
cte(
    "corrections",
    ("question_words", "nearest_words"),
    """
    SELECT question_id, string_agg(CASE WHEN entry IS NULL THEN word
        ELSE replace(lower(word), bare, entry) END, ' ' ORDER BY pos) AS corrected_query
    FROM question_words LEFT JOIN nearest_words USING (bare)
    GROUP BY question_id HAVING count(entry) > 0""",
)
cte(
    "spelled_questions",
    ("questions", "corrections"),
    """SELECT question_id, enterprise_id, actor_id, principals, query_text,
         coalesce(corrected_query, query_text) AS effective_text
       FROM questions LEFT JOIN corrections USING (question_id)""",
)
cte(
    "spelled_all",
    ("all_questions", "corrections"),
    """SELECT question_id, query_text, coalesce(corrected_query, query_text) AS effective_text
       FROM all_questions LEFT JOIN corrections USING (question_id)""",
)


def hashed(name: str, source: str, key: str, text: str) -> None:
    """Sparse unit vectors of ``source``: (key, idx, val)."""
    cte(
        name,
        (source,),
        f"""
        WITH toks AS (
          SELECT {key}, unnest(CASE WHEN len({tokens(text)}) > 0 THEN {tokens(text)}
                               ELSE [lower({text})] END) AS token FROM {source}),
        table_ AS (
          SELECT token, ('0x' || substr(h, 1, 8))::BIGINT % {K.EMBEDDING_DIMENSION} AS i1,
            ('0x' || substr(h, 9, 8))::BIGINT % {K.EMBEDDING_DIMENSION} AS i2,
            (CASE WHEN ('0x' || substr(h, 17, 2))::INT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)
              * (1.0::DOUBLE + (('0x' || substr(h, 19, 2))::INT % 31)::DOUBLE / 100.0::DOUBLE) AS w
          FROM (SELECT token, sha256(token) AS h FROM (SELECT DISTINCT token FROM toks))),
        counted AS (SELECT {key}, token, count(*) AS n FROM toks GROUP BY ALL),
        cells AS (
          SELECT {key}, idx, sum(w) AS val FROM (
            SELECT {key}, i1 AS idx, n * w AS w FROM counted JOIN table_ USING (token)
            UNION ALL
            SELECT {key}, i2, n * w / 2 FROM counted JOIN table_ USING (token))
          GROUP BY ALL)
        SELECT {key}, idx,
          CAST(round(CASE WHEN norm = 0 THEN 0 ELSE val / norm END, 8) AS FLOAT)::DOUBLE AS val
        FROM (SELECT *, sqrt(sum(val * val) OVER (PARTITION BY {key})) AS norm FROM cells)
        WHERE abs(val) > 1e-12""",
    )


hashed("chunk_vectors", "chunks", "chunk_id", "content")
hashed("edition_vectors", "all_chunks", "chunk_id", "content")
hashed("question_vectors", "questions", "question_id", "query_text")
cte(
    "vector_scores",
    ("chunks", "questions", "chunk_vectors", "question_vectors"),
    """
    WITH visible AS (
      SELECT q.question_id, c.chunk_id FROM questions q
      JOIN chunks c ON c.enterprise_id = q.enterprise_id
        AND list_has_any(c.principals, q.principals)),
    dots AS (
      SELECT v.question_id, v.chunk_id, sum(a.val * b.val) AS dot
      FROM visible v JOIN question_vectors a ON a.question_id = v.question_id
      JOIN chunk_vectors b ON b.chunk_id = v.chunk_id AND b.idx = a.idx
      GROUP BY ALL),
    qn AS (SELECT question_id, sqrt(sum(val * val)) AS n FROM question_vectors GROUP BY ALL),
    cn AS (SELECT chunk_id, sqrt(sum(val * val)) AS n FROM chunk_vectors GROUP BY ALL)
    SELECT v.question_id, v.chunk_id, round(coalesce(dot, 0) / (qn.n * cn.n), 8) + 0 AS score
    FROM visible v LEFT JOIN dots USING (question_id, chunk_id)
    JOIN qn USING (question_id) JOIN cn USING (chunk_id)""",
)
cte(
    "vector_ranked",
    ("vector_scores",),
    f"""SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id)
          AS vec_rank FROM vector_scores QUALIFY vec_rank <= {K.CANDIDATE_LIMIT}""",
)
cte(
    "attempts",
    ("spelled_questions",),
    f"""
    SELECT question_id, 'full' AS form, enterprise_id, principals, effective_text AS query_text
    FROM spelled_questions
    UNION ALL
    SELECT * FROM (SELECT question_id, 'focused', enterprise_id, principals,
                     {focused('effective_text')} AS query_text FROM spelled_questions)
    WHERE query_text IS NOT NULL""",
)
def lexical_scores(form: str = "term", forms: str = "") -> str:
    """Scores of chunks that hold all terms; ``form`` stands for a word in the match."""
    return f"""
    WITH terms AS (
      SELECT DISTINCT question_id, form, enterprise_id, principals, {form} FROM (
        SELECT *, unnest({search_words('query_text')}) AS term FROM attempts) {forms}
      WHERE NOT list_contains({STOP}, term)),
    wanted AS (SELECT question_id, form, count(*) AS n FROM terms GROUP BY ALL),
    body AS (
      SELECT chunk_id, enterprise_id, principals, title, term, pos FROM (
        SELECT chunk_id, enterprise_id, principals, title,
          unnest({search_words('content')}) AS term,
          unnest(range(1, len({search_words('content')}) + 1)) AS pos FROM chunks)
      WHERE NOT list_contains({STOP}, term)),
    shifts AS (
      SELECT c.chunk_id, c.enterprise_id, c.principals, c.title, coalesce(max(b.pos), 0) AS shift
      FROM chunks c LEFT JOIN body b USING (chunk_id) GROUP BY ALL),
    heads AS (
      SELECT chunk_id, enterprise_id, principals, term, pos + shift AS pos FROM (
        SELECT *, unnest({search_words('title')}) AS term,
          unnest(range(1, len({search_words('title')}) + 1)) AS pos FROM shifts)
      WHERE NOT list_contains({STOP}, term)),
    placed AS (
      SELECT chunk_id, enterprise_id, principals, {form}, pos FROM (
        SELECT chunk_id, enterprise_id, principals, term, pos FROM body
        UNION ALL SELECT * FROM heads) {forms}),
    hits AS (
      SELECT t.question_id, t.form, p.chunk_id, p.term, p.pos FROM terms t
      JOIN placed p ON p.enterprise_id = t.enterprise_id AND p.term = t.term
        AND list_has_any(p.principals, t.principals)),
    matched AS (
      SELECT question_id, form, chunk_id, n FROM hits JOIN wanted USING (question_id, form)
      GROUP BY ALL HAVING count(DISTINCT term) = n),
    occ AS (SELECT h.*, n FROM hits h JOIN matched USING (question_id, form, chunk_id)),
    lasts AS (
      SELECT e.question_id, e.form, e.chunk_id, e.n, e.pos AS fin, o.term, max(o.pos) AS pos
      FROM occ e JOIN occ o ON o.question_id = e.question_id AND o.form = e.form
        AND o.chunk_id = e.chunk_id AND o.pos <= e.pos
      GROUP BY ALL),
    spans AS (
      SELECT question_id, form, chunk_id, fin, min(pos) AS start FROM lasts
      GROUP BY question_id, form, chunk_id, fin, n HAVING count(*) = n),
    minimal AS (
      SELECT question_id, form, chunk_id, start, min(fin) AS fin FROM spans GROUP BY ALL),
    weighed AS (
      SELECT m.question_id, m.form, m.chunk_id, m.start, m.fin, count(*) AS inside
      FROM minimal m JOIN occ o ON o.question_id = m.question_id AND o.form = m.form
        AND o.chunk_id = m.chunk_id AND o.pos BETWEEN m.start AND m.fin
      GROUP BY ALL)
    SELECT question_id, form, chunk_id,
      round(sum(1.0::DOUBLE / (2 + fin - start - inside)), 8) AS score
    FROM weighed GROUP BY ALL"""


def suffix_step(rules, word: str) -> str:
    """The rule of the longest suffix that ``word`` ends with."""
    cases = ""
    for suffix, new, region, before in sorted(rules, key=lambda rule: -len(rule[0])):
        preceded = f" AND regexp_matches({word}, '[{before}]{suffix}$')" if before else ""
        cases += f"""
          WHEN ends_with({word}, '{suffix}') THEN CASE
            WHEN length({word}) - {len(suffix)} >= r{region}{preceded}
            THEN {word}[:-{len(suffix) + 1}] || '{new}' ELSE {word} END"""
    return f"CASE {cases} ELSE {word} END"


def word_stems(source: str) -> str:
    """(term, stem) of the distinct words (term) of ``source``."""
    region = f"""CASE WHEN regexp_matches({{0}}, '{K.STEM_REGION}')
          THEN length(regexp_extract({{0}}, '{K.STEM_REGION}')) ELSE length({{0}}) END"""
    known = " ".join(f"WHEN '{word}' THEN '{stem}'" for word, stem in K.STEM_EXCEPTIONS)
    return f"""
    SELECT term, CASE
        WHEN NOT regexp_matches(term, '^[a-z][a-z][a-z]+$') THEN term
        WHEN known IS NOT NULL THEN known
        WHEN list_contains([{words(K.STEM_COMPLETE)}], a) THEN a
        ELSE replace(CASE
          WHEN ends_with(e, 'e') AND (length(e) > r2 OR length(e) > r1
            AND NOT regexp_matches(e[:-2], '{K.STEM_SHORT}')) THEN e[:-2]
          WHEN ends_with(e, 'll') AND length(e) > r2 THEN e[:-2] ELSE e END, 'Y', 'y') END AS stem
    FROM (SELECT *, {suffix_step(K.STEM_STEP_4, 'd')} AS e
    FROM (SELECT *, {suffix_step(K.STEM_STEP_3, 'c')} AS d
    FROM (SELECT *, {suffix_step(K.STEM_STEP_2, 'y')} AS c
    FROM (SELECT *, CASE WHEN regexp_matches(b, '.[^aeiouy][yY]$') THEN b[:-2] || 'i' ELSE b END AS y
    FROM (SELECT *, CASE
        WHEN regexp_matches(a, 'eedly$') THEN
          CASE WHEN length(a) - 5 >= r1 THEN a[:-4] ELSE a END
        WHEN regexp_matches(a, 'eed$') THEN
          CASE WHEN length(a) - 3 >= r1 THEN a[:-2] ELSE a END
        WHEN v IS NULL OR NOT regexp_matches(v, '[aeiouy]') THEN a
        WHEN regexp_matches(v, '(at|bl|iz)$') THEN v || 'e'
        WHEN regexp_matches(v, '{K.STEM_DOUBLE}') THEN v[:-2]
        WHEN length(v) = r1 AND regexp_matches(v, '{K.STEM_SHORT}') THEN v || 'e'
        ELSE v END AS b
    FROM (SELECT *, CASE
        WHEN regexp_matches(a, '(ing|ed)ly$') THEN regexp_replace(a, '(ing|ed)ly$', '')
        WHEN regexp_matches(a, '(ing|ed)$') THEN regexp_replace(a, '(ing|ed)$', '') END AS v
    FROM (SELECT *, CASE
        WHEN ends_with(m, 'sses') THEN m[:-3]
        WHEN ends_with(m, 'ies') OR ends_with(m, 'ied') THEN
          CASE WHEN length(m) > 4 THEN m[:-3] ELSE m[:-2] END
        WHEN ends_with(m, 'us') OR ends_with(m, 'ss') THEN m
        WHEN regexp_matches(m, '[aeiouy].+s$') THEN m[:-2] ELSE m END AS a
    FROM (SELECT *, r1 + {region.format('m[r1 + 1:]')} AS r2
    FROM (SELECT *, CASE WHEN regexp_matches(m, '{K.STEM_PREFIX}')
          THEN length(regexp_extract(m, '{K.STEM_PREFIX}')) ELSE {region.format('m')} END AS r1
    FROM (SELECT *, regexp_replace(term, '(^|[aeiouy])y', '\\1Y', 'g') AS m,
        CASE term {known} END AS known
    FROM (SELECT DISTINCT term FROM {source})))))))))))"""


cte("lexical_scores", ("attempts", "chunks"), lexical_scores())
cte(
    "stems",
    ("attempts", "chunks"),
    word_stems(f"""(
      SELECT unnest({search_words('query_text')}) AS term FROM attempts
      UNION ALL SELECT unnest({search_words('content')}) FROM chunks
      UNION ALL SELECT unnest({search_words('title')}) FROM chunks)"""),
)
cte(
    "stemmed_scores",
    ("attempts", "chunks", "stems"),
    lexical_scores("stem AS term", "JOIN stems USING (term)"),
)
cte(
    "lexical_ranked",
    ("lexical_scores",),
    f"""SELECT *, row_number() OVER (PARTITION BY question_id, form
                                     ORDER BY score DESC, chunk_id) AS lex_rank
        FROM lexical_scores QUALIFY lex_rank <= {K.CANDIDATE_LIMIT}""",
)
cte(
    "fused",
    ("lexical_ranked", "vector_ranked", "attempts"),
    f"""
    SELECT *, row_number() OVER (PARTITION BY question_id, form ORDER BY rrf_score DESC,
        lex_rank ASC NULLS LAST, vec_rank ASC NULLS LAST, chunk_id) AS fused_rank
    FROM (
      SELECT question_id, form, chunk_id, lex_rank, vec_rank,
        coalesce(1.0::DOUBLE / ({K.RANK_CONSTANT} + lex_rank), 0)
          + coalesce(1.0::DOUBLE / ({K.RANK_CONSTANT} + vec_rank), 0) AS rrf_score
      FROM lexical_ranked FULL OUTER JOIN (
        SELECT a.question_id, a.form, chunk_id, vec_rank FROM vector_ranked
        JOIN attempts a USING (question_id)) USING (question_id, form, chunk_id))
    QUALIFY fused_rank <= {K.RERANK_TOP_K}""",
)
cte(
    "scored",
    ("fused", "attempts", "chunks"),
    f"""
    SELECT *, least(1.0, 0.45::DOUBLE * rerank_score + 0.35::DOUBLE * source_score
                    + 0.20::DOUBLE * rrf_score) AS support_score
    FROM (
      SELECT question_id, form, chunk_id, lex_rank, vec_rank, rrf_score, fused_rank, content,
        locator, title, version_label,
        least(1.0, rrf_score
          + CASE WHEN len(qt) = 0 THEN 0
                 ELSE len(list_intersect(qt, ct))::DOUBLE / len(qt) END
          + CASE WHEN list_has_any(qt, tt) THEN 0.2::DOUBLE ELSE 0 END) AS rerank_score,
        least(1.0, 0.45::DOUBLE * source_authority + 0.25::DOUBLE * extraction_quality
          + 0.30::DOUBLE * greatest(0.1::DOUBLE, least(1.0::DOUBLE, exp(-greatest(0::DOUBLE,
              (epoch_us({AS_OF}) - epoch_us(published_at))::DOUBLE / 86400000000.0::DOUBLE)
              / 365.0::DOUBLE)))) AS source_score
      FROM (
        SELECT f.*, c.content, c.locator, c.title, c.version_label, c.source_authority,
          c.extraction_quality, c.published_at,
          list_distinct({tokens('a.query_text')}) AS qt, list_distinct({tokens('c.content')}) AS ct,
          list_distinct({tokens('c.title')}) AS tt
        FROM fused f JOIN attempts a USING (question_id, form) JOIN chunks c USING (chunk_id)))""",
)
cte(
    "confident",
    ("scored",),
    f"""
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id, form
            ORDER BY round(support_score, 9) DESC, fused_rank) AS result_rank,
        bool_or(support_score >= {K.CONFIDENCE_THRESHOLD}) OVER w AS any_passes,
        bool_or(lex_rank IS NOT NULL) OVER w AS any_lexical
      FROM scored WINDOW w AS (PARTITION BY question_id, form))
    WHERE support_score >= {K.CONFIDENCE_THRESHOLD}
      OR (NOT any_passes AND any_lexical AND result_rank = 1)""",
)
cte(
    "retrieved",
    ("confident",),
    """SELECT * FROM (
         SELECT *, bool_or(form = 'full') OVER (PARTITION BY question_id) AS has_full
         FROM confident)
       WHERE form = 'full' OR NOT has_full""",
)

ORACLE: dict[str, str] = {}
ORACLE["validate_questions"] = build(
    "SELECT question_id, reason = '' AS is_valid, reason FROM judged_questions",
    "judged_questions",
)
ORACLE["normalize_documents"] = f"""
    SELECT doc_id, {text_uuid('source')} AS enterprise_id, {normalize('text')} AS normalized,
      length({normalize('text')}) AS n_normalized
    FROM documents WHERE {normalize('text')} <> ''"""
ORACLE["chunk_documents"] = build(
    """SELECT document_id, version_label, ordinal::INT AS ordinal,
         start_offset::INT AS start_offset, end_offset::INT AS end_offset, locator, content
       FROM all_chunks""",
    "all_chunks",
)
ORACLE["chunk_identity"] = build(
    f"""SELECT document_id, version_label, version_hash, chunk_id,
          '{CONFIG.hash_hex}' AS chunker_config_hash FROM all_chunks""",
    "all_chunks",
)
ORACLE["version_id"] = build(
    """SELECT document_id, version_label, version_hash, version_id,
         sha256(encode(lower(source_uri))) AS source_fingerprint FROM identified""",
    "identified",
)
ORACLE["hash_embedding"] = build(
    """SELECT chunk_id, count(*) AS n_nonzero, round(sum(abs(val)), 5) AS abs_sum,
         round(sum(val), 5) AS value_sum, round(sum(val * (idx % 32)), 4) AS weighted_sum
       FROM edition_vectors WHERE val <> 0 GROUP BY chunk_id""",
    "edition_vectors",
)
ORACLE["vector_topk"] = f"""
    SELECT q.vec_id AS question_id, c.vec_id AS chunk_id,
      round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 8) AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY
        round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 8) DESC,
        'vec-' || c.vec_id)::INT AS vec_rank
    FROM embeddings q JOIN embeddings c ON c.label = q.label
      AND (q.vec_id % 3 = c.vec_id % 4 OR q.vec_id = c.vec_id)
    QUALIFY vec_rank <= {K.CANDIDATE_LIMIT}"""
ORACLE["lexical_topk"] = build(
    """SELECT question_id, form, chunk_id, score, lex_rank::INT AS lex_rank
       FROM lexical_ranked""",
    "lexical_ranked",
)
ORACLE["lexical_stemmed"] = build(
    f"""SELECT question_id, form, chunk_id, score,
          (row_number() OVER (PARTITION BY question_id, form ORDER BY score DESC, chunk_id))::INT
            AS lex_rank
        FROM stemmed_scores QUALIFY lex_rank <= {K.CANDIDATE_LIMIT}""",
    "stemmed_scores",
)
ORACLE["word_stems"] = word_stems(
    f"(SELECT unnest({search_words('text')}) AS term FROM documents)"
)
ORACLE["rrf_fusion"] = build(
    """SELECT question_id, form, chunk_id, lex_rank::INT AS lex_rank, vec_rank::INT AS vec_rank,
         round(rrf_score, 6) AS rrf_score, fused_rank::INT AS fused_rank FROM fused""",
    "fused",
)
ORACLE["rerank_support"] = build(
    """SELECT question_id, form, chunk_id, fused_rank::INT AS fused_rank,
         round(rerank_score, 6) AS rerank_score, round(source_score, 6) AS source_score,
         round(support_score, 6) AS support_score FROM scored""",
    "scored",
)
ORACLE["confidence_filter"] = build(
    """SELECT question_id, form, chunk_id, result_rank::INT AS result_rank,
         round(support_score, 6) AS support_score FROM confident""",
    "confident",
)
ORACLE["focused_retry"] = build(
    """SELECT question_id, chunk_id, result_rank::INT AS result_rank,
         round(support_score, 6) AS support_score FROM retrieved WHERE form = 'focused'""",
    "retrieved",
)
ORACLE["hybrid_retrieval"] = build(
    """SELECT question_id, form, chunk_id, title, version_label, locator, content,
         round(rrf_score, 6) AS rrf_score, round(rerank_score, 6) AS rerank_score,
         round(source_score, 6) AS source_score, round(support_score, 6) AS support_score,
         result_rank::INT AS result_rank FROM retrieved""",
    "retrieved",
)


# --- routing and computed answers --------------------------------------------
def routed(name: str, source: str, *columns: str) -> None:
    kept = "".join(f"{c}, " for c in columns)
    days = r"days between (\d{4}-\d{2}-\d{2}) and (\d{4}-\d{2}-\d{2})"
    cte(
        name,
        tuple(c for c in (source,) if c in CTES),
        f"""
        SELECT question_id, {kept}query_text, numbers, start_date, end_date,
          CASE WHEN start_date IS NOT NULL THEN 'compute'
               WHEN len(numbers) > 0 AND (s OR m) THEN 'compute'
               WHEN hint AND (s OR m) THEN 'retrieve-then-compute' ELSE 'rag' END AS route,
          CASE WHEN start_date IS NOT NULL THEN 'dateDifference'
               WHEN len(numbers) > 0 AND s THEN 'sum' WHEN len(numbers) > 0 AND m THEN 'mean'
               WHEN hint AND m THEN 'mean' WHEN hint AND s THEN 'sum' END AS function_name
        FROM (
          SELECT *, regexp_matches(effective_text, '(?i)\\b(sum|total)\\b') AS s,
            regexp_matches(effective_text, '(?i)\\b(mean|average)\\b') AS m,
            regexp_matches(lower(effective_text), 'worksheet|spreadsheet|table|values') AS hint,
            nullif(regexp_extract(effective_text, '(?i){days}', 1), '') AS start_date,
            nullif(regexp_extract(effective_text, '(?i){days}', 2), '') AS end_date,
            list_transform(regexp_extract_all(effective_text, '-?\\d+(?:\\.\\d+)?'),
                           lambda n: n::DOUBLE) AS numbers
          FROM {source})""",
    )


routed("routed_all", "spelled_all")
routed("routed", "spelled_questions", "enterprise_id", "actor_id", "principals")
cte(
    "computed",
    ("routed_all",),
    """
    SELECT *, function_name || ' = ' || CASE WHEN function_name = 'dateDifference'
        THEN value::BIGINT::VARCHAR ELSE format('{:g}', value) END AS answer
    FROM (
      SELECT question_id, function_name, CASE function_name
        WHEN 'sum' THEN list_reduce(numbers, lambda a, b: a + b)
        WHEN 'mean' THEN list_reduce(numbers, lambda a, b: a + b) / len(numbers)
        ELSE date_diff('day', start_date::DATE, end_date::DATE)::DOUBLE END AS value
      FROM routed_all WHERE route = 'compute')""",
)
ORACLE["spelling_correction"] = build(
    """SELECT question_id, query_text, corrected_query
       FROM all_questions JOIN corrections USING (question_id)""",
    "all_questions",
    "corrections",
)
ORACLE["route_queries"] = build(
    """SELECT question_id, route, function_name, len(numbers)::INT AS n_numbers, start_date,
         end_date FROM routed_all""",
    "routed_all",
)
ORACLE["compute_answers"] = build(
    """SELECT question_id, function_name, round(value, 6) AS value, answer,
         'sufficient' AS evidence_status, 1.0::DOUBLE AS confidence FROM computed""",
    "computed",
)

# --- answers -------------------------------------------------------------------
cte(
    "searched",
    ("retrieved", "routed"),
    "SELECT r.* FROM retrieved r JOIN routed q USING (question_id) WHERE q.route <> 'compute'",
)
cte(
    "proposed",
    ("searched",),
    f"""
    SELECT question_id, (result_rank - 1) * 4 + kind + 1 AS pos,
      CASE WHEN kind = 2 THEN sha256(chunk_id) ELSE chunk_id END AS chunk_id,
      CASE kind WHEN 0 THEN '  ' || line || ' ' WHEN 1 THEN upper(line) WHEN 2 THEN line
                ELSE '   ' END AS text
    FROM (SELECT question_id, result_rank, chunk_id, split_part(content, E'\\n', 1) AS line,
            unnest(CASE ('0x' || substr(md5(question_id), 1, 2))::INT % 4
              WHEN 2 THEN [1, 2, 3] WHEN 3 THEN [] ELSE [0, 1, 2, 3] END) AS kind
          FROM searched WHERE result_rank <= {K.CITED_CHUNKS})""",
)
cte(
    "accepted",
    ("proposed", "searched"),
    f"""
    SELECT p.question_id, p.pos, 'claim-' || p.pos AS claim_id, {strip('p.text')} AS claim_text,
      'C' || row_number() OVER (PARTITION BY p.question_id ORDER BY p.pos) AS citation_id,
      p.chunk_id, r.title, r.version_label, r.locator, round(r.support_score, 4) AS support_score
    FROM proposed p JOIN searched r ON r.question_id = p.question_id AND r.chunk_id = p.chunk_id
    WHERE {strip('p.text')} <> '' AND contains(r.content, {strip('p.text')})""",
)
NUM = r"'-?\d+(?:\.\d+)?'"
def assembled(name: str, searched: str, routed_: str, accepted: str, *columns: str) -> None:
    kept = "".join(f"{c}, " for c in columns)
    cte(
        name,
        (searched, routed_, accepted),
        f"""
    WITH lead_chunks AS (
      SELECT question_id, count(*) AS n_retrieved,
        max(CASE WHEN result_rank = 1 THEN content END) AS c1,
        max(CASE WHEN result_rank = 2 THEN content END) AS c2,
        max(CASE WHEN result_rank = 1 THEN support_score END) AS s1,
        max(CASE WHEN result_rank = 2 THEN support_score END) AS s2,
        max(CASE WHEN result_rank = 1 THEN chunk_id END) AS id1,
        max(CASE WHEN result_rank = 2 THEN chunk_id END) AS id2,
        flatten(list(regexp_extract_all(content, {NUM}) ORDER BY result_rank)
          FILTER (WHERE result_rank <= {K.NUMERIC_CHUNKS})) AS found
      FROM {searched} GROUP BY question_id),
    told AS (
      SELECT question_id, string_agg(claim_text, ' ' ORDER BY pos) AS text, count(*) AS n,
        string_agg(chunk_id, ',' ORDER BY pos) AS cited FROM {accepted} GROUP BY question_id),
    judged AS (
      SELECT q.*, coalesce(n_retrieved, 0) AS n_retrieved, c1, c2, s1, s2, id1, id2, text, n, cited,
        list_transform(found, lambda x: x::DOUBLE) AS vals,
        CASE WHEN route = 'retrieve-then-compute'
               THEN CASE WHEN len(found) > 0 THEN 'computed' ELSE 'no-numbers' END
             WHEN n > 0 THEN 'claims'
             WHEN s1 >= {K.FALLBACK_CLAIM_THRESHOLD} THEN 'fallback'
             WHEN s2 IS NOT NULL AND abs(s1 - s2) <= {K.CONFLICT_GAP}
               AND len(regexp_extract_all(c1, {NUM})) > 0 AND len(regexp_extract_all(c2, {NUM})) > 0
               AND list_sort(list_distinct(regexp_extract_all(c1, {NUM})))
                 <> list_sort(list_distinct(regexp_extract_all(c2, {NUM}))) THEN 'conflict'
             ELSE 'insufficient' END AS outcome
      FROM {routed_} q LEFT JOIN lead_chunks USING (question_id) LEFT JOIN told USING (question_id)
      WHERE route <> 'compute'),
    valued AS (
      SELECT *, CASE WHEN outcome = 'computed' THEN
          CASE WHEN function_name = 'sum' THEN list_reduce(vals, lambda a, b: a + b)
               ELSE list_reduce(vals, lambda a, b: a + b) / len(vals) END END AS value
      FROM judged)
    SELECT question_id, {kept}query_text, outcome, route, function_name,
      n_retrieved, value, CASE WHEN outcome = 'computed' THEN len(vals) ELSE 0 END AS n_values,
      CASE WHEN outcome IN ('claims', 'fallback', 'computed') THEN 'sufficient'
           WHEN outcome = 'conflict' THEN 'conflict' ELSE 'insufficient' END AS evidence_status,
      CASE outcome WHEN 'claims' THEN text WHEN 'fallback' THEN c1
        WHEN 'computed' THEN function_name || ' = ' || format('{{:g}}', value)
        WHEN 'no-numbers' THEN '{K.TEXT_NO_NUMBERS}' WHEN 'conflict' THEN '{K.TEXT_CONFLICT}'
        ELSE '{K.TEXT_INSUFFICIENT}' END AS answer,
      CASE outcome WHEN 'claims' THEN n WHEN 'fallback' THEN 1 WHEN 'computed' THEN 1 ELSE 0 END
        AS n_claims,
      CASE WHEN outcome = 'claims' THEN cited WHEN outcome = 'fallback' THEN id1
        WHEN outcome IN ('conflict', 'computed') THEN concat_ws(',', id1, id2) END AS cited_chunks
    FROM valued""",
    )


SCOPE = ("enterprise_id", "actor_id", "principals")
assembled("answered", "searched", "routed", "accepted", *SCOPE)
cte(
    "computed_rows",
    ("routed",),
    """
    SELECT question_id, enterprise_id, actor_id, principals, query_text, 'compute' AS outcome,
      route, function_name, 0 AS n_retrieved, value, len(numbers) AS n_values, 'sufficient' AS evidence_status,
      function_name || ' = ' || CASE WHEN function_name = 'dateDifference'
        THEN value::BIGINT::VARCHAR ELSE format('{:g}', value) END AS answer,
      1 AS n_claims, NULL AS cited_chunks
    FROM (
      SELECT *, CASE function_name
        WHEN 'sum' THEN list_reduce(numbers, lambda a, b: a + b)
        WHEN 'mean' THEN list_reduce(numbers, lambda a, b: a + b) / len(numbers)
        ELSE date_diff('day', start_date::DATE, end_date::DATE)::DOUBLE END AS value
      FROM routed WHERE route = 'compute')""",
)
cte(
    "answers",
    ("answered", "computed_rows"),
    "SELECT * FROM answered UNION ALL SELECT * FROM computed_rows",
)
ORACLE["retrieve_then_compute"] = build(
    """SELECT question_id, function_name, n_values::INT AS n_values, value,
         evidence_status, answer, cited_chunks
       FROM answered WHERE route = 'retrieve-then-compute'""",
    "answered",
)
ORACLE["evidence_block"] = build(
    f"""SELECT question_id, count(*) AS n_blocks,
          string_agg('chunk_id: ' || chunk_id || E'\ntitle: ' || title || E'\nversion: '
            || version_label || E'\nsupport_score: ' || printf('%.3f', support_score)
            || E'\ncontent: ' || content, E'\n\n' ORDER BY result_rank) AS evidence_block
        FROM searched WHERE result_rank <= {K.EVIDENCE_CHUNKS} GROUP BY question_id""",
    "searched",
)
ORACLE["validate_claims"] = build(
    """SELECT question_id, pos::INT AS pos, claim_id, claim_text, citation_id, chunk_id, title,
         version_label, locator, support_score FROM accepted""",
    "accepted",
)
ORACLE["answer_assembly"] = build(
    """SELECT question_id, route, evidence_status, answer, n_claims::INT AS n_claims, cited_chunks
       FROM answers""",
    "answers",
)

cte(
    "lines",
    (),
    """
    SELECT 'order-' || l_orderkey AS question_id, l_orderkey || '-' || result_rank AS chunk_id,
      result_rank, support_score, l_orderkey AS key, CASE WHEN l_returnflag = 'R' THEN 'The part came back.'
        ELSE 'Quantity ' || l_quantity::INT || ' of part ' || l_partkey || '.' END AS content
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY support_score DESC,
            l_linenumber, l_partkey, l_suppkey) AS result_rank
          FROM (SELECT *, round(0.58::DOUBLE + l_discount + l_tax, 4) AS support_score FROM lineitem))""",
)
cte(
    "line_questions",
    (),
    """SELECT 'order-' || o_orderkey AS question_id, CASE WHEN o_orderkey % 4 = 1
         THEN 'What is the total of the values?' ELSE 'Which parts were ordered?' END AS query_text,
         query_text AS effective_text FROM orders""",
)
routed("line_routed", "line_questions")
cte(
    "line_claims",
    ("lines",),
    """SELECT question_id, 1 AS pos, content AS claim_text, chunk_id FROM lines
       WHERE key % 4 = 2 AND result_rank = 1""",
)
assembled("line_answers", "lines", "line_routed", "line_claims")
ORACLE["answer_outcomes"] = build(
    """SELECT question_id, route, evidence_status, answer, n_claims::INT AS n_claims, cited_chunks
       FROM line_answers""",
    "line_answers",
)


# --- ingestion and lifecycle ----------------------------------------------------
cte(
    "requests",
    (),
    f"""
    SELECT *, CASE WHEN title_bad THEN 'title length' END AS p1,
      CASE WHEN no_principals THEN 'no principals' END AS p2,
      CASE WHEN chunk_size NOT BETWEEN 64 AND 8000 THEN 'chunk size' END AS p3,
      CASE WHEN chunk_overlap > 2000 THEN 'chunk overlap' END AS p4,
      CASE WHEN chunk_overlap >= chunk_size THEN 'overlap not below size' END AS p5,
      CASE WHEN source_authority > 1 THEN 'authority' END AS p6,
      CASE WHEN lang = 'es' THEN 'published date' END AS p7,
      CASE WHEN {strip('text')} = '' THEN 'blank content' END AS p0
    FROM (
      SELECT doc_id, text, lang, {text_uuid('source')} AS enterprise_id,
        {text_uuid("'doc:' || doc_id")} AS document_id,
        length(regexp_extract(text, '^[^.\\n]*')) NOT BETWEEN 1 AND 255 AS title_bad,
        coalesce(toxic = 1, false) AS no_principals,
        length(text) % 9000 + 64 AS chunk_size, length(text) % 2500 AS chunk_overlap,
        coalesce(0.70::DOUBLE + quality * 0.35::DOUBLE, 0.85::DOUBLE) AS source_authority,
        TIMESTAMP '2024-01-01' + to_days((doc_id % 900)::INT) AS published_at
      FROM documents LEFT JOIN labels USING (doc_id))""",
)
cte(
    "judged_requests",
    ("requests",),
    "SELECT *, concat_ws('; ', p1, p0, p2, p3, p4, p5, p6, p7) AS reason FROM requests",
)
ORACLE["validate_requests"] = build(
    """SELECT document_id, reason = '' AS is_valid, reason,
         CASE WHEN reason = '' THEN epoch_us(published_at) END AS published_micros
       FROM judged_requests""",
    "judged_requests",
)
CONFIG_HASH = (
    """sha256('{"implementationVersion":"1.0.0","name":"paragraph-window","normalization":"""
    """"nfkc-whitespace-v1","overlap":' || chunk_overlap || ',"separators":["\\n\\n","\\n",". "," "],"""
    """"size":' || chunk_size || ',"tokenizer":"unicode-codepoint"}')"""
)
cte(
    "request_versions",
    ("judged_requests",),
    f"""
    SELECT *, {uuid5("enterprise_id || ':' || document_id || ':' || version_hash")} AS version_id,
      {CONFIG_HASH} AS config_hash
    FROM (SELECT *, sha256({framed(raw_uuid('document_id'), "encode('v1')",
                                   'encode(normalized)')}) AS version_hash
          FROM (SELECT * EXCLUDE (text), {normalize('text')} AS normalized
                FROM judged_requests WHERE reason = ''))""",
)
cte(
    "request_chunks",
    ("request_versions",),
    f"""
    SELECT document_id, version_id, version_hash, ordinal, sha256({framed(
        raw_uuid('enterprise_id'), 'unhex(version_hash)',
        "encode('char:' || start_offset || '-' || end_offset || ':ordinal:' || ordinal)",
        'encode(content)', 'unhex(config_hash)')}) AS chunk_id
    FROM (
      SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY start_offset) - 1 AS ordinal
      FROM (
        SELECT *, least(start_offset + chunk_size, length(normalized)) AS end_offset,
          {strip('substr(normalized, start_offset + 1, chunk_size)')} AS content
        FROM (SELECT *, unnest(range(0, length(normalized), chunk_size - chunk_overlap))
                AS start_offset FROM request_versions))
      WHERE content <> '')""",
)
ORACLE["ingest_result"] = build(
    """SELECT document_id, version_id, version_hash, count(*) AS chunk_count,
         string_agg(chunk_id, ',' ORDER BY ordinal) AS chunk_ids, 'lang,source' AS metadata_keys,
         'active' AS status
       FROM request_chunks GROUP BY document_id, version_id, version_hash""",
    "request_chunks",
)
ORACLE["stream_ingest"] = build(
    """SELECT document_id, version_id, count(*) AS chunk_count, min(chunk_id) AS least_chunk_id
       FROM request_chunks GROUP BY document_id, version_id""",
    "request_chunks",
)
ORACLE["stream_editions"] = build(
    """SELECT document_id, CASE WHEN length(text) % 2 = 1 THEN '1.3' ELSE '1.4' END AS version_label
       FROM judged_requests WHERE reason = ''""",
    "judged_requests",
)
ORACLE["stream_repeats"] = build(
    """SELECT split, document_id, CASE WHEN length(text) % 2 = 1 THEN '1.3' ELSE '1.4' END AS version_label,
         2::BIGINT AS jobs, 2::BIGINT AS attempts
       FROM judged_requests, (VALUES ('one'), ('three')) s(split) WHERE reason = ''""",
    "judged_requests",
)
cte(
    "batched_requests",
    ("judged_requests",),
    """
    SELECT *, length(text) % 2 = 0 AS even, length(text) % 3 = 0 AS third,
      regexp_extract(text, '^[^.\\n]*') AS title
    FROM judged_requests WHERE reason = ''""",
)
ORACLE["document_upsert"] = build(
    """SELECT enterprise_id, document_id,
         title || CASE WHEN length(title) > 200 THEN '' WHEN third THEN ' anew' WHEN even THEN ' again' ELSE '' END AS title,
         'corpus://documents/' || doc_id AS source_uri, sha256('corpus://documents/' || doc_id) AS source_fingerprint,
         CASE WHEN third THEN 'anew' WHEN even THEN 'again' ELSE '' END AS note,
         CASE WHEN third OR even THEN 3 ELSE 2 END::BIGINT AS metadata_size, 0::BIGINT AS tenant_since
       FROM batched_requests""",
    "batched_requests",
)
ORACLE["version_refresh"] = build(
    """SELECT document_id, 'v1' AS version_label, CASE WHEN third THEN 'superseded' ELSE 'active' END AS status,
         round(CASE WHEN even THEN 0.5 ELSE source_authority END, 6) AS source_authority,
         epoch_us(published_at) AS published_micros, even::BIGINT AS refreshed_in
       FROM batched_requests
       UNION ALL
       SELECT document_id, 'v2', 'active', round(source_authority, 6), epoch_us(published_at), 2
       FROM batched_requests WHERE third""",
    "batched_requests",
)
ORACLE["request_attempts"] = build(
    f"""SELECT document_id,
         CASE WHEN reason <> '' THEN 'rejected' WHEN length(text) % 3 = 0 THEN 'completed' ELSE 'failed' END AS status,
         2 + (length(text) % 3 = 0)::BIGINT AS attempts,
         CASE WHEN reason <> '' THEN reason
              WHEN length(text) % 3 <> 0 THEN 'embedding dimension must be {K.EMBEDDING_DIMENSION}, received 2' END AS last_error
       FROM judged_requests""",
    "judged_requests",
)
ORACLE["activate_versions"] = build(
    """
    SELECT enterprise_id, document_id, version_id, activation_seq::INT AS activation_seq,
      CASE WHEN NOT whole THEN 'processing'
           WHEN row_number() OVER (PARTITION BY document_id ORDER BY whole DESC,
                activation_seq DESC) = 1 THEN 'active' ELSE 'superseded' END AS status,
      stored AS stored_chunks, expected AS expected_chunks
    FROM (
      SELECT i.enterprise_id, i.document_id, i.version_id,
        CASE WHEN version_label = 'v2' THEN 2 WHEN extraction_quality < 0.9 THEN 3 ELSE 1 END
          AS activation_seq, stored, expected, stored = expected AS whole
      FROM identified i JOIN (
        SELECT version_id, count(*) AS expected, count(*) FILTER (WHERE NOT (
            version_label = 'v2' AND source_authority < 0.8 AND ordinal >= 2)) AS stored
        FROM all_chunks GROUP BY version_id) USING (version_id))""",
    "identified",
    "all_chunks",
)
ORACLE["tenant_purge"] = build(
    """SELECT chunk_id, enterprise_id, unnest(principals) AS principal_id FROM all_chunks
       WHERE enterprise_id NOT IN (SELECT enterprise_id FROM identified
                                   WHERE extraction_quality < 0.9)""",
    "all_chunks",
    "identified",
)
ORACLE["acl_scope_filter"] = build(
    """SELECT scope_id, chunk_id, version_label
       FROM (SELECT DISTINCT enterprise_id || '|' || array_to_string(principals, ',') AS scope_id,
               enterprise_id, principals FROM questions) s
       JOIN chunks c ON c.enterprise_id = s.enterprise_id
         AND list_has_any(c.principals, s.principals)""",
    "questions",
    "chunks",
)
ORACLE["acl_replace"] = build(
    """SELECT chunk_id, enterprise_id, unnest(CASE WHEN version_label = 'v2'
         THEN list_append(principals, 'role:auditor') ELSE principals END) AS principal_id
       FROM all_chunks""",
    "all_chunks",
)

# --- traces, audit, retention ------------------------------------------------------
cte(
    "stamped",
    ("answers",),
    f"""
    SELECT *, {uuid5("'trace:' || name")} AS trace_id, {uuid5("'audit:' || name")} AS audit_id
    FROM (SELECT *, enterprise_id || ':' || question_id || ':'
            || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS name
          FROM (SELECT *, {AS_OF} - to_seconds(length(query_text)) AS created_at FROM answers))""",
)
cte(
    "staged",
    ("stamped",),
    f"""
    SELECT *, CASE route WHEN 'compute' THEN ['Classify', 'Claim validation']
        WHEN 'rag' THEN ['Classify', 'Scoped hybrid retrieval', 'RRF + rerank', 'Claim validation']
        ELSE ['Classify', 'Scoped hybrid retrieval', 'Claim validation'] END AS stages,
      CASE route WHEN 'compute' THEN ['compute route', 'Computed']
        WHEN 'rag' THEN ['rag route', n_retrieved || ' candidates passed the threshold',
          'Best ' || least(n_retrieved, {K.RERANK_TOP_K}) || ' candidates',
          CASE WHEN n_claims > 0 THEN n_claims || ' claims hold'
               ELSE 'No claim holds' END]
        ELSE ['retrieve-then-compute route',
          n_retrieved || ' candidates passed the threshold',
          CASE WHEN n_values > 0 THEN 'Made of ' || n_values || ' values found'
               ELSE 'No values to compute with' END] END AS details
    FROM stamped""",
)


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


ORACLE["trace_rows"] = build(
    f"""SELECT trace_id, enterprise_id, actor_id, query_text AS raw_query, answer AS raw_response,
          route, array_to_string(details, '|') AS details, n_retrieved::INT AS n_chunks,
          {stamp('created_at')} AS created_at,
          {stamp('created_at + to_days(30)')} AS raw_content_expires_at,
          {stamp('created_at + to_days(90)')} AS expires_at FROM staged""",
    "staged",
)
ORACLE["latest_trace"] = build(
    f"""SELECT trace_id, enterprise_id, actor_id, route, query_text AS raw_query, answer,
          evidence_status, {stamp('created_at')} AS created_at,
          {K.PIPELINE_VERSION} AS pipeline_version, evidence_status AS outcome
        FROM stamped QUALIFY row_number() OVER (PARTITION BY enterprise_id
          ORDER BY stamped.created_at DESC, trace_id DESC) = 1""",
    "stamped",
)
ORACLE["trace_lookup"] = build(
    """SELECT trace_id, enterprise_id, route, query_text AS raw_query, corrected_query, answer,
         CASE WHEN cited_chunks IS NULL THEN 0 ELSE len(string_split(cited_chunks, ',')) END::INT AS n_citations,
         array_to_string(stages, '|') AS stages, evidence_status AS outcome
       FROM staged LEFT JOIN corrections USING (question_id)
       WHERE length(query_text) % 2 = 0""",
    "staged",
    "corrections",
)
ORACLE["stage_replay"] = build(
    """SELECT trace_id, unnest(stages) AS stage, unnest(range(1, len(stages) + 1))::INT AS position,
         'complete' AS status, unnest(details) AS detail, 1 AS duration_ms FROM staged""",
    "staged",
)
ORACLE["audit_rows"] = build(
    f"""
    SELECT audit_id, enterprise_id, trace_id AS trace_memory_id, trace_identifier_hash, actor_id,
      'query.answer' AS action, scope, {K.PIPELINE_VERSION} AS pipeline_version,
      '{{"embedding":"{K.EMBEDDING_MODEL}","generator":"{K.GENERATOR_MODEL}"}}' AS model_versions,
      evidence_status AS outcome,
      '{{"action":"query.answer","route":"' || route || '","traceIdentifierHash":"'
        || trace_identifier_hash || '"}}' AS event_payload,
      sha256('{{"action":"query.answer","actorId":"' || actor_id || '","createdAt":"'
        || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00","enterpriseId":"' || enterprise_id
        || '","eventId":"' || audit_id || '","outcome":"' || evidence_status || '","scope":' || scope
        || ',"traceIdentifierHash":"' || trace_identifier_hash || '"}}') AS event_hash,
      {stamp('created_at')} AS created_at, {stamp('created_at + to_days(365)')} AS expires_at
    FROM (SELECT *, sha256({raw_uuid('trace_id')}) AS trace_identifier_hash,
            '{{"enterpriseId":"' || enterprise_id || '","principalCount":' || len(principals)
              || ',"route":"' || route || '"}}' AS scope FROM stamped)""",
    "stamped",
)
ORACLE["redact_expired"] = f"""
    SELECT {text_uuid("'event:' || event_id")} AS trace_id,
      CASE WHEN old THEN '[expired]' ELSE event_type || ' ' || props END AS raw_query,
      CASE WHEN NOT old THEN printf('%.2f', value) END AS raw_response,
      event_type AS evidence_status, CASE WHEN NOT old THEN props END AS model_input,
      CASE WHEN NOT old THEN props END AS first_text, old AS was_redacted
    FROM (SELECT *, ts + to_days(30) <= TIMESTAMP '2024-02-15' AS old FROM events)"""
ORACLE["purge_traces"] = f"""
    SELECT CASE WHEN ts + to_days(90) > TIMESTAMP '2024-04-15' THEN trace_id END AS trace_memory_id,
      sha256({raw_uuid('trace_id')}) AS trace_identifier_hash, enterprise_id, event_type AS outcome
    FROM (SELECT *, {text_uuid("'event:' || event_id")} AS trace_id,
            {text_uuid("'tenant:' || (user_id % 10)")} AS enterprise_id FROM events)"""
ORACLE["stored_retention"] = f"""
    SELECT CASE WHEN live THEN trace_id END AS trace_memory_id,
      sha256({raw_uuid('trace_id')}) AS trace_identifier_hash, event_type AS outcome,
      CASE WHEN live AND old THEN '[expired]' WHEN live THEN event_type || ' ' || props END AS raw_query,
      CASE WHEN live AND NOT old THEN printf('%.2f', value) END AS raw_response,
      CASE WHEN live AND NOT old THEN props END AS model_input
    FROM (SELECT *, {text_uuid("'event:' || event_id")} AS trace_id,
            ts + to_days(90) > TIMESTAMP '2024-04-15' AS live,
            ts + to_days(30) <= TIMESTAMP '2024-02-24' AS old FROM events)"""

# --- evaluation ------------------------------------------------------------------------
cte(
    "stale_chunks",
    ("chunks",),
    """SELECT * REPLACE (CASE WHEN version_label = 'v2' THEN upper(content) ELSE content END AS content,
         CASE WHEN version_label = 'v2' THEN ['role:auditor'] ELSE principals END AS principals)
       FROM chunks""",
)


def gates(judged_by: str) -> str:
    return build(
        f"""
    , gold AS (
      SELECT enterprise_id AS run_id, question_id,
        {text_uuid("regexp_replace(question_id, '^[a-z]+-', 'doc:')")} AS document_id
      FROM answers WHERE regexp_matches(question_id, '^(title|values)-')),
    hits AS (
      SELECT DISTINCT s.question_id, c.document_id FROM searched s JOIN {judged_by} c USING (chunk_id)
      WHERE result_rank <= 10),
    recall AS (
      SELECT run_id, avg(CASE WHEN h.document_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)
        AS recall_at_10
      FROM gold g LEFT JOIN hits h ON h.question_id = g.question_id
        AND h.document_id = g.document_id GROUP BY run_id),
    leaks AS (
      SELECT a.enterprise_id AS run_id, count(*) AS n FROM searched s
      JOIN answers a USING (question_id) JOIN {judged_by} c ON c.chunk_id = s.chunk_id
      WHERE c.enterprise_id <> a.enterprise_id OR NOT list_has_any(c.principals, a.principals)
      GROUP BY ALL),
    tried AS (SELECT question_id, count(*) AS t FROM proposed GROUP BY ALL),
    passed AS (SELECT question_id, count(*) AS p FROM accepted GROUP BY ALL),
    rates AS (
      SELECT enterprise_id AS run_id,
        CASE WHEN sum(t) > 0 THEN (sum(t) - sum(coalesce(p, 0)))::DOUBLE / sum(t) ELSE 0 END AS unsupported,
        CASE WHEN count(*) FILTER (route <> 'compute' AND n_retrieved = 0) > 0
          THEN count(*) FILTER (route <> 'compute' AND n_retrieved = 0
                 AND evidence_status <> 'sufficient')::DOUBLE
               / count(*) FILTER (route <> 'compute' AND n_retrieved = 0) ELSE 1 END AS abstention
      FROM answers LEFT JOIN tried USING (question_id) LEFT JOIN passed USING (question_id)
      GROUP BY ALL),
    cited AS (
      SELECT a.question_id, a.enterprise_id AS run_id, t.chunk_id, t.claim_text AS span
      FROM accepted t JOIN answered a USING (question_id) WHERE outcome = 'claims'
      UNION ALL
      SELECT a.question_id, a.enterprise_id, s.chunk_id, s.content
      FROM searched s JOIN answered a USING (question_id)
      WHERE (outcome = 'fallback' AND result_rank = 1)
         OR (outcome IN ('conflict', 'computed') AND result_rank <= 2)),
    precision_ AS (
      SELECT run_id, avg(CASE WHEN contains(content, span) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p
      FROM cited LEFT JOIN {judged_by} USING (chunk_id) GROUP BY run_id),
    completeness AS (
      SELECT enterprise_id AS run_id, sum(CASE WHEN outcome = 'claims' THEN coalesce(k, 0)
          ELSE least(coalesce(k, 0), n_claims) END)::DOUBLE / nullif(sum(n_claims), 0) AS c
      FROM answered LEFT JOIN (SELECT question_id, count(*) AS k FROM cited GROUP BY ALL)
        USING (question_id) GROUP BY ALL),
    metrics AS (
      SELECT run_id, coalesce(n, 0) AS scope_leak_count, coalesce(recall_at_10, 0) AS recall_at_10,
        coalesce(p, 1.0::DOUBLE) AS citation_precision, coalesce(c, 1.0::DOUBLE) AS citation_completeness,
        unsupported AS unsupported_claim_rate, abstention AS abstention_recall
      FROM rates LEFT JOIN recall USING (run_id) LEFT JOIN leaks USING (run_id)
      LEFT JOIN precision_ USING (run_id) LEFT JOIN completeness USING (run_id))
    SELECT run_id, scope_leak_count, round(recall_at_10, 6) AS recall_at_10,
      round(citation_precision, 6) AS citation_precision, round(citation_completeness, 6) AS citation_completeness, round(unsupported_claim_rate, 6) AS unsupported_claim_rate,
      round(abstention_recall, 6) AS abstention_recall, NULL AS reason, failed AS failed_gates,
      failed = '' AS is_eligible
    FROM (SELECT *, concat_ws(',', CASE WHEN scope_leak_count <> 0 THEN 'scope-isolation' END,
            CASE WHEN recall_at_10 < 0.9 THEN 'recall-at-10' END,
            CASE WHEN citation_precision < 0.98 THEN 'citation-precision' END,
            CASE WHEN citation_completeness < 0.95 THEN 'citation-completeness' END,
            CASE WHEN unsupported_claim_rate > 0.01 THEN 'unsupported-claim-rate' END,
            CASE WHEN abstention_recall < 0.95 THEN 'abstention-recall' END) AS failed
          FROM metrics)""",
        "answers",
        "searched",
        judged_by,
        "accepted",
    )


ORACLE["promotion_gates"] = gates("chunks")
ORACLE["stale_evidence_gates"] = gates("stale_chunks")

# --- definitions --------------------------------------------------------------------------
GRAPH = """
    WITH RECURSIVE placed AS (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey
                                   ORDER BY l_linenumber, l_partkey, l_suppkey) AS position
      FROM lineitem),
    counted AS (
      SELECT *, CASE WHEN l_orderkey % 8 = 0 THEN l_linenumber ELSE position END AS number
      FROM placed),
    numbered AS (
      SELECT *, lead(number) OVER w AS following, first_value(number) OVER w AS opening
      FROM counted WINDOW w AS (PARTITION BY l_orderkey ORDER BY position)),
    nodes AS (
      SELECT l_orderkey AS id, 'n' || number AS node, position,
        'part-' || l_partkey || CASE WHEN l_partkey % 107 = 0 THEN repeat('x', 120) ELSE '' END
          AS part,
        CASE WHEN l_partkey % 101 = 0 THEN '' ELSE '1.0.0' END AS version,
        CASE WHEN l_partkey % 103 = 0 THEN '' ELSE 'rows' END AS produced,
        CASE WHEN l_orderkey % 4 = 1 AND position = 1
          THEN ['audit', 'authorization', 'claim-validation', 'provenance']
          ELSE [CASE l_returnflag WHEN 'A' THEN 'authorization' WHEN 'N' THEN 'provenance'
                  ELSE 'audit' END,
                CASE WHEN l_suppkey % 97 = 0 THEN 'telemetry'
                  WHEN l_linestatus = 'O' THEN 'claim-validation' ELSE 'retrieval' END] END AS caps,
        CASE WHEN l_discount > 0.02 THEN '"at":"' || l_suppkey || '","flag":"' || l_returnflag || '"'
             ELSE '' END AS config
      FROM numbered),
    edges AS (
      SELECT * FROM (
        SELECT l_orderkey AS id, 'n' || number AS src, position,
          CASE WHEN l_partkey % 109 = 0 THEN ''
               WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN 'n' || opening
               WHEN l_tax > 0.075 AND l_discount < 0.025 THEN 'n0'
               WHEN following <> number THEN 'n' || following END AS dst
        FROM numbered) WHERE dst IS NOT NULL),
    named AS (
      SELECT o_orderkey AS id, o_custkey % 25 + 28 AS top_k,
        'order ' || o_orderkey || CASE WHEN o_custkey % 53 = 0 THEN repeat('x', 160) ELSE '' END
          AS name
      FROM orders)"""
ORACLE["definition_validation"] = f"""{GRAPH},
    counts AS (SELECT id, count(DISTINCT node) + 1 AS n FROM nodes GROUP BY id),
    walks AS (
      SELECT DISTINCT id, dst AS node, 1 AS depth FROM edges
      UNION
      SELECT w.id, e.dst, w.depth + 1 FROM walks w JOIN edges e ON e.id = w.id AND e.src = w.node
      JOIN counts c ON c.id = w.id WHERE w.depth <= c.n),
    cyclic AS (SELECT DISTINCT w.id FROM walks w JOIN counts c ON c.id = w.id WHERE depth > c.n),
    twice AS (SELECT DISTINCT id FROM (SELECT id, node FROM nodes GROUP BY ALL HAVING count(*) > 1)),
    loose AS (
      SELECT DISTINCT e.id FROM (SELECT id, src AS node FROM edges UNION SELECT id, dst FROM edges) e
      WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = e.id AND n.node = e.node)),
    blank AS (SELECT DISTINCT id FROM edges WHERE dst = ''),
    lacking AS (
      SELECT id, bool_or(length(part) > 120) AS long_type, bool_or(version = '') AS no_version,
        bool_or(produced = '') AS no_output, bool_or(list_contains(caps, 'telemetry')) AS unknown,
        concat_ws(',',
          CASE WHEN NOT bool_or(list_contains(caps, 'audit')) THEN 'audit' END,
          CASE WHEN NOT bool_or(list_contains(caps, 'authorization')) THEN 'authorization' END,
          CASE WHEN NOT bool_or(list_contains(caps, 'claim-validation'))
            THEN 'claim-validation' END,
          CASE WHEN NOT bool_or(list_contains(caps, 'provenance')) THEN 'provenance' END) AS missing
      FROM nodes GROUP BY id)
    SELECT named.id AS definition_id, missing,
      CASE WHEN length(name) > 160 THEN 'name must have 1-160 characters'
        WHEN top_k NOT BETWEEN 30 AND 50 THEN 'rerankTopK must stay within 30-50'
        WHEN missing IS NULL THEN 'no nodes'
        WHEN long_type THEN 'a node''s component_type must have 1-120 characters'
        WHEN no_version THEN 'a node''s component_version must have 1-80 characters'
        WHEN no_output THEN 'a node''s output_schema must have at least 1 character'
        WHEN unknown THEN 'a node has an unknown capability'
        WHEN blank.id IS NOT NULL
          THEN 'an edge''s target_node_id must have at least 1 character'
        WHEN twice.id IS NOT NULL THEN 'a node id repeats'
        WHEN loose.id IS NOT NULL THEN 'an edge leads to no node'
        WHEN missing <> '' THEN 'capabilities not covered: ' || replace(missing, ',', ', ')
        WHEN cyclic.id IS NOT NULL THEN 'the edges form a cycle' END AS problem
    FROM named LEFT JOIN lacking ON lacking.id = named.id LEFT JOIN twice ON twice.id = named.id
    LEFT JOIN blank ON blank.id = named.id LEFT JOIN loose ON loose.id = named.id
    LEFT JOIN cyclic ON cyclic.id = named.id"""
ORACLE["definition_hash"] = f"""{GRAPH},
    n AS (SELECT id, string_agg('{{"capabilities":["' || array_to_string(list_sort(caps), '","')
        || '"],"componentType":"' || part || '","componentVersion":"' || version
        || '","config":{{' || config || '}},"id":"' || node
        || '","inputSchema":"rows","outputSchema":"' || produced || '"}}', ',' ORDER BY position)
        AS body
      FROM nodes GROUP BY id),
    e AS (SELECT id, string_agg('{{"sourceNodeId":"' || src || '","targetNodeId":"' || dst || '"}}',
        ',' ORDER BY position) AS body FROM edges GROUP BY id)
    SELECT named.id AS definition_id, sha256('{{"edges":[' || coalesce(e.body, '')
      || '],"name":"' || name || '","nodes":[' || coalesce(n.body, '')
      || '],"rerankTopK":' || top_k || '}}') AS definition_hash
    FROM named LEFT JOIN n ON n.id = named.id LEFT JOIN e ON e.id = named.id"""
ORACLE["text_files"] = f"""
    SELECT doc_id, {normalize('text')} AS normalized, 'plain-text' AS parser_name,
      '1.0.0' AS parser_version
    FROM documents WHERE {normalize('text')} <> ''"""

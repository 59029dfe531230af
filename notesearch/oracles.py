"""DuckDB SQL for the catalog: common tables by name, and a final SELECT for each query."""

from __future__ import annotations

from .operators.search import B, K1
from .plans import corpora


def _values(rows: list, columns: str) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) v({columns}))"


TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[\x{{10000}}-\x{{10FFFF}}]', ' ', 'g'), '[^\p{{L}}\p{{Nd}}]+'), lambda t: t <> '')"
GRAMS = "list_distinct(list_transform(range(1, length({0}) + 1), lambda i: substr('$' || {0} || '$', i, 3)))"


def _index(prefix: str, docs: str) -> str:
    """post, terms, stats and corpus of a corpus (doc, text) under a prefix."""
    p = prefix
    return f"""{p}docs AS ({docs}),
{p}post AS (SELECT term, doc, count(*) AS tf FROM (SELECT doc, unnest({TOKENS.format('text')}) AS term FROM {p}docs) GROUP BY term, doc),
{_statistics(p)}"""


def _statistics(p: str) -> str:
    return f"""{p}terms AS (SELECT term, count(*) AS df FROM {p}post GROUP BY term),
{p}stats AS (SELECT d.doc, coalesce(s.len, 0) AS len, coalesce(s.norm, 0) AS norm FROM {p}docs d LEFT JOIN (SELECT doc, CAST(sum(tf) AS BIGINT) AS len, sqrt(sum(pow(1 + ln(tf), 2))) AS norm FROM {p}post GROUP BY doc) s USING (doc)),
{p}corpus AS (SELECT count(*) AS n, CAST(sum(len) AS DOUBLE) / count(*) AS avgdl FROM {p}stats)"""


DOCS = _index("d_", "SELECT doc_id AS doc, text FROM documents")
LINE_ROWS = """ord AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, CAST(min(l_quantity) AS INTEGER) AS qty FROM lineitem GROUP BY ALL),
lines AS (SELECT l_orderkey * 10 + l_linenumber AS doc, lpad(CAST(part AS VARCHAR), 6, '0') AS code,
    'BR ' || upper(CASE WHEN (7 * l_orderkey + l_linenumber) % 11 = 0 THEN translate(substr(md5(CAST(part AS VARCHAR)), 1, 10), '8', 'b') ELSE substr(md5(CAST(part AS VARCHAR)), 1, 10) END)
    || ' ' || upper(p_name) || ' ' || CAST(qty AS VARCHAR) AS descr FROM ord JOIN part ON p_partkey = part)"""
LINES = LINE_ROWS + ",\n" + _index("l_", "SELECT doc, code || ' ' || descr AS text FROM lines")
FIXES = """pairs AS (SELECT a.term, b.term AS fixed, a.df, b.df AS fixed_df FROM l_terms a JOIN l_terms b ON translate(a.term, '015687', 'oisgbt') = translate(b.term, '015687', 'oisgbt')
    AND length(a.term) = length(b.term) AND b.df > a.df AND length(a.term) >= 4 AND NOT regexp_full_match(a.term, '[0-9]+')),
fixes AS (SELECT term, fixed, df, fixed_df FROM pairs WHERE hamming(term, fixed) BETWEEN 1 AND 2 QUALIFY row_number() OVER (PARTITION BY term ORDER BY fixed_df DESC, fixed) = 1)"""
CORRECTED = """c_docs AS (SELECT * FROM l_docs),
c_post AS (SELECT coalesce(f.fixed, p.term) AS term, doc, CAST(sum(tf) AS BIGINT) AS tf FROM l_post p LEFT JOIN fixes f ON f.term = p.term GROUP BY ALL),
""" + _statistics("c_")
NOTES = r"""noisy AS (SELECT *, doc // 10 AS o, CASE WHEN (doc // 10) % 13 = 0 THEN 'RIGA ILLEGGIBILE' ELSE CASE WHEN doc % 3 = 0 THEN '|. | ' ELSE '' END || code || CASE WHEN doc % 5 = 0 THEN ' - ' ELSE ' ' END || 'BRON' || substr(descr, 3) || CASE WHEN doc % 4 = 0 THEN ' i _.' ELSE '' END END AS l FROM lines),
bodies AS (SELECT o, string_agg(l, chr(10) ORDER BY doc, l) AS body FROM noisy GROUP BY o),
notes AS (SELECT lpad(CAST(o AS VARCHAR), 6, '0') AS doc_id, CASE WHEN o % 7 = 0 THEN 'PAGINA SENZA NUMERO' ELSE 'DESTINATAR ' || lpad(CAST(o AS VARCHAR), 6, '0') || '. Pg 1/1 03/02/2026 Vendita' END
    || chr(10) || '001519 - 078 LUOGO DI DESTINAZION' || chr(10) || '  20025 LEGNANO CORSO RICCI, 211R' || chr(10) || chr(10) || 'Rif. citato in fatt. VEND 006893' || chr(10) || body || chr(12) || '17100 SAVONA SV' || chr(10) || 'firma' AS text FROM bodies),
heads AS (SELECT doc_id, text, regexp_extract(text, '(\d{6})\W{0,3}\s*Pg\W{0,3}\d\s*/\s*\d\W{0,3}\s*(\d{2}/\d{2}/\d{4})', 1) AS number, regexp_extract(text, '(\d{6})\W{0,3}\s*Pg\W{0,3}\d\s*/\s*\d\W{0,3}\s*(\d{2}/\d{2}/\d{4})', 2) AS date FROM notes),
split AS (SELECT doc_id, number, date, unnest(regexp_split_to_array(text, '[\n\f]')) AS raw, generate_subscripts(regexp_split_to_array(text, '[\n\f]'), 1) - 1 AS pos FROM heads),
every AS (SELECT doc_id, number, date, CAST(pos AS INTEGER) AS pos, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM split WHERE trim(raw, ' ' || chr(9) || chr(13)) <> ''),
found AS (SELECT *, regexp_extract(line, '^\W*(\d{5,7})\W{0,3}\s+(?:\W\s+|[a-z]\s+)?([A-Z]{3,4})\.?\s+(\S.*)$', ['code', 'brand', 'rest']) AS m, regexp_matches(line, '^\W*(\d{5,7})\W{0,3}\s+(?:\W\s+|[a-z]\s+)?([A-Z]{3,4})\.?\s+(\S.*)$') AS is_article FROM every),
arts AS (SELECT doc_id, pos, number, date, m.code AS code, m.brand || ' ' || array_to_string(list_filter(regexp_split_to_array(m.rest, '\s+'), lambda t: t <> '' AND NOT regexp_full_match(t, '[\W_]+|[il]')), ' ') AS descr FROM found WHERE is_article),
per AS (SELECT n.doc_id, coalesce(count(f.line), 0) AS n_lines, coalesce(count_if(f.is_article), 0) AS n_articles, coalesce(max(f.number), '') AS number FROM notes n LEFT JOIN found f USING (doc_id) GROUP BY n.doc_id),
rejected AS (SELECT doc_id, pos, CASE WHEN contains(upper(line), 'LUOGO DI DESTINAZ') THEN 'luogo_destinazione'
    WHEN regexp_matches(line, '(\d{6})\W{0,3}\s*Pg\W{0,3}\d\s*/\s*\d\W{0,3}\s*(\d{2}/\d{2}/\d{4})') THEN 'intestazione_documento'
    WHEN contains(upper(line), 'RIF. CITATO') OR contains(upper(line), 'N.RO ORDINE') THEN 'riferimento_fattura_ordine'
    WHEN contains(upper(line), 'LEGNANO') OR contains(upper(line), 'SAVONA') OR contains(upper(line), 'CORSO RICCI') THEN 'indirizzo' ELSE 'altro' END AS reason, line AS text
    FROM found JOIN per USING (doc_id) WHERE NOT is_article AND n_articles > 0
    UNION ALL SELECT doc_id, -1, 'documento_senza_righe_articolo', '(' || n_lines || ' righe, layout non gestito)' FROM per WHERE n_articles = 0)"""
KNOWN = f"""readings AS (SELECT code, code || ' ' || descr AS descr, count(*) AS n FROM lines GROUP BY ALL),
reference AS (SELECT code, descr FROM readings QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC, descr DESC) = 1 AND sum(n) OVER (PARTITION BY code) >= 2),
asked AS (SELECT code, t[3] AS model, t[4] AS word FROM (SELECT code, {TOKENS.format('descr')} AS t FROM reference) WHERE len(t) >= 4 AND length(t[3]) >= 5),
items AS (SELECT code, model || ' ' || word AS exact, substr(model, 1, CAST(ceil(length(model) * 0.6::DOUBLE) AS INTEGER)) || '*' AS wildcard, has_variants FROM
    (SELECT a.code, model, word, bool_or(NOT list_contains(t, model) OR NOT list_contains(t, word)) AS has_variants FROM asked a JOIN (SELECT code, {TOKENS.format("code || ' ' || descr")} AS t FROM lines) l ON l.code = a.code GROUP BY ALL)),
qrels AS (SELECT i.code AS query_id, l.doc FROM items i JOIN lines l ON l.code = i.code)"""
DENSE = """ids AS (SELECT doc, row_number() OVER (ORDER BY doc) - 1 AS id FROM (SELECT DISTINCT doc FROM l_post)),
dense AS (SELECT term, id AS doc, tf FROM l_post JOIN ids USING (doc)),
gaps AS (SELECT term, doc, tf, doc - lag(doc, 1, 0) OVER (PARTITION BY term ORDER BY doc) AS gap FROM dense),
sizes AS (SELECT term, 4 * count(*) AS raw_bytes, CAST(sum(CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 ELSE 4 END) AS BIGINT) AS gap_bytes, CAST(sum(CASE WHEN tf < 128 THEN 1 ELSE 2 END) AS BIGINT) AS tf_bytes FROM gaps GROUP BY term)"""
FRONT = """placed AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS k FROM l_terms),
before AS (SELECT term, k // 8 AS block, CAST(k % 8 AS INTEGER) AS place, CASE WHEN k % 8 > 0 THEN lag(term) OVER (ORDER BY k) END AS b FROM placed),
front AS (SELECT term, block, place, CAST(CASE WHEN b IS NULL THEN 0 ELSE coalesce(list_position(list_transform(range(1, least(length(term), length(b)) + 1), lambda i: substr(term, i, 1) <> substr(b, i, 1)), true) - 1, least(length(term), length(b))) END AS INTEGER) AS shared FROM before),
coded AS (SELECT *, CAST(CASE WHEN place > 0 THEN 1 ELSE 0 END + 1 + length(term) - shared AS BIGINT) AS coded_bytes FROM front)"""


def _expansion(p: str, asked: str, mode: str, name: str = "x") -> str:
    """words and expansions (query_id, word, term) of asked (query_id, text) over an index."""
    grams = f"{name}_g AS (SELECT term, {GRAMS.format('term')} AS g FROM {p}terms)"
    edits = "CASE WHEN length(w.word) <= 4 THEN 1 ELSE 2 END"
    similar = "len(list_intersect(w.g, t.g))"
    fuzzy = f"""{name}_f AS (SELECT w.word, t.term FROM (SELECT DISTINCT word, {GRAMS.format('word')} AS g FROM {name}_w WHERE NOT contains(word, '*')) w JOIN {name}_g t
        ON abs(length(w.word) - length(t.term)) <= {edits} AND levenshtein(w.word, t.term) <= {edits} AND {similar} > 0 AND {similar} >= 0.2::DOUBLE * (len(w.g) + len(t.g) - {similar}))"""
    plain = f"SELECT query_id, word, word AS term FROM {name}_w WHERE NOT contains(word, '*') AND word IN (SELECT term FROM {p}terms)"
    wild = rf"SELECT query_id, word, term FROM {name}_w JOIN {p}terms ON contains(word, '*') AND term LIKE replace(replace(replace(replace(word, '\', '\\'), '%', '\%'), '_', '\_'), '*', '%') ESCAPE '\'"
    near = f"SELECT query_id, w.word, term FROM {name}_w w JOIN {name}_f USING (word)"
    parts = {"never": [wild, plain], "fallback": [wild, plain, near + f" WHERE w.word NOT IN (SELECT term FROM {p}terms)"], "always": [wild, near]}[mode]
    extra = "" if mode == "never" else f"{grams},\n{fuzzy},\n"
    return f"""{name}_w AS (SELECT DISTINCT query_id, word FROM (SELECT query_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM {asked}) WHERE word <> ''),
{extra}{name}_e AS ({' UNION ALL '.join(parts)})"""


def _found(p: str, name: str = "x", every: bool = True) -> str:
    """hits (query_id, doc) of a search."""
    having = f"HAVING count(DISTINCT word) = any_value(n_words)" if every else ""
    return f"""{name}_n AS (SELECT query_id, count(*) AS n_words FROM {name}_w GROUP BY query_id),
{name}_hits AS (SELECT query_id, doc FROM {name}_e JOIN {p}post USING (term) JOIN {name}_n USING (query_id) GROUP BY query_id, doc {having})"""


def _scored(p: str, model: str, name: str = "x") -> str:
    one = {
        "none": "0.0::DOUBLE",
        "tfidf": "(1 + ln(tf)) / norm * ln(n::DOUBLE / df)",
        "bm25": f"ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * ({K1}::DOUBLE + 1) / (tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * len / avgdl))",
    }[model]
    return f"""{name}_s AS (SELECT query_id, doc, round(sum({one}), 6) AS score FROM (SELECT DISTINCT query_id, term FROM {name}_e) JOIN {p}terms USING (term) JOIN {p}post USING (term) JOIN {p}stats USING (doc) CROSS JOIN {p}corpus GROUP BY query_id, doc),
{name}_r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INTEGER) AS rank, doc, score FROM {name}_s JOIN {name}_hits USING (query_id, doc))"""


def _set_rows(results: str, queries: str, corpus: str) -> str:
    return f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
    SELECT q.query_id, has_variants, CASE WHEN returned > 0 THEN tp::DOUBLE / returned ELSE 0 END AS precision, CASE WHEN relevant > 0 THEN tp::DOUBLE / relevant ELSE 0 END AS recall, (n - (returned + relevant - 2 * tp))::DOUBLE / n AS accuracy
    FROM {queries} q JOIN (SELECT query_id, count(*) AS relevant FROM qrels GROUP BY ALL) USING (query_id)
    LEFT JOIN LATERAL (SELECT 1) ON true JOIN (SELECT i.query_id, coalesce(count(r.doc), 0) AS returned, coalesce(count(k.doc), 0) AS tp FROM {queries} i LEFT JOIN {results} r ON r.query_id = i.query_id LEFT JOIN qrels k ON k.query_id = r.query_id AND k.doc = r.doc GROUP BY i.query_id) c ON c.query_id = q.query_id CROSS JOIN {corpus})"""


def _rank_rows(ranked: str, queries: str) -> str:
    return f"""SELECT q.query_id, has_variants, coalesce(ap, 0) AS ap, coalesce(p1, 0) AS p1, coalesce(r_precision, 0) AS r_precision FROM {queries} q LEFT JOIN (
    SELECT query_id, sum(so_far::DOUBLE / rank) / any_value(relevant) AS ap, count_if(rank = 1)::DOUBLE AS p1, count_if(rank <= relevant)::DOUBLE / any_value(relevant) AS r_precision FROM (
        SELECT r.query_id, rank, relevant, row_number() OVER (PARTITION BY r.query_id ORDER BY rank) AS so_far FROM {ranked} r JOIN qrels k ON k.query_id = r.query_id AND k.doc = r.doc
        JOIN (SELECT query_id, count(*) AS relevant FROM qrels GROUP BY ALL) z ON z.query_id = r.query_id) GROUP BY query_id) m ON m.query_id = q.query_id"""


def _means(rows: str, system: str, names: list[str]) -> str:
    means = ", ".join(f"round(avg({c}), 6) AS {c}" for c in names)
    return f"SELECT '{system}' AS system, 'all' AS subset, count(*) AS n, {means} FROM {rows} UNION ALL SELECT '{system}', 'variants', count(*), {means} FROM {rows} WHERE has_variants"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p for p in parts[:-1] if p) + "\n" + parts[-1]


def oracle_sql() -> dict[str, str]:
    asked = {"documents": f"asked_q AS {_values(corpora.DOCUMENT_QUERIES, 'query_id, text')}", "lines": f"asked_q AS {_values(corpora.LINE_QUERIES, 'query_id, text')}"}
    words = f"asked_w AS {_values([(w,) for w in corpora.WORDS], 'word')}"
    base = {"documents": DOCS, "lines": LINES}
    letter = {"documents": "d_", "lines": "l_"}

    def searched(kind, mode, every=True, final="SELECT query_id, doc FROM x_hits"):
        return _with(base[kind], asked[kind], _expansion(letter[kind], "asked_q", mode), _found(letter[kind], every=every), final)

    def ranked(kind, model, every, mode, final="SELECT * FROM x_r", p=None, more=""):
        p = p or letter[kind]
        return _with(base[kind], more, asked[kind], _expansion(p, "asked_q", mode), _found(p, every=every), _scored(p, model), final)

    lines = lambda final, *parts: _with(LINES, *parts, final)
    notes = lambda final: _with(LINE_ROWS, NOTES, final)
    sim = "len(list_intersect(w.g, t.g))::DOUBLE / (len(w.g) + len(t.g) - len(list_intersect(w.g, t.g)))"
    edits = "CASE WHEN length(word) <= 4 THEN 1 ELSE 2 END"
    exact = "exact_q AS (SELECT code AS query_id, exact AS text, has_variants FROM items)"
    wild = "wild_q AS (SELECT code AS query_id, wildcard AS text, has_variants FROM items)"
    measures = ["precision", "recall", "f1", "accuracy"]
    ranks = ["ap", "p1", "r_precision"]

    systems = [("exact", "l_", "never", "exact_q"), ("fuzzy if absent", "l_", "fallback", "exact_q"), ("fuzzy always", "l_", "always", "exact_q"), ("corrected", "c_", "never", "exact_q"), ("corrected, fuzzy always", "c_", "always", "exact_q"), ("wildcard", "l_", "never", "wild_q"), ("wildcard, corrected", "c_", "never", "wild_q")]
    set_parts, set_finals = [], []
    for k, (system, p, mode, q) in enumerate(systems):
        set_parts += [_expansion(p, q, mode, f"s{k}"), _found(p, f"s{k}"), f"s{k}_m AS ({_set_rows(f's{k}_hits', q, p + 'corpus')})"]
        set_finals.append(_means(f"s{k}_m", system, measures))
    rank_parts, rank_finals = [], []
    orders = [(f"{'and' if e else 'or'} {m}", m, e, "never") for e in (True, False) for m in ("none", "tfidf", "bm25")] + [(f"fuzzy always, and {m}", m, True, "always") for m in ("tfidf", "bm25")]
    for k, (system, model, every, mode) in enumerate(orders):
        rank_parts += [_expansion("l_", "exact_q", mode, f"s{k}"), _found("l_", f"s{k}", every), _scored("l_", model, f"s{k}"), f"s{k}_m AS ({_rank_rows(f's{k}_r', 'exact_q')})"]
        rank_finals.append(_means(f"s{k}_m", system, ranks))

    out = {
        "tokenize": rf"SELECT doc, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS term FROM (SELECT doc_id AS doc, {TOKENS.format('text')} AS t FROM documents)",
        "postings": _with(DOCS, "SELECT term, doc, tf FROM d_post"),
        "dictionary_df": _with(DOCS, "SELECT term, df FROM d_terms"),
        "doc_stats": _with(DOCS, "SELECT doc, len, round(norm, 6) AS norm FROM d_stats"),
        "corpus_stats": _with(DOCS, "SELECT n, round(avgdl, 6) AS avgdl FROM d_corpus"),
        "term_membership": lines("SELECT word FROM asked_w WHERE word IN (SELECT term FROM l_terms)", words),
        "search_and": searched("documents", "never"),
        "search_or": searched("documents", "never", False),
        "search_tokens": _with(DOCS, asked["documents"], f"x_w AS (SELECT DISTINCT query_id, unnest({TOKENS.format('text')}) AS word FROM asked_q)", "x_e AS (SELECT query_id, word, word AS term FROM x_w)", _found("d_"), "SELECT query_id, doc FROM x_hits"),
        "fuzzy_fallback": searched("lines", "fallback"),
        "fuzzy_always": searched("lines", "always"),
        "top_k": ranked("documents", "bm25", False, "never", "SELECT query_id, rank, doc, score, text FROM x_r JOIN d_docs USING (doc) WHERE rank <= 10"),
        "kgram_index": lines(f"SELECT term, unnest({GRAMS.format('term')}) AS gram FROM l_terms"),
        "kgram_count": lines(f"SELECT count(DISTINCT gram) AS n_grams FROM (SELECT unnest({GRAMS.format('term')}) AS gram FROM l_terms)"),
        "wildcard_expand": lines("SELECT word, term FROM pats JOIN l_terms ON term LIKE replace(word, '*', '%')", f"pats AS {_values([(w,) for w in corpora.PATTERNS], 'word')}"),
        "wildcard_search": _with(DOCS, f"asked_q AS {_values(list(enumerate(corpora.DOCUMENT_PATTERNS)), 'query_id, text')}", _expansion("d_", "asked_q", "never"), _found("d_"), "SELECT query_id, doc FROM x_hits"),
        "levenshtein_pairs": lines("SELECT word, term, CAST(levenshtein(word, term) AS INTEGER) AS distance FROM asked_w, l_terms WHERE levenshtein(word, term) <= 3", words),
        "fuzzy_expand": lines(f"SELECT word, term, round({sim}, 6) AS similarity, CAST(levenshtein(word, term) AS INTEGER) AS distance FROM (SELECT word, {GRAMS.format('word')} AS g FROM asked_w) w JOIN (SELECT term, {GRAMS.format('term')} AS g FROM l_terms) t ON levenshtein(word, term) <= {edits} AND {sim} >= 0.2::DOUBLE", words),
        "ocr_corrections": lines("SELECT term, fixed, df, fixed_df FROM fixes", FIXES),
        "corrected_postings": lines("SELECT term, doc, tf FROM c_post", FIXES, CORRECTED),
        "corrected_search": ranked("lines", "bm25", True, "fallback", p="c_", more=f"{FIXES},\n{CORRECTED}"),
        "correction_eval": lines(
            """SELECT count(fixed) AS proposed, count_if(fixed = truth) AS right, count_if(fixed <> truth) AS wrong, count_if(fixed IS NOT NULL AND truth IS NULL) AS unverifiable, count(truth) AS known, count_if(fixed = truth) AS recovered FROM fixes FULL JOIN truths USING (term)""",
            FIXES,
            f"""rd AS (SELECT code, descr, count(*) AS n FROM lines GROUP BY ALL),
ref AS (SELECT code, descr FROM rd QUALIFY row_number() OVER (PARTITION BY code ORDER BY n DESC, descr DESC) = 1 AND sum(n) OVER (PARTITION BY code) >= 2),
tk AS (SELECT n, w, r FROM (SELECT code, n, {TOKENS.format('descr')} AS w FROM rd) JOIN (SELECT code, {TOKENS.format('descr')} AS r FROM ref) USING (code) WHERE len(w) = len(r)),
tp AS (SELECT n, unnest(w) AS term, unnest(r) AS truth FROM tk),
truths AS (SELECT term, truth FROM (SELECT term, truth, sum(n) AS support FROM tp WHERE term <> truth AND length(term) = length(truth) AND length(truth) > 3 AND regexp_matches(term, '[a-z]') AND regexp_matches(truth, '[a-z]') AND regexp_full_match(term, '[a-z]+') = regexp_full_match(truth, '[a-z]+') GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY term ORDER BY support DESC, truth) = 1)""",
        ),
        "parse_header": notes("SELECT doc_id, number, date FROM heads"),
        "parse_articles": notes("SELECT * FROM arts"),
        "parse_rejects": notes("SELECT * FROM rejected"),
        "reject_reasons": notes("SELECT reason, count(*) AS n FROM rejected GROUP BY reason"),
        "build_counters": notes("SELECT count_if(n_articles > 0) AS docs_kept, count_if(n_articles > 0 AND number = '') AS docs_without_header, count_if(n_articles = 0) AS docs_dropped, CAST(sum(n_articles) AS BIGINT) AS article_lines, CAST(sum(CASE WHEN n_articles > 0 THEN n_lines - n_articles ELSE 0 END) AS BIGINT) AS rejected_lines FROM per"),
        "known_item_queries": _with(LINE_ROWS, KNOWN, "SELECT * FROM items"),
        "eval_set_measures": lines(f"SELECT query_id, has_variants, {', '.join(f'round({c}, 6) AS {c}' for c in measures)} FROM m", KNOWN, exact, _expansion("l_", "exact_q", "never"), _found("l_"), f"m AS ({_set_rows('x_hits', 'exact_q', 'l_corpus')})"),
        "eval_rank_measures": lines(f"SELECT query_id, has_variants, {', '.join(f'round({c}, 6) AS {c}' for c in ranks)} FROM m", KNOWN, exact, _expansion("l_", "exact_q", "never"), _found("l_"), _scored("l_", "bm25"), f"m AS ({_rank_rows('x_r', 'exact_q')})"),
        "eval_set_matrix": lines(" UNION ALL ".join(set_finals), FIXES, CORRECTED, KNOWN, exact, wild, *set_parts),
        "eval_rank_matrix": lines(" UNION ALL ".join(rank_finals), KNOWN, exact, *rank_parts),
        "intersect_linear_cost": lines(
            "SELECT pair_id, CAST(coalesce(common, 0) AS BIGINT) AS common, CAST(CASE WHEN a_max IS NULL OR b_max IS NULL THEN 0 ELSE na + nb - common END AS BIGINT) AS linear_cost FROM cut",
            KNOWN,
            """prs AS (SELECT code AS pair_id, string_split(exact, ' ')[1] AS a, string_split(exact, ' ')[2] AS b FROM items),
ends AS (SELECT pair_id, a, b, (SELECT max(doc) FROM l_post WHERE term = a) AS a_max, (SELECT max(doc) FROM l_post WHERE term = b) AS b_max FROM prs),
cut AS (SELECT e.pair_id, any_value(a_max) AS a_max, any_value(b_max) AS b_max, count(*) FILTER (p.term = a AND p.doc <= least(a_max, b_max)) AS na, count(*) FILTER (p.term = b AND p.doc <= least(a_max, b_max)) AS nb,
    count(*) FILTER (p.term = a) + count(*) FILTER (p.term = b) - count(DISTINCT p.doc) AS common FROM ends e LEFT JOIN l_post p ON p.term = e.a OR p.term = e.b GROUP BY e.pair_id)""",
        ),
        "efficiency_linear": lines(
            "SELECT workload, count(*) AS n_queries, CAST(sum(CASE WHEN a_max IS NULL OR b_max IS NULL THEN 0 ELSE na + nb - common END) AS BIGINT) AS linear FROM cut GROUP BY workload",
            KNOWN,
            """prs AS (SELECT 'query terms' AS workload, code AS pair_id, string_split(exact, ' ')[1] AS a, string_split(exact, ' ')[2] AS b FROM items
    UNION ALL SELECT 'most frequent', code, string_split(exact, ' ')[1], (SELECT term FROM l_terms ORDER BY df DESC, term LIMIT 1) FROM items),
ends AS (SELECT workload, pair_id, a, b, x.m AS a_max, y.m AS b_max FROM prs LEFT JOIN (SELECT term, max(doc) AS m FROM l_post GROUP BY term) x ON x.term = a LEFT JOIN (SELECT term, max(doc) AS m FROM l_post GROUP BY term) y ON y.term = b),
both_lists AS (SELECT workload, pair_id, a_max, b_max, doc, 1 AS in_a, 0 AS in_b FROM ends JOIN l_post ON term = a UNION ALL SELECT workload, pair_id, a_max, b_max, doc, 0, 1 FROM ends JOIN l_post ON term = b),
met AS (SELECT workload, pair_id, any_value(a_max) AS a_max, any_value(b_max) AS b_max, doc, max(in_a) AS in_a, max(in_b) AS in_b FROM both_lists GROUP BY workload, pair_id, doc),
cut AS (SELECT workload, pair_id, any_value(a_max) AS a_max, any_value(b_max) AS b_max, coalesce(sum(in_a) FILTER (doc <= least(a_max, b_max)), 0) AS na, coalesce(sum(in_b) FILTER (doc <= least(a_max, b_max)), 0) AS nb, sum(in_a * in_b) AS common FROM met GROUP BY workload, pair_id)""",
        ),
        "hashed_vectors": lines("SELECT term, CAST(s AS INTEGER) AS slot, round(v[s + 1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS value FROM hashed, range(64) r(s) WHERE v[s + 1] > 0", HASHED),
        "eval_vector_system": lines(
            _means("m", "vector neighbours", measures),
            HASHED,
            KNOWN,
            exact,
            f"q AS (SELECT DISTINCT query_id, unnest({TOKENS.format('text')}) AS word FROM exact_q)",
            """close AS (SELECT asked, term FROM (SELECT a.term AS asked, b.term, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM (SELECT * FROM hashed WHERE term IN (SELECT word FROM q)) a, hashed b)
    WHERE cosine >= 0.9::DOUBLE QUALIFY row_number() OVER (PARTITION BY asked ORDER BY cosine DESC, term) <= 5)""",
            "found_rows AS (SELECT query_id, doc FROM q JOIN close ON asked = word JOIN l_post p ON p.term = close.term JOIN (SELECT query_id, count(*) AS n FROM q GROUP BY ALL) USING (query_id) GROUP BY query_id, doc, n HAVING count(DISTINCT word) = n)",
            f"m AS ({_set_rows('found_rows', 'exact_q', 'l_corpus')})",
        ),
        "corpus_roundtrip": notes("SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS doc, code || ' ' || descr AS text FROM arts"),
        "postings_gaps": lines("SELECT term, doc, gap FROM gaps", DENSE),
        "gaps_roundtrip": lines("SELECT term, doc FROM dense", DENSE),
        "vbyte_sizes": lines("SELECT * FROM sizes", DENSE),
        "dictionary_front_coding": lines("SELECT * FROM coded", FRONT),
        "space_report": lines("SELECT * FROM (SELECT CAST(sum(1 + length(term)) AS BIGINT) AS dictionary_raw, CAST(sum(coded_bytes) + 4 * count_if(place = 0) AS BIGINT) AS dictionary_coded FROM coded), (SELECT CAST(sum(raw_bytes) AS BIGINT) AS postings_raw, CAST(sum(gap_bytes) AS BIGINT) AS postings_coded, CAST(sum(tf_bytes) AS BIGINT) AS tf_coded FROM sizes)", DENSE, FRONT),
        "vbyte_roundtrip": lines("SELECT term, doc, tf FROM dense", DENSE),
        "dictionary_roundtrip": lines("SELECT term FROM l_terms"),
        "dictionary_lookup": lines("SELECT word, coalesce(k, -1) AS id FROM asked_w LEFT JOIN (SELECT term, row_number() OVER (ORDER BY term) - 1 AS k FROM l_terms) ON term = word", words),
        "index_roundtrip": lines("SELECT term, doc, tf FROM l_post"),
        "vector_neighbours": _with(VECTORS, "SELECT asked, neighbour, cosine FROM near"),
        "vector_search": _with(LINES, NEIGHBOURS, f"q AS (SELECT DISTINCT query_id, unnest({TOKENS.format('text')}) AS word FROM {_values(corpora.NEIGHBOUR_QUERIES, 'query_id, text')})",
            "SELECT query_id, doc FROM q JOIN close ON asked = word JOIN l_post p ON p.term = close.term JOIN (SELECT query_id, count(*) AS n FROM q GROUP BY ALL) USING (query_id) GROUP BY query_id, doc, n HAVING count(DISTINCT word) = n"),
        "compressed_lookup": lines(f"SELECT term, doc, tf FROM dense WHERE term IN (SELECT word FROM {_values([(w,) for w in corpora.WORDS], 'word')})", DENSE),
        "html_escape": "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages",
        "url_params": r"""SELECT page_id, url_decode(split_part(i, '=', 1)) AS name, url_decode(substr(i, position('=' IN i) + 1)) AS value FROM
            (SELECT page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS i FROM pages) WHERE position('=' IN i) > 1""",
    }
    for mode in ("never", "fallback", "always"):
        out[f"expand_{mode}"] = searched("lines", mode, True, "SELECT query_id, word, term FROM x_e")
    for model in ("none", "tfidf", "bm25"):
        for every in (True, False):
            out[f"ranked_{model}_{'and' if every else 'or'}"] = ranked("documents", model, every, "never")
            out[f"ranked_{model}_{'and' if every else 'or'}_lines"] = ranked("lines", model, every, "fallback")
    return out


HASHED = """slots AS (SELECT term, unnest(flatten(list_transform([3, 4, 5, 6], lambda k: list_transform(range(1, length(term) + 4 - k), lambda i: substr('<' || term || '>', i, k))))) AS g FROM l_terms),
slotted AS (SELECT term, list(CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % 64) AS s FROM slots GROUP BY term),
hashed AS (SELECT term, list_transform(range(64), lambda k: len(list_filter(s, lambda x: x = k))::DOUBLE) AS v FROM slotted)"""
NEIGHBOURS = """places AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS vec_id FROM l_terms),
tvecs AS (SELECT term, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM places JOIN embeddings USING (vec_id)),
cosines AS (SELECT q.term AS asked, c.term, round(list_cosine_similarity(q.v, c.v), 6) AS cosine FROM tvecs q, tvecs c WHERE q.term LIKE '0000%' OR q.term = 'small'),
close AS (SELECT asked, term FROM cosines WHERE true QUALIFY row_number() OVER (PARTITION BY asked ORDER BY cosine DESC, term) <= 5 AND cosine >= 0.2::DOUBLE)"""
VECTORS = """vecs AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
scored AS (SELECT q.vec_id AS asked, c.vec_id AS neighbour, round(list_cosine_similarity(q.v, c.v), 6) AS cosine FROM vecs q, vecs c WHERE q.vec_id % 100 = 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY cosine DESC, neighbour) AS place FROM scored) WHERE place <= 5 AND cosine >= 0.3)"""

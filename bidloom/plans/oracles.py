"""DuckDB counterparts of the catalog's queries, over the same tables."""

from __future__ import annotations

from bidloom.functions import names, rules, text


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def match_form(c: str) -> str:
    return f"translate(regexp_replace(regexp_replace({c}, {q(text.TOC_DOTS)}, '', 'g'), {q(text.SKIPPED)}, '', 'g'), {q(text.FOLD_FROM)}, {q(text.FOLD_TO)})"


def occurrences(c: str, words: list[str]) -> str:
    return "(" + " + ".join(f"(length({c}) - length(replace({c}, {q(w)}, ''))) / {len(w)}.0" for w in words) + ")"


def any_of(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def template(c: str) -> str:
    t = f"trim({c}, ' ')"
    density = f"{occurrences(t, rules.FORMAL)} / greatest(length({t}), 1)"
    return f"({any_of(t, '|'.join(rules.WORDS))} OR {any_of(t, rules.NUMBERING)} OR {any_of(t, rules.FURNITURE)} OR (length({t}) >= 40 AND {density} > 0.06 AND NOT {any_of(t, '[0-9]{2,}')}))"


def substantiality(c: str) -> str:
    n = f"greatest(length({c}), 1)"
    technical = " + ".join(f"coalesce(list_sum(list_transform(regexp_extract_all({c}, {q('(' + p + ')')}, 1), lambda x: length(x))), 0)" for p in rules.TECHNICAL)
    numeric = " + ".join(f"len(regexp_extract_all({c}, {q(p)}))" for p in rules.NUMERIC)
    formal = f"{occurrences(c, rules.FORMAL_SCORE)} / {n}"
    concrete = any_of(c, "[0-9]{2,}|[A-Z]{2,}")
    penalty = f"CASE WHEN {concrete} THEN least(1.0::double, {formal} / 0.10) * 0.4 ELSE least(1.0::double, {formal} / 0.06) END"
    return f"CASE WHEN length({c}) < 15 THEN 0.0 ELSE least(1.0::double, length({c}) / 200.0::double) * 0.30 + least(1.0::double, ({technical}) / {n}::double / 0.15) * 0.30 + least(1.0::double, ({numeric}) / greatest({n} / 50.0::double, 1.0)) * 0.25 + (1.0 - {penalty}) * 0.15 END"


def role(c: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({c}, {q(w)}) THEN {q(v)}" for w, v in names.ROLES) + " END"


def key_of(c: str) -> str:
    return f"regexp_replace(translate({c}, '•・‧∙', '····'), {q(text.SKIPPED)}, '', 'g')"


FILES = "(SELECT DISTINCT ON (file_id) * FROM summarize_file)"
PEOPLE = "(SELECT DISTINCT ON (person_id) * FROM personnel)"
SEGMENTS = "(SELECT DISTINCT ON (match_id) * FROM matches)"
ITEMS = "(SELECT DISTINCT ON (item_id) * FROM costdetails)"
PRICES = "(SELECT DISTINCT ON (price_id) * FROM prices)"
RUNS = "(SELECT DISTINCT ON (pair_id) * FROM pair_results)"
LINKS = "(SELECT DISTINCT least(file1, file2) AS l, greatest(file1, file2) AS r FROM pair_results WHERE total_matches >= 1 AND file1 <> file2)"
TIDY = "(SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT bid_group AS \"group\", '{k}' AS kind, unnest({c}) AS value FROM {PEOPLE}" for c, k in (("phones", "phone"), ("id_numbers", "id_number"), ("emails", "email"), ("bank_accounts", "bank_account"), (f"[{key_of('person_name')}]", "person"))) + ") WHERE \"group\" IS NOT NULL AND trim(value, ' ') <> '')"
DOC_LINES = "(SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"
FILE_LINES = f"(SELECT file_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM {FILES} WHERE text IS NOT NULL)"
LEVEL = "CASE WHEN lower(trim(risk_level, ' ')) IN ('substantial', 'suspicious', 'template') THEN lower(trim(risk_level, ' ')) END"
EXT = "lower(regexp_extract(file_name, '\\.([A-Za-z0-9]+)\\z', 1))"
NAME = f"regexp_replace(regexp_replace(regexp_replace({match_form('pricename')}, '^[0-9]+([.,][0-9]+)*[.,)]?', ''), '\\([^()]*\\)', '', 'g'), '[.,:*\"\\[\\]\\-]', '', 'g')"
BARS = "(SELECT doc_id, line_no, line, contains(line, ' | ') AS b, line_no - row_number() OVER (PARTITION BY doc_id, contains(line, ' | ') ORDER BY line_no) AS g FROM " + DOC_LINES + ")"
REGIONS = f"(SELECT doc_id, line_no, line, dense_rank() OVER (PARTITION BY doc_id ORDER BY g) AS region, row_number() OVER (PARTITION BY doc_id, g ORDER BY line_no) AS row_no FROM {BARS} WHERE b)"
PAIR_COUNTS = f"SELECT pair_id, count(*) AS total, count(*) FILTER (WHERE abnormal) AS n_abnormal, count(*) FILTER (WHERE lv = 'template') AS n_template, count(*) FILTER (WHERE lv = 'substantial') AS n_substantial, count(*) FILTER (WHERE lv = 'suspicious') AS n_suspicious FROM (SELECT *, {LEVEL} AS lv FROM {SEGMENTS}) GROUP BY pair_id"
LOOKUP = f"SELECT pair_id, a.bid_group AS group1, b.bid_group AS group2 FROM {RUNS} AS p LEFT JOIN (SELECT DISTINCT file_name, bid_group FROM summarize_file) AS a ON a.file_name = p.file1 LEFT JOIN (SELECT DISTINCT file_name, bid_group FROM summarize_file) AS b ON b.file_name = p.file2"
TAGS = f"""list_filter([CASE WHEN {any_of('text', '[A-Z][A-Z0-9-]+')} THEN '包含具体技术型号/参数' END, CASE WHEN {any_of('text', '健壮性|更好的前所未有|改进的联系')} THEN '含有非标准机器翻译痕迹' END,
CASE WHEN {any_of('text', '[0-9]+' + chr(92) + '.[0-9]+' + chr(92) + '.[0-9]+')} THEN '包含不规范编号标记' END, CASE WHEN length(text) > 80 AND NOT {template('text')} THEN '长段落逐字相同，排除独立编制的可能性' END], lambda x: x IS NOT NULL)"""
RATE_TEXT = f"translate(taxrate, '{text.WIDE_DIGITS}％', '{text.DIGITS}%')"
RATE = f"CASE WHEN regexp_extract({RATE_TEXT}, '([0-9]+(\\.[0-9]+)?)', 1) <> '' THEN CAST(regexp_extract({RATE_TEXT}, '([0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) / CASE WHEN contains({RATE_TEXT}, '‰') THEN 1000.0 ELSE 100.0 END END"
AMOUNT_TEXT = f"regexp_replace(translate(totalprice, '{text.WIDE_DIGITS}，．', '{text.DIGITS},.'), '[, \\t]', '', 'g')"


def ladder(by: str, value: str, source: str) -> str:
    return f"SELECT {by}, count(*) AS n, CAST(min(g) AS DOUBLE) AS gap FROM (SELECT {by}, t, t - lag(t) OVER (PARTITION BY {by} ORDER BY t) AS g FROM (SELECT DISTINCT {by}, CAST({value} AS DECIMAL(20,2)) AS t FROM {source}) WHERE t IS NOT NULL) GROUP BY {by} HAVING count(*) >= 3 AND min(g) = max(g)"


def fixed_labels(c: str) -> str:
    for bad, good in text.LABEL_FIXES:
        c = f"replace({c}, '{bad}', '{good}')"
    return c


def visible(c: str) -> str:
    c = f"regexp_replace({c}, '\\r\\n?', chr(10), 'g')"
    c = f"regexp_replace({c}, '[\\x{{0C}}\\x{{0B}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g')"
    return f"regexp_replace({c}, '[\\x{{200B}}-\\x{{200D}}\\x{{2060}}\\x{{FEFF}}\\x{{AD}}]', '', 'g')"


SHAPES = {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "digits11": "1[3-9][0-9]{9}", "digits18": "[0-9]{17}[0-9Xx]", "credit_code": "9[0-9A-Z]{17}", "landline": "0[0-9]{2,3}-[0-9]{7,8}"}
TRIGGER = "偏离|归档号|file mark|File mark"

ORACLES = {
    "flagship": f"SELECT l.pair_id, group1, group2, total, n_abnormal, n_substantial FROM ({LOOKUP}) AS l JOIN ({PAIR_COUNTS}) AS c ON c.pair_id = l.pair_id",
    "scan_type_dispatch": f"SELECT CASE WHEN {EXT} IN ('txt','xlsx','docx','doc','pdf') THEN {EXT} ELSE 'docx' END AS kind, count(*) AS n FROM {FILES} GROUP BY 1",
    "corpus_coverage": f"SELECT {EXT} AS kind, count(*) AS n_files, count(error_msg) AS n_error, count(*) FILTER (WHERE coalesce(length(text), 0) = 0) AS n_empty, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars FROM {FILES} GROUP BY 1",
    "norm_fold": f"SELECT file_id, {match_form('text')} AS form FROM {FILES}",
    "norm_visible": f"SELECT file_id, {fixed_labels(f'translate({visible(chr(116) + chr(101) + chr(120) + chr(116))}, {q(text.WIDE_DIGITS)}, {q(text.DIGITS)})')} AS form FROM {FILES}",
    "toc_dots_strip": f"SELECT doc_id, CAST(length(regexp_replace(text, {q(text.TOC_DOTS)}, '', 'g')) AS BIGINT) AS n_left FROM documents",
    "control_strip": f"SELECT doc_id, CAST(length(regexp_replace(text, {q(text.CONTROL)}, '', 'g')) AS BIGINT) AS n_left FROM documents",
    "fill_brackets_strip": f"SELECT match_id, replace(translate(replace(text, '{text.SHEET}', chr(1)), '【】', ''), chr(1), '{text.SHEET}') AS bare FROM {SEGMENTS}",
    "mask_values": f"SELECT person_id, 'id_number' AS kind, substring(v, 1, 6) || '****' AS masked FROM (SELECT person_id, unnest(id_numbers) AS v FROM {PEOPLE}) UNION ALL SELECT person_id, 'bank_account', CASE WHEN length(v) > 8 THEN substring(v, 1, 4) || '******' || right(v, 4) ELSE v END FROM (SELECT person_id, unnest(bank_accounts) AS v FROM {PEOPLE})",
    "name_forms": f"SELECT 'person' AS kind, person_id AS id, {key_of('person_name')} AS form FROM {PEOPLE} UNION ALL SELECT 'file', file_id, regexp_replace(regexp_replace(file_name, '^.*/', ''), '^[0-9a-f]{{8}}_', '') FROM {FILES} UNION ALL SELECT 'group', file_id, regexp_replace(regexp_replace(display_name, '\\.[A-Za-z0-9]+\\z', ''), '[_\\-\\t ]*[0-9]*\\z', '') FROM {FILES}",
    "item_name_forms": f"SELECT pricename, {NAME} AS form FROM (SELECT DISTINCT pricename FROM costdetails WHERE pricename IS NOT NULL)",
    "meaningful_chars": f"SELECT match_id, CAST(length(regexp_replace(text, '[^\\x{{4E00}}-\\x{{9FFF}}A-Za-z0-9]', '', 'g')) AS BIGINT) AS n FROM {SEGMENTS}",
    "template_rule_flag": f"SELECT match_id, {template('text')} AS template FROM {SEGMENTS}",
    "template_rule_lines": f"SELECT source, count(*) AS n_lines, count(*) FILTER (WHERE {template('line')}) AS n_template FROM {DOC_LINES} JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source",
    "boilerplate_density": f"SELECT match_id, round({occurrences('text', rules.FORMAL)} / greatest(length(text), 1), 6) AS density FROM {SEGMENTS}",
    "substantiality_score": f"SELECT match_id, round({substantiality('text')}, 6) AS score FROM {SEGMENTS}",
    "risk_level_counts": f"SELECT coalesce({LEVEL}, 'none') AS recorded, CASE WHEN {template('text')} THEN 'template' WHEN round({substantiality('text')}, 6) >= 0.6 THEN 'substantial' WHEN round({substantiality('text')}, 6) >= 0.3 THEN 'suspicious' ELSE 'template' END AS given, count(*) AS n FROM {SEGMENTS} WHERE text IS NOT NULL GROUP BY 1, 2",
    "reason_tags": f"SELECT match_id, unnest(CASE WHEN len(t) > 0 THEN t ELSE ['内容异常一致'] END) AS tag FROM (SELECT match_id, {TAGS} AS t FROM {SEGMENTS} WHERE text IS NOT NULL)",
    "pair_segment_counts": PAIR_COUNTS,
    "severity_topk": f"SELECT pair_id, match_id, rank FROM (SELECT pair_id, match_id, row_number() OVER (PARTITION BY pair_id ORDER BY CASE {LEVEL} WHEN 'substantial' THEN 0 WHEN 'suspicious' THEN 1 WHEN 'template' THEN 2 ELSE 3 END, score DESC NULLS LAST, match_id) AS rank FROM {SEGMENTS}) WHERE rank <= 3",
    "contact_pools": f"SELECT * FROM {TIDY}",
    "shared_contacts": f'SELECT kind, value, count(DISTINCT "group") AS n_groups, min("group") AS first_group, max("group") AS last_group FROM {TIDY} GROUP BY kind, value HAVING count(DISTINCT "group") >= 2',
    "shared_name_pairs": f"SELECT tender_id, name, count(DISTINCT bid_group) AS n_groups, count(DISTINCT role) AS n_roles FROM (SELECT tender_id, p.bid_group, {key_of('person_name')} AS name, coalesce({role('person_role')}, 'none') AS role FROM {PEOPLE} AS p JOIN {FILES} AS f USING (file_id) WHERE person_name IS NOT NULL AND tender_id IS NOT NULL) GROUP BY tender_id, name HAVING count(DISTINCT bid_group) > 1",
    "cross_role_matches": f"""WITH r AS (SELECT DISTINCT bid_group AS g, {key_of('person_name')} AS v, {role('person_role')} AS role FROM {PEOPLE} WHERE person_name IS NOT NULL)
SELECT a.g AS "left", b.g AS "right", a.v AS value FROM r AS a JOIN r AS b ON a.v = b.v AND a.g <> b.g WHERE a.role = 'authorized_rep' AND b.role = 'project_manager'""",
    "env_noise_by_frequency": f"""WITH t AS (SELECT DISTINCT tender_id AS scope, p.bid_group AS g, person_role AS value FROM {PEOPLE} AS p JOIN (SELECT DISTINCT bid_group, tender_id FROM {FILES} WHERE tender_id IS NOT NULL) AS f USING (bid_group) WHERE trim(person_role, ' ') <> ''),
n AS (SELECT scope, count(DISTINCT g) AS n_all FROM t GROUP BY scope)
SELECT scope, 'person_role' AS kind, value, count(DISTINCT g) AS n_groups, n_all FROM t JOIN n USING (scope) GROUP BY scope, value, n_all HAVING count(DISTINCT g) >= 3 AND count(DISTINCT g) >= 0.8 * n_all""",
    "env_noise_by_reference": f"SELECT kind, count(*) AS n_left FROM {TIDY} WHERE value NOT IN (SELECT DISTINCT unnest(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|[0-9]{{9,25}})', 1)) FROM documents WHERE doc_kind = 'tender' AND text IS NOT NULL) GROUP BY kind",
    "phone_forms": f"SELECT person_id, phone, CASE WHEN regexp_matches(x, '^1[3-9][0-9]{{9}}\\z') THEN x END AS mobile FROM (SELECT person_id, phone, CASE WHEN length(y) = 13 AND starts_with(y, '86') THEN substring(y, 3, 11) ELSE y END AS x FROM (SELECT person_id, phone, regexp_replace(phone, '[^0-9]', '', 'g') AS y FROM (SELECT person_id, unnest(phones) AS phone FROM {PEOPLE})))",
    "short_phone_anomaly": f"SELECT person_id, phone FROM (SELECT person_id, unnest(phones) AS phone FROM {PEOPLE}) WHERE length(regexp_replace(phone, '[^0-9]', '', 'g')) < 7",
    "role_counts": f"SELECT coalesce({role('person_role')}, 'none') AS role, count(*) AS n FROM {PEOPLE} GROUP BY 1",
    "best_person_per_role": f"SELECT file_id, role, person_id FROM (SELECT file_id, coalesce(person_role, '') AS role, person_id, row_number() OVER (PARTITION BY file_id, coalesce(person_role, '') ORDER BY confidence DESC NULLS LAST, person_id) AS k FROM {PEOPLE}) WHERE k = 1",
    "sensitive_shapes": " UNION ALL ".join(f"SELECT '{k}' AS shape, count(*) FILTER (WHERE len(v) > 0) AS n_texts, CAST(sum(len(v)) AS BIGINT) AS n_values FROM (SELECT regexp_extract_all(text, '{p}') AS v FROM {FILES} WHERE text IS NOT NULL)" for k, p in SHAPES.items()),
    "date_numbers": f"SELECT file_id, count(*) AS n_runs, count(*) FILTER (WHERE CAST(substring(run, 1, 4) AS INT) BETWEEN 1990 AND 2099 AND CAST(substring(run, 5, 2) AS INT) BETWEEN 1 AND 12 AND CAST(substring(run, 7, 2) AS INT) BETWEEN 1 AND 31) AS n_days FROM (SELECT file_id, unnest(regexp_extract_all(text, '[0-9]+')) AS run FROM {FILES}) WHERE length(run) = 8 GROUP BY file_id",
    "pair_enumeration": f"SELECT tender_id, n AS n_groups, n * (n - 1) // 2 AS n_unordered, n * (n - 1) AS n_ordered FROM (SELECT tender_id, count(DISTINCT bid_group) AS n FROM {FILES} WHERE tender_id IS NOT NULL AND bid_group IS NOT NULL GROUP BY tender_id)",
    "metadata_coalesce": f"SELECT bid_group, (arg_min(tender_id, (ord, file_id)) FILTER (WHERE tender_id <> '')) AS tender_id, (arg_min(display_name, (ord, file_id)) FILTER (WHERE display_name <> '')) AS display_name, (arg_min(error_msg, (ord, file_id)) FILTER (WHERE error_msg <> '')) AS error_msg FROM {FILES} GROUP BY bid_group",
    "overlap_rate": f"""WITH s AS (SELECT DISTINCT file_name AS g, pricename AS v FROM {FILES} JOIN costdetails USING (file_id) WHERE pricename IS NOT NULL), n AS (SELECT g, count(*) AS n FROM s GROUP BY g HAVING count(*) >= 2),
b AS (SELECT l, r, count(*) AS c FROM {LINKS} JOIN s AS x ON x.g = l JOIN s AS y ON y.g = r AND y.v = x.v GROUP BY l, r)
SELECT p.l AS "left", p.r AS "right", x.n AS n_left, y.n AS n_right, coalesce(c, 0) AS n_shared, round(coalesce(c, 0) / least(x.n, y.n), 6) AS rate FROM {LINKS} AS p JOIN n AS x ON x.g = p.l JOIN n AS y ON y.g = p.r LEFT JOIN b ON b.l = p.l AND b.r = p.r""",
    "volumes_joined": f"SELECT bid_group, count(*) AS n_volumes, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY ord, file_id)) AS digest FROM {FILES} GROUP BY bid_group",
    "pair_file_lookup": LOOKUP,
    "exact_duplicate_docs": f"SELECT min(doc_id) AS rep, count(*) AS n_texts FROM (SELECT doc_id, {match_form('text')} AS f FROM documents WHERE text IS NOT NULL) GROUP BY f HAVING count(*) > 1",
    "template_windows": f"""WITH f AS (SELECT tender_id AS scope, bid_group AS g, text FROM {FILES} WHERE tender_id IS NOT NULL AND bid_group IS NOT NULL AND text IS NOT NULL), n AS (SELECT scope, count(DISTINCT g) AS n_all FROM f GROUP BY scope),
w AS (SELECT scope, g, {match_form('substring(text, s + 1, 100)')} AS form FROM (SELECT scope, g, text, unnest(range(0, length(text) - 99, 50)) AS s FROM f WHERE length(text) >= 100))
SELECT scope, md5(form) AS digest, count(DISTINCT g) AS n_groups, n_all FROM w JOIN n USING (scope) WHERE length(form) >= 30 GROUP BY scope, form, n_all HAVING count(DISTINCT g) >= greatest(3, ceil(n_all / 2))""",
    "line_template_index": f"SELECT source, md5(form) AS digest, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, {match_form('line')} AS form FROM {DOC_LINES}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) WHERE length(form) >= 30 GROUP BY source, form HAVING count(DISTINCT doc_id) >= 3",
    "reference_subtraction": f"SELECT DISTINCT line FROM (SELECT line, {match_form('line')} AS form FROM (SELECT DISTINCT line FROM {DOC_LINES})) AS l JOIN (SELECT {match_form('text')} AS ref FROM eval_items) AS r ON contains(ref, form) WHERE length(form) >= 12",
    "paragraphs": f"SELECT doc_id, line_no AS ord, CAST(n AS BIGINT) AS n_form, k AS rank FROM (SELECT doc_id, line_no, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, line_no) AS k FROM (SELECT doc_id, line_no, length({match_form('line')}) AS n FROM {DOC_LINES}) WHERE n BETWEEN 40 AND 500) WHERE k <= 120",
    "pipe_table_rows": f"SELECT doc_id, line_no, region, row_no, CAST(len(string_split_regex(line, '[ \\t]*\\|[ \\t]*')) AS BIGINT) AS n_cells FROM {REGIONS}",
    "pipe_cell_values": f"""WITH r AS (SELECT doc_id, region, row_no, string_split_regex(line, '[ \\t]*\\|[ \\t]*') AS c FROM {REGIONS}), h AS (SELECT doc_id, region, c AS names FROM r WHERE row_no = 1),
v AS (SELECT doc_id, region, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS value FROM r WHERE row_no > 1)
SELECT header, count(*) AS n, count(DISTINCT value) AS n_distinct FROM (SELECT trim(names[i], ' ') AS header, trim(value, ' ') AS value FROM v JOIN h USING (doc_id, region)) WHERE header IS NOT NULL AND header <> '' GROUP BY header""",
    "forward_fill_cells": f"SELECT file_id, item_id, last_value(CASE WHEN trim(unit, ' ') <> '' THEN unit END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY item_id ROWS UNBOUNDED PRECEDING) AS unit FROM {ITEMS}",
    "wrapped_row_islands": f"SELECT file_id, CAST(row_no AS BIGINT) AS row_no, md5(string_agg(coalesce(line, ''), ' ' ORDER BY line_no)) AS digest, count(*) AS n_rows FROM (SELECT *, sum(CASE WHEN contains(line, ' | ') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS row_no FROM {FILE_LINES}) GROUP BY file_id, row_no",
    "empty_line_streaks": f"SELECT doc_id, count(DISTINCT g) AS n_streaks, count(*) AS n_empty FROM (SELECT doc_id, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM {DOC_LINES} WHERE trim(line, ' ') = '') GROUP BY doc_id",
    "section_slices": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no, line_no AS first_line, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), last + 1) - line_no AS n_lines FROM (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last FROM {DOC_LINES}) WHERE regexp_matches(line, '^(问[0-9]+：|[0-9]+\\. )')",
    "trigger_reach_lines": f"WITH l AS (SELECT * FROM {FILE_LINES}) SELECT file_id, count(DISTINCT l.line_no) AS n_lines FROM l JOIN (SELECT file_id, line_no AS hit FROM l WHERE regexp_matches(line, '{TRIGGER}')) AS h USING (file_id) WHERE l.line_no BETWEEN hit - 2 AND hit + 8 GROUP BY file_id",
    "project_vote": f"""SELECT tender_id, value, n_votes FROM (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY n_votes DESC, length(value) DESC, value DESC) AS k FROM (SELECT tender_id, regexp_replace(display_name, '(技术册|商务册|资格册|报价册)?(_[0-9]+)?\\.[A-Za-z]+$', '') AS value, count(*) AS n_votes FROM {FILES} WHERE tender_id IS NOT NULL GROUP BY 1, 2) WHERE value <> '') WHERE k = 1""",
    "amount_parse": f"SELECT price_id, CASE WHEN n <> '' THEN CAST(n AS DOUBLE) * CASE u WHEN '万' THEN 1e4 WHEN '亿' THEN 1e8 ELSE 1.0 END END AS amount FROM (SELECT price_id, regexp_extract(s, '([0-9]+(\\.[0-9]+)?)', 1) AS n, regexp_extract(s, '[0-9](元)?([万亿])', 2) AS u FROM (SELECT DISTINCT price_id, {AMOUNT_TEXT} AS s FROM prices WHERE totalprice IS NOT NULL))",
    "bid_totals_tax": f"SELECT price_id, round(r, 6) AS rate, CAST(round(CAST(CAST(totalpriceintax AS DECIMAL(20,2)) / (1 + CAST(r AS DECIMAL(10,6))) AS DECIMAL(20,6)), 2) AS DOUBLE) AS ex_tax FROM (SELECT *, {RATE} AS r FROM {PRICES})",
    "price_spread": f"SELECT tender_id, pricename, count(*) AS n, count(DISTINCT file_id) AS n_who, count(DISTINCT v) AS n_distinct, CAST(min(v) AS DOUBLE) AS lowest, CAST(max(v) AS DOUBLE) AS highest, CAST(round((max(v) - min(v))::DOUBLE / min(v)::DOUBLE * 100, 2) AS DOUBLE) AS spread_pct FROM (SELECT *, CAST(unitprice AS DECIMAL(20,2)) AS v FROM {ITEMS} WHERE unitprice > 0 AND pricename IS NOT NULL AND tender_id IS NOT NULL) GROUP BY tender_id, pricename HAVING count(*) > 1",
    "comparison_pivot": f"SELECT level, n_true, n_false, CAST((n_true IS NOT NULL)::INT + (n_false IS NOT NULL)::INT AS BIGINT) AS n_values, coalesce(n_true = n_false, true) AS same_all FROM (SELECT coalesce({LEVEL}, 'none') AS level, nullif(count(*) FILTER (WHERE abnormal), 0) AS n_true, nullif(count(*) FILTER (WHERE NOT abnormal), 0) AS n_false FROM {SEGMENTS} GROUP BY 1)",
    "sum_vs_total": f"SELECT file_id, n_items, CAST(s AS DOUBLE) AS item_sum, CAST(t AS DOUBLE) AS total, abs(s - t)::DOUBLE > t::DOUBLE * 0.05 AS off FROM (SELECT file_id, count(*) AS n_items, sum(CAST(totalprice AS DECIMAL(20,2))) AS s FROM {ITEMS} WHERE totalprice IS NOT NULL GROUP BY file_id) JOIN (SELECT file_id, CAST(max(cost_total) AS DECIMAL(20,2)) AS t FROM prices GROUP BY file_id) USING (file_id) WHERE t > 0",
    "plausible_items": f"SELECT file_id, count(*) AS n, CAST(sum(CAST(totalprice AS DECIMAL(20,2))) AS DOUBLE) AS total FROM {ITEMS} WHERE pricename IS NOT NULL AND length(trim(pricename, ' ')) BETWEEN 2 AND 15 AND NOT regexp_matches(trim(pricename, ' '), '[0-9]{{4,}}|合计|总计|小计|^[-/. \\t\\n]+\\z|税金') AND totalprice >= 100 AND (unitprice IS NULL OR unitprice <= 1.5 * totalprice) GROUP BY file_id",
    "bond_echo_exclusion": f"SELECT file_id, count(*) AS n FROM {ITEMS} AS i WHERE NOT EXISTS (SELECT 1 FROM (SELECT file_id AS f, unnest([revenue, cost_total]) AS o FROM prices) AS x WHERE x.f = i.file_id AND abs(i.totalprice - x.o) < 1) GROUP BY file_id",
    "item_jaccard": f"""WITH f AS (SELECT DISTINCT ref_id, form FROM (SELECT ref_id, {NAME.replace('pricename', 'canon_name')} AS form FROM price_ref) WHERE length(form) >= 4), g AS (SELECT DISTINCT ref_id, substring(form, i, 2) AS g FROM f, unnest(range(1, length(form))) AS t(i)),
n AS (SELECT ref_id, count(*) AS n FROM g GROUP BY ref_id), b AS (SELECT x.ref_id AS id1, y.ref_id AS id2, count(*) AS c FROM g AS x JOIN g AS y ON x.g = y.g AND x.ref_id < y.ref_id GROUP BY 1, 2)
SELECT id1, id2, round(c / (p.n + r.n - c), 6) AS jaccard FROM b JOIN n AS p ON p.ref_id = id1 JOIN n AS r ON r.ref_id = id2 WHERE c / (p.n + r.n - c) >= 0.3""",
    "channel_priority": f"SELECT file_id, channel, value FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY channel, price_id) AS k FROM (SELECT file_id, price_id, 0 AS channel, totalpriceintax AS value FROM {PRICES} UNION ALL SELECT file_id, price_id, 1, CASE WHEN n <> '' THEN CAST(n AS DOUBLE) * CASE u WHEN '万' THEN 1e4 WHEN '亿' THEN 1e8 ELSE 1.0 END END FROM (SELECT file_id, price_id, regexp_extract(s, '([0-9]+(\\.[0-9]+)?)', 1) AS n, regexp_extract(s, '[0-9](元)?([万亿])', 2) AS u FROM (SELECT file_id, price_id, {AMOUNT_TEXT} AS s FROM {PRICES})) UNION ALL SELECT file_id, price_id, 2, revenue FROM {PRICES} UNION ALL SELECT file_id, price_id, 3, cost_total FROM {PRICES}) WHERE value IS NOT NULL AND file_id IS NOT NULL) WHERE k = 1",
    "stats_totals": f"SELECT count(*) AS n, count(*) FILTER (WHERE total_matches IS NULL) AS n_null, round(avg(total_matches), 4) AS average, max(total_matches) AS highest, round(count(*) FILTER (WHERE total_matches >= 8) * 100.0 / count(total_matches), 4) AS highest_pct, count(*) FILTER (WHERE total_matches < 1) AS bin_0, count(*) FILTER (WHERE total_matches >= 1 AND total_matches < 2) AS bin_1, count(*) FILTER (WHERE total_matches >= 2 AND total_matches < 4) AS bin_2, count(*) FILTER (WHERE total_matches >= 4 AND total_matches < 8) AS bin_3, count(*) FILTER (WHERE total_matches >= 8) AS bin_4 FROM {RUNS}",
    "stats_timeline": f"SELECT CAST(run_at AS DATE) AS day, count(*) AS n, round(avg(total_matches), 4) AS average, count(*) FILTER (WHERE total_matches >= 3) AS n_high FROM {RUNS} WHERE run_at IS NOT NULL GROUP BY 1",
    "stats_dimensions": f"SELECT dimension, count(*) FILTER (WHERE n > 0) AS n_hit, CAST(sum(n) AS BIGINT) AS total FROM (SELECT 'total_matches' AS dimension, total_matches AS n FROM {RUNS} UNION ALL SELECT 'abnormal_count', abnormal_count FROM {RUNS} UNION ALL SELECT 'template_count', template_count FROM {RUNS}) GROUP BY dimension",
    "stats_recent": f"SELECT pair_id, total_matches FROM {RUNS} WHERE run_at IS NOT NULL ORDER BY run_at DESC, pair_id DESC LIMIT 8",
    "cache_keys": f"SELECT file_id, CASE WHEN length(text) > 0 THEN sha256(encode(text) || '\\x00'::BLOB || encode('v1')) END AS cache_key FROM {FILES}",
    "cache_dedup": f"SELECT cache_key, min(file_id) AS file_id, count(*) AS n FROM (SELECT file_id, sha256(encode(text) || '\\x00'::BLOB || encode('v1')) AS cache_key FROM {FILES} WHERE length(text) > 0) GROUP BY cache_key",
    "cache_lru": f"SELECT file_id FROM (SELECT file_id, row_number() OVER (ORDER BY loaded_at DESC, file_id DESC) AS k FROM {FILES} WHERE loaded_at IS NOT NULL) WHERE k > 200",
    "window_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "incremental_links": f"""WITH p AS (SELECT *, coalesce(year(loaded_at) >= 2025, false) AS fresh FROM {PEOPLE}),
t AS (SELECT DISTINCT fresh, g, kind, value FROM (SELECT fresh, bid_group AS g, 'phone' AS kind, unnest(phones) AS value FROM p UNION ALL SELECT fresh, bid_group, 'id_number', unnest(id_numbers) FROM p UNION ALL SELECT fresh, bid_group, 'email', unnest(emails) FROM p UNION ALL SELECT fresh, bid_group, 'bank_account', unnest(bank_accounts) FROM p UNION ALL SELECT fresh, bid_group, 'person', {key_of('person_name')} FROM p) WHERE g IS NOT NULL AND trim(value, ' ') <> '')
SELECT DISTINCT least(a.g, b.g) AS "left", greatest(a.g, b.g) AS "right", a.kind, a.value FROM t AS a JOIN t AS b ON a.kind = b.kind AND a.value = b.value AND a.g <> b.g WHERE a.fresh""",
    "gap_sessions": "SELECT user_id, CAST(max(s) AS BIGINT) AS n_sessions, count(*) AS n_events FROM (SELECT user_id, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id",
    "headings": "SELECT * FROM (SELECT file_id, line_no, trim(line, ' ') AS heading, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS rank FROM " + FILE_LINES + " WHERE regexp_matches(line, '(?i)^[ \\t]*(?:第[一二三四五六七八九十0-9]+[章节篇部分]|[一二三四五六七八九十]+[、，.]|[0-9]+(?:\\.[0-9]+)+|[0-9]+[. \\t]+|[（(][0-9]+[）)]|[（(][A-F][）)]|Section[ \\t]+[0-9]+|Appendix[ \\t]+[A-F]?|附录[ \\t]*[A-F0-9]*)[ \\t]*.')) WHERE rank <= 80",
    "shared_contact_pairs": f'''WITH t AS (SELECT * FROM {TIDY}), n AS (SELECT kind, value, count(DISTINCT "group") AS n_groups, min("group") AS first_group FROM t GROUP BY kind, value HAVING count(DISTINCT "group") >= 2), k AS (SELECT * FROM t JOIN n USING (kind, value))
SELECT a."group" AS "left", b."group" AS "right", a.kind, a.value, a.n_groups FROM k AS a JOIN k AS b ON a.kind = b.kind AND a.value = b.value AND a."group" < b."group" WHERE a.n_groups <= 50
UNION ALL SELECT first_group, "group", kind, value, n_groups FROM k WHERE n_groups > 50 AND "group" <> first_group''',
    "contact_stream": f'''WITH t AS (SELECT * FROM {TIDY}) SELECT a."group" AS "left", b."group" AS "right", a.kind, a.value FROM t AS a JOIN t AS b ON a.kind = b.kind AND a.value = b.value AND a."group" < b."group"''',
    "name_mentions": "SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM documents JOIN (SELECT DISTINCT item_id, regexp_extract(text, '^[^。.!?！？]+', 0) AS head FROM eval_items) AS i ON contains(documents.text, head) WHERE head <> '' GROUP BY item_id",
    "cost_name_mentions": "SELECT ref_id, count(DISTINCT doc_id) AS n_docs FROM documents JOIN (SELECT ref_id, unnest(list_append(coalesce(aliases, []), canon_name)) AS name FROM price_ref) AS r ON contains(documents.text, name) WHERE name <> '' GROUP BY ref_id",
    "typed_name_mentions": f"SELECT ref_id, count(DISTINCT item_id) AS n_items FROM {ITEMS} AS i JOIN (SELECT ref_id, unnest(list_append(coalesce(aliases, []), canon_name)) AS name FROM price_ref) AS r ON contains(i.pricename, name) WHERE name <> '' GROUP BY ref_id",
    "history_lighten": f"SELECT pair_id, m.match_id AS match_id, substring(m.text, 1, 200) AS text FROM (SELECT pair_id, unnest(matches) AS m FROM {RUNS} WHERE len(matches) > 0)",
    "common_runs": f"""WITH f AS (SELECT file_name, {match_form('text')} AS t FROM {FILES} WHERE text IS NOT NULL), p AS (SELECT DISTINCT least(file1, file2) AS l, greatest(file1, file2) AS r FROM pair_results WHERE file1 <> file2),
g AS (SELECT file_name, i, substring(t, i + 1, 15) AS g FROM f, unnest(range(0, length(t) - 14)) AS x(i) WHERE length(t) >= 15), m AS (SELECT l, r, a.i AS i, b.i AS j FROM p JOIN g AS a ON a.file_name = l JOIN g AS b ON b.file_name = r AND b.g = a.g),
n AS (SELECT l, r, i, j, i - row_number() OVER (PARTITION BY l, r, i - j ORDER BY i) AS k FROM m)
SELECT l AS "left", r AS "right", min(i) AS pos1, min(j) AS pos2, count(*) + 14 AS length FROM n GROUP BY l, r, i - j, k""",
    "near_paragraph_bands": f"""WITH q AS (SELECT file_name, o, form, length(form) AS n FROM (SELECT file_name, o, {match_form("trim(line, ' ')")} AS form FROM (SELECT file_name, unnest(range(0, len(string_split(text, chr(10))))) AS o, unnest(string_split(text, chr(10))) AS line FROM {FILES} WHERE text IS NOT NULL)) WHERE length(form) BETWEEN 40 AND 500),
p AS (SELECT DISTINCT least(file1, file2) AS l, greatest(file1, file2) AS r FROM pair_results WHERE file1 <> file2)
SELECT l AS "left", r AS "right", count(*) AS n FROM p JOIN q AS a ON a.file_name = l JOIN (SELECT DISTINCT file_name, form, n FROM q) AS b ON b.file_name = r AND abs(a.n - b.n) <= 0.3 * greatest(a.n, b.n) AND a.n // 25 - b.n // 25 BETWEEN -1 AND 1 GROUP BY l, r""",
    "similarity_levels": f"""WITH s AS (SELECT match_id, text, {match_form('text')} AS form FROM {SEGMENTS} WHERE text IS NOT NULL), e AS (SELECT DISTINCT {match_form('text')} AS ref FROM eval_items WHERE text IS NOT NULL)
SELECT match_id, CASE WHEN length(form) >= 12 AND EXISTS (SELECT 1 FROM e WHERE contains(ref, form)) THEN 'reference' WHEN {template('text')} THEN 'rule' WHEN round({substantiality('text')}, 6) >= 0.6 THEN 'substantial' WHEN round({substantiality('text')}, 6) >= 0.3 THEN 'suspicious' ELSE 'template' END AS level FROM s""",
}

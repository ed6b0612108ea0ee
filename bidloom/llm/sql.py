"""DuckDB counterparts of the queries that SQL can express over whole tables."""

from bidloom.llm.lookalikes import KANA, LATIN_TWIN, one_form

_SEGMENTS = """seg AS (
  SELECT DISTINCT match_id, text FROM (
    SELECT match_id, text FROM matches UNION ALL
    SELECT m.match_id, m.text FROM (SELECT unnest(matches) AS m FROM pair_results) AS x) AS y
  WHERE text IS NOT NULL),
gram AS (SELECT match_id, i, substring(text, i, 50) AS g FROM seg, unnest(range(1, length(text) - 48)) AS t(i) WHERE length(text) >= 50),
common AS (SELECT g FROM gram GROUP BY g HAVING min(match_id) <> max(match_id))"""

_LINKS = """link AS (
  SELECT DISTINCT file1 AS a, file2 AS b FROM pair_results WHERE file1 <> file2 AND total_matches >= 1
  UNION SELECT DISTINCT file2, file1 FROM pair_results WHERE file1 <> file2 AND total_matches >= 1),
reach AS (
  SELECT DISTINCT a AS v, a AS w FROM link
  UNION SELECT reach.v, link.b FROM reach JOIN link ON reach.w = link.a)"""

_WIDE = "".join(map(chr, (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))))
_NARROW = "0123456789" + "abcdefghijklmnopqrstuvwxyz" * 2


def _letters(c: str) -> str:
    return f"regexp_replace(lower(translate({c}, '{_WIDE}', '{_NARROW}')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


# Documents are cut into stretches of 2,000 that overlap by 39, since a substring far inside a long text is slow to take.
_LEAKS = f"""WITH i AS (SELECT DISTINCT item_id, {_letters('text')} AS t FROM eval_items),
g AS (SELECT DISTINCT item_id, substring(t, k, 40) AS g FROM i, unnest(range(1, length(t) - 38)) AS x(k) WHERE length(t) >= 40),
b AS (SELECT doc_id, {_letters('text')} AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, substring(t, 1 + j * 2000, 2039) AS t FROM b, unnest(range(0, length(t) // 2000 + 1)) AS y(j)),
h AS (SELECT DISTINCT doc_id, substring(t, k, 40) AS g FROM p, unnest(range(1, length(t) - 38)) AS x(k) WHERE length(t) >= 40)
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (g)"""


def _equal_looking() -> str:
    """Every character by its look, without regard to the word it stands in: coarser than the operator, the same where
    no word is written in another script altogether."""
    one = {chr(c): n for c, n in one_form().items() if len(n) == 1} | LATIN_TWIN | KANA
    gone = "".join(chr(c) for c, n in one_form().items() if n == "")
    have, want = (x.replace("'", "''") for x in ("".join(one), "".join(one.values())))
    form = f"nfc_normalize(translate(translate(text, '{have}{gone}', '{want}'), '{have}', '{want}'))"
    return f"""WITH f AS (SELECT DISTINCT src, id, text, {form} AS form FROM (SELECT 'summarize_file' AS src, file_id AS id, text FROM summarize_file UNION ALL SELECT 'prices', price_id, totalprice FROM prices) AS u WHERE text IS NOT NULL)
SELECT DISTINCT a.src, a.id AS id1, b.id AS id2 FROM f AS a JOIN f AS b ON a.src = b.src AND a.form = b.form AND a.id < b.id AND a.text <> b.text WHERE a.form <> ''"""


ORACLES = {
    "p2_found": f"""WITH {_SEGMENTS}, held AS (SELECT DISTINCT match_id, g FROM gram JOIN common USING (g))
SELECT DISTINCT x.match_id AS match_id1, y.match_id AS match_id2 FROM held AS x JOIN held AS y ON x.g = y.g AND x.match_id < y.match_id""",
    "p2_shared": f"""WITH {_SEGMENTS}, covered AS (
  SELECT match_id, count(DISTINCT p) AS c FROM (SELECT match_id, unnest(range(i, i + 50)) AS p FROM gram JOIN common USING (g)) AS z GROUP BY match_id)
SELECT seg.match_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(coalesce(c, 0) AS BIGINT) AS n_shared FROM seg LEFT JOIN covered USING (match_id)""",
    "p4_found": f"WITH RECURSIVE {_LINKS} SELECT v AS file_name, min(w) AS group_key FROM reach GROUP BY v",
    "p4_sizes": f"WITH RECURSIVE {_LINKS}, g AS (SELECT v, min(w) AS group_key FROM reach GROUP BY v) SELECT group_key, count(*) AS n_files FROM g GROUP BY group_key",
    "p6_found": _equal_looking(),
    "p8_found": _LEAKS,
}

"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from quillstone.llm.survivor import STAND_IN_WORDS

_BLANK = r"[\s\x{A0}\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
_WORDS = ", ".join(f"'{w}'" for w in STAND_IN_WORDS)

_CODES = r"""
WITH raw AS (
  SELECT regexp_replace(application_number, '[\s\x{A0}]+', '', 'g') AS app, unnest(list_append(coalesce(ipcr_classification, []), primary_ipc)) AS c FROM patent_clean),
flat AS (SELECT app, upper(regexp_replace(regexp_replace(c, '\([^)]*\)?', '', 'g'), '[\s\x{A0}]+', '', 'g')) AS c FROM raw WHERE app <> ''),
codes AS (
  SELECT app, CASE
    WHEN regexp_full_match(c, '[A-HY][0-9]{2}[A-Z][0-9]{1,6}/[0-9]{2,6}') THEN concat(c[1:4], CAST(CAST(regexp_extract(c, '^.{4}([0-9]+)/', 1) AS INT) AS VARCHAR), '/', regexp_extract(c, '/(.*)$', 1))
    WHEN regexp_full_match(c, '[A-HY][0-9]{2}[A-Z][0-9]{10}') THEN concat(c[1:4], CAST(CAST(c[5:8] AS INT) AS VARCHAR), '/', c[9:10], rtrim(c[11:14], '0')) END AS code
  FROM flat),
"""

_TEXTS6 = r"""
WITH words AS (SELECT text_id, regexp_extract_all(lower(concat(abstract, ' ', claim_1)), '[\pL\pN]+') AS w FROM patent_text
  WHERE regexp_replace(coalesce(abstract, ''), '[\s\x{A0}\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g') <> '' AND regexp_replace(coalesce(claim_1, ''), '[\s\x{A0}\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g') <> ''),
sets AS (SELECT text_id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])))) AS s FROM words WHERE len(w) >= 3),
"""
_PAIRS6 = """
pairs AS (SELECT a.text_id AS text_a, b.text_id AS text_b, len(list_intersect(a.s, b.s)) AS inter, len(a.s) + len(b.s) AS total FROM sets a JOIN sets b ON a.text_id < b.text_id AND len(a.s) * 2 >= len(b.s) AND len(b.s) * 2 >= len(a.s)),
near AS (SELECT text_a, text_b FROM pairs WHERE 2 * inter >= total - inter)
"""
_WINDOWS9 = lambda t, k: rf"SELECT {k}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM (SELECT {k}, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM {t}) WHERE len(w) >= 12"

ORACLE: dict[str, str] = {
    "p6_found": _TEXTS6 + _PAIRS6 + "SELECT text_a, text_b FROM near",
    "p6_classes": _TEXTS6 + _PAIRS6 + """, classes AS (SELECT text_id, min(text_id) OVER (PARTITION BY s) AS class_id FROM sets),
ends AS (SELECT text_a AS x, text_b AS y FROM near UNION ALL SELECT text_b, text_a FROM near),
links AS (SELECT c.class_id, count(DISTINCT d.class_id) AS links FROM ends JOIN classes c ON x = c.text_id JOIN classes d ON y = d.text_id WHERE c.class_id <> d.class_id GROUP BY 1)
SELECT text_id, class_id, coalesce(links, 0) AS links FROM classes LEFT JOIN links USING (class_id)""",
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_WINDOWS9('documents', 'doc_id')}) JOIN ({_WINDOWS9('eval_items', 'item_id')}) USING (g)",
    "p2_found": rf"""
WITH docs AS (
  SELECT regexp_replace(application_number, '[\s\x{{A0}}]+', '', 'g') AS application_number, rec_id, fetched_at,
         unnest(published_documents) AS d, unnest(range(len(published_documents))) AS pos
  FROM patent_clean),
texts AS (
  SELECT *, coalesce(list_position(['B9', 'B2', 'B1', 'C1', 'A2', 'A1'], upper(regexp_replace(coalesce(d.document_type_code, ''), '[^\pL\pN]+', '', 'g'))), 7) AS rank,
         len(list_filter(coalesce(d.claims, []), lambda c: regexp_replace(coalesce(c, ''), '{_BLANK}+', '', 'g') <> '')) AS n_claims,
         regexp_replace(coalesce(d.abstract, ''), '^{_BLANK}+|{_BLANK}+$', '', 'g') AS abstract, coalesce(d.claims_parse_ok, true) AS ok
  FROM docs WHERE d IS NOT NULL AND application_number <> ''),
sized AS (
  SELECT *, CASE WHEN NOT regexp_matches(abstract, '[\pL\pN]') OR (length(abstract) <= 120 AND NOT regexp_matches(abstract, '\pN')
                  AND len(list_filter(regexp_split_to_array(lower(abstract), '[^\pL]+'), lambda w: w <> '')) <= 15
                  AND len(list_filter(regexp_split_to_array(lower(abstract), '[^\pL]+'), lambda w: w <> '' AND w NOT IN ({_WORDS}))) = 0)
            THEN 0 ELSE length(abstract) END AS chars
  FROM texts),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY application_number ORDER BY rank, n_claims DESC, chars DESC, fetched_at DESC NULLS LAST, rec_id, pos) AS o FROM sized)
SELECT application_number,
       coalesce(arg_min(rec_id, o) FILTER (n_claims > 0 AND ok), -1) AS claims_rec, coalesce(arg_min(pos, o) FILTER (n_claims > 0 AND ok), -1) AS claims_pos,
       coalesce(arg_min(rec_id, o) FILTER (chars > 0), -1) AS abstract_rec, coalesce(arg_min(pos, o) FILTER (chars > 0), -1) AS abstract_pos
FROM ordered GROUP BY 1 HAVING count(*) >= 2
""",
    "p5_found": _CODES + """counts AS (SELECT code, count(DISTINCT app) AS n FROM codes WHERE code IS NOT NULL GROUP BY 1),
marks AS (SELECT code, CASE WHEN n <= 2 THEN 'rare' WHEN n >= 0.05 * (SELECT count(DISTINCT app) FROM flat) THEN 'common' END AS mark FROM counts)
SELECT code, mark FROM marks WHERE mark IS NOT NULL
""",
    "p5_code_counts": _CODES + """
counts AS (SELECT code, count(*) AS uses, count(DISTINCT app) AS applications FROM codes WHERE code IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN applications <= 2 THEN 'rare' WHEN applications >= 0.05 * (SELECT count(DISTINCT app) FROM flat) THEN 'common' END AS mark FROM counts
""",
}

"""DuckDB SQL for the core queries that SQL can express, over the same tables."""

_STRIP = lambda c: rf"regexp_replace(coalesce({c}, ''), '^[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+|[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+$', '', 'g')"
_IPC = lambda c: f"replace(upper({_STRIP(c)}), ' ', '')"
_TOKENS = lambda c: rf"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[\s\x{{A0}}\x{{85}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda w: w <> '')"
_CODES = f"SELECT rec_id, {_IPC('c')} AS code FROM (SELECT rec_id, unnest(ipcr_classification) AS c FROM patent_clean) WHERE {_IPC('c')} <> ''"
_COUNTS = f"SELECT code, count(*) AS n FROM ({_CODES}) GROUP BY 1"
_RANK = "CASE upper({0}) WHEN 'B9' THEN 60 WHEN 'B2' THEN 50 WHEN 'B1' THEN 40 WHEN 'C1' THEN 30 WHEN 'A2' THEN 20 WHEN 'A1' THEN 10 ELSE 0 END".format(_STRIP("d.document_type_code"))
_PRIMARY = f"""
SELECT * FROM (
  SELECT rec_id, application_number, invention_title, primary_ipc, d, row_number() OVER (PARTITION BY rec_id ORDER BY {_RANK} DESC, coalesce(len(d.claims), 0) DESC, length({_STRIP('d.abstract')}) DESC, pos) AS o
  FROM (SELECT rec_id, application_number, invention_title, primary_ipc, unnest(published_documents) AS d, unnest(range(len(published_documents))) AS pos FROM patent_clean) WHERE d IS NOT NULL)
WHERE o = 1"""
_CLAIMS = f"list_filter(list_transform(coalesce(d.claims, []), lambda c: {_STRIP('c')}), lambda c: c <> '')"
_METRICS = f"""
SELECT p.rec_id, coalesce(len({_CLAIMS}), 0) AS n_claims, length({_STRIP('d.abstract')}) AS abstract_chars,
       CASE WHEN len({_CLAIMS}) > 0 THEN list_sum(list_transform({_CLAIMS}, lambda c: len({_TOKENS('c')})))::DOUBLE / len({_CLAIMS}) END AS mean_words
FROM (SELECT rec_id FROM patent_clean) p LEFT JOIN ({_PRIMARY}) q ON p.rec_id = q.rec_id"""
_OBJECT = "json_type(response) = 'OBJECT'"
_ANSWER = r"(?is)Classification:\s*(\S+)\s*\nJustification:\s*(.+)"
_SYMBOL = "[A-H][0-9]{2}[A-Z](?:[0-9]{1,4}/[0-9]{2,6})?"
_ANS_CODE = rf"nullif({_IPC(f'''regexp_extract({_STRIP('output')}, '{_ANSWER}', 1)''')}, '')"
_ANS_BODY = f"nullif({_STRIP(f'''regexp_extract({_STRIP('output')}, '{_ANSWER}', 2)''')}, '')"
_IPC_RULES = rf"""list_filter([
  CASE WHEN want IS NULL OR NOT regexp_full_match(want, '{_SYMBOL}') THEN 'primary_ipc_invalid' END,
  CASE WHEN code IS NULL OR body IS NULL THEN 'output_parse_failed' END,
  CASE WHEN code IS NOT NULL AND body IS NOT NULL AND NOT regexp_full_match(code, '{_SYMBOL}') THEN 'classification_code_invalid' END,
  CASE WHEN code IS NOT NULL AND body IS NOT NULL AND code <> want THEN 'ipc_code_mismatch' END,
  CASE WHEN code IS NOT NULL AND body IS NOT NULL AND len(list_filter(regexp_extract_all(body, '\b({_SYMBOL})\b', 1), lambda s: s <> want)) > 0 THEN 'conflicting_ipc_in_justification' END], lambda x: x IS NOT NULL)"""
_BLANK = lambda k: f"CASE WHEN {_STRIP(k)} = '' THEN 'empty:{k}' END"
_SCHEMA = f"[{', '.join(_BLANK(k) for k in ('instruction', 'input', 'output', 'application_number'))}"
_LIGHT = f"""[CASE WHEN coalesce(task, '') = 'abstract_drafting' AND length(coalesce(output, '')) > greatest(2 * length(coalesce(input, '')), 50000) THEN 'output_too_long_vs_input' END,
  CASE WHEN coalesce(task, '') = 'mrc' AND NOT contains(coalesce(instruction, ''), '?') THEN 'mrc_instruction_not_question' END,
  CASE WHEN coalesce(task, '') = 'mrc' AND length({_STRIP('output')}) >= length({_STRIP('input')}) THEN 'mrc_answer_not_shorter_than_claims' END]"""
_SPACES = r"[\s\x{A0}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_FORM = lambda c: rf"trim(regexp_replace(lower(coalesce({c}, '')), '{_SPACES}', ' ', 'g'))"
_CONTAINED = f"({_FORM('output')} <> '' AND contains({_FORM('input')}, {_FORM('output')}))"
_F1 = f"""CASE WHEN len({_TOKENS('input')}) + len({_TOKENS('output')}) = 0 THEN 0.0 ELSE
  2.0 * coalesce(list_sum(list_transform(list_intersect(list_distinct({_TOKENS('input')}), list_distinct({_TOKENS('output')})),
    lambda w: least(len(list_filter({_TOKENS('input')}, lambda x: x = w)), len(list_filter({_TOKENS('output')}, lambda x: x = w))))), 0) / (len({_TOKENS('input')}) + len({_TOKENS('output')})) END"""
_RULES = f"""
SELECT *, list_filter(list_concat({_SCHEMA}, CASE WHEN meta IS NULL THEN 'meta_not_object' END], {_LIGHT},
    CASE WHEN task = 'ipc_reasoning' THEN {_IPC_RULES} ELSE [] END,
    [CASE WHEN task = 'mrc' AND NOT {_CONTAINED} AND {_F1} < 0.1 THEN 'mrc_lexical_below_floor' END]), lambda x: x IS NOT NULL) AS rules
FROM (SELECT *, nullif({_IPC('meta.primary_ipc')}, '') AS want, {_ANS_CODE} AS code, {_ANS_BODY} AS body FROM instructions)"""
_SCORES = "SELECT vec_id, label, list_transform(embedding[1:8], lambda x: round(abs(x::DOUBLE), 6)) AS scores FROM embeddings"
_KEPT = f"SELECT vec_id, list_filter(['L00','L01','L02','L03','L04','L05','L06','L07'], lambda l, i: scores[i] > 0.1) AS labels FROM ({_SCORES})"
_VERDICTS = """
SELECT *, CASE WHEN k = 1 THEN NULL WHEN s BETWEEN 1 AND 5 THEN s END AS score,
  CASE WHEN k = 1 OR s NOT BETWEEN 1 AND 5 THEN NULL WHEN k = 0 THEN s >= 4 ELSE false END AS pass,
  CASE WHEN k = 1 OR s NOT BETWEEN 1 AND 5 THEN NULL WHEN k = 0 THEN 'short,off_topic' ELSE 'strict' END AS tags
FROM (SELECT row_id, lower(task) AS task, row_id % 3 AS k, row_id % 7 AS s FROM instructions)"""
_REPORT = f"""
SELECT task, count(score) AS judged, count(*) - count(score) AS errors, coalesce(sum(score), 0)::BIGINT AS score_sum, count(*) FILTER (pass) AS passed,
  round(sum(score) / nullif(count(score), 0), 6) AS mean_score, round(count(*) FILTER (pass) / nullif(count(score), 0), 6) AS pass_rate FROM ({_VERDICTS}) GROUP BY 1"""
_NUMBER = f"CASE WHEN {_STRIP('application_number')} <> '' THEN {_STRIP('application_number')} ELSE NULL END"


def _clip(rows: str, cols: list[str]) -> str:
    caps = ", ".join(f"quantile_cont({c}, 0.99) AS cap_{c}" for c in cols)
    return f"SELECT r.* FROM ({rows}) r, (SELECT {caps} FROM ({rows})) k WHERE " + " AND ".join(f"r.{c} <= k.cap_{c}" for c in cols)


_NAMES = lambda f: f"coalesce(array_to_string(list_filter(list_transform(list_filter(CASE WHEN json_type(response, '$.{f}') = 'ARRAY' THEN CAST(json_extract(response, '$.{f}') AS JSON[]) ELSE [] END, lambda x: json_type(x) = 'OBJECT' AND json_type(x, '$.legalEntityName') = 'VARCHAR'), lambda x: {_STRIP('''json_extract_string(x, '$.legalEntityName')''')}), lambda n: n <> ''), '|'), '')"

# Records out of any number of JSON strings around them, and the objects of their child nodes.
_RECORDS = """WITH RECURSIVE raw AS (
  SELECT rec_id, ltrim(response, chr(65279)) AS v FROM patent_search WHERE response IS NOT NULL
  UNION ALL SELECT rec_id, ltrim(json_extract_string(v, '$'), chr(65279)) FROM raw WHERE json_valid(v) AND json_type(v) = 'VARCHAR'),
rec AS (SELECT rec_id, v::JSON AS v FROM raw WHERE json_valid(v) AND json_type(v) = 'OBJECT'),
"""
_CHILDREN = {"applicant": "applicant", "inventors": "inventors", "publishedDocuments": "publishedDocuments", "inventionTitle": "bibliographicData.inventionTitle", "ipcrClassification": "bibliographicData.ipcrClassification"}


def _child_rows(node: str) -> str:
    """(rec_id, v, x, pos, listed) of a node's objects; a bare object is at place 0."""
    path = f"$.{_CHILDREN[node]}"
    return f"""SELECT * FROM (
  SELECT rec_id, v, unnest(CAST(json_extract(v, '{path}') AS JSON[])) AS x, unnest(range(len(CAST(json_extract(v, '{path}') AS JSON[])))) AS pos, true AS listed FROM rec WHERE json_type(v, '{path}') = 'ARRAY'
  UNION ALL SELECT rec_id, v, json_extract(v, '{path}'), 0, false FROM rec WHERE json_type(v, '{path}') = 'OBJECT') WHERE json_type(x) = 'OBJECT'"""


_SCALAR = lambda x, f: f"CASE WHEN json_type({x}, '$.{f}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string({x}, '$.{f}') END"


def _child_sql(node: str, fields: list[str]) -> str:
    *outer, name = _CHILDREN[node].split(".")
    place = lambda o, k: f"list_position(json_keys({o}), '{k}') - 1"
    above = [place("v", outer[0])] if outer else []
    of = place(f"json_extract(v, '$.{outer[0]}')", name) if outer else place("v", name)
    array = f"concat_ws('.', {', '.join([*above, of])})"
    outside = above[0] if above else "NULL"
    return f"""{_RECORDS} x AS ({_child_rows(node)})
SELECT rec_id, CASE WHEN listed THEN concat({array}, '.', pos) ELSE {array} END AS label, CASE WHEN listed THEN {array} ELSE coalesce(CAST({outside} AS VARCHAR), '') END AS parent, pos::INT AS pos,
  {", ".join(f'{_SCALAR("x", f)} AS "{f}"' for f in fields)} FROM x"""


_SEQ = rf"""CASE json_type(x, '$.sequenceNumber') WHEN 'BIGINT' THEN json_extract_string(x, '$.sequenceNumber')::BIGINT WHEN 'UBIGINT' THEN TRY_CAST(json_extract_string(x, '$.sequenceNumber') AS BIGINT)
  WHEN 'DOUBLE' THEN CASE WHEN json_extract(x, '$.sequenceNumber')::DOUBLE = floor(json_extract(x, '$.sequenceNumber')::DOUBLE) THEN json_extract(x, '$.sequenceNumber')::DOUBLE::BIGINT END
  WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match({_STRIP("json_extract_string(x, '$.sequenceNumber')")}, '[+-]?[0-9]+') THEN TRY_CAST({_STRIP("json_extract_string(x, '$.sequenceNumber')")} AS BIGINT) END END"""

ORACLE: dict[str, str] = {
    "p1_found": f"""{_RECORDS} x AS ({" UNION ALL ".join(f"SELECT rec_id, '{n}' AS node, pos, x FROM ({_child_rows(n)})" for n in _CHILDREN)})
SELECT rec_id, node, pos FROM x WHERE len(json_keys(x)) > 0""",
    "p1_records": f"{_RECORDS} one AS (SELECT 1) SELECT rec_id, {', '.join(f'{_SCALAR(chr(118), f)} AS {chr(34)}{f.rpartition(chr(46))[2]}{chr(34)}' for f in ('ipRightStatusCode', 'filedDate', 'priorityDate', 'expiryDate', 'bibliographicData.applicationNumber', 'bibliographicData.patentApplicationType'))} FROM rec",
    "p1_applicant": _child_sql("applicant", ["legalEntityName"]),
    "p1_inventors": _child_sql("inventors", ["legalEntityName"]),
    "p1_published_documents": _child_sql("publishedDocuments", ["documentTypeCode", "fileName", "abstractText", "claimsText"]),
    "p1_invention_title": _child_sql("inventionTitle", ["title", "language"]),
    "p1_ipcr_classification": _child_sql("ipcrClassification", ["classificationText", "sequenceNumber"]),
    "p1_schema_paths": _RECORDS + r""" nodes AS (SELECT rec_id, regexp_replace(j.fullkey, '\[\d+\]', '[]', 'g') AS path, j.type FROM rec, json_tree(rec.v) j)
SELECT path, CASE WHEN type = 'OBJECT' THEN 'object' WHEN type = 'ARRAY' THEN 'array' WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'NULL' THEN 'null' ELSE 'number' END AS kind,
  count(*) AS nodes, count(DISTINCT rec_id) AS records FROM nodes GROUP BY ALL""",
    "primary_label": rf"""
WITH v AS (SELECT rec_id, CASE WHEN json_valid(response) AND json_type(response) = 'OBJECT' THEN response::JSON END AS response FROM patent_search),
raw AS (SELECT rec_id, unnest(CAST(json_extract(response, '$.bibliographicData.ipcrClassification') AS JSON[])) AS x, unnest(range(len(CAST(json_extract(response, '$.bibliographicData.ipcrClassification') AS JSON[])))) AS pos
  FROM v WHERE json_type(response, '$.bibliographicData.ipcrClassification') = 'ARRAY'),
codes AS (SELECT rec_id, pos, {_STRIP("json_extract_string(x, '$.classificationText')")} AS code, {_SEQ} AS seq FROM raw WHERE json_type(x) = 'OBJECT' AND json_type(x, '$.classificationText') = 'VARCHAR'),
best AS (SELECT rec_id, count(*) AS codes, first(code ORDER BY seq NULLS LAST, pos) AS code FROM codes WHERE code <> '' GROUP BY 1)
SELECT v.rec_id, coalesce(code, '') AS primary_ipc, coalesce(codes, 0) AS codes FROM v LEFT JOIN best USING (rec_id)""",
    "label_counts": _COUNTS,
    "label_counts_top40": f"{_COUNTS} ORDER BY n DESC, code LIMIT 40",
    "label_freq_of_freq": f"SELECT n, count(*) AS codes FROM ({_COUNTS}) GROUP BY 1",
    "label_tail_summary": f"""
WITH t AS (SELECT count(*) AS codes, count(*) FILTER (n = 1) AS ones, count(*) FILTER (n <= 5) AS few, coalesce(sum(n), 0) AS uses FROM ({_COUNTS}))
SELECT unnest(['unique_codes', 'singleton_codes', 'singleton_pct', 'few_codes', 'few_pct', 'assignments', 'singleton_assignments', 'singleton_assignments_pct']) AS metric,
       unnest([codes, ones, round(100.0 * ones / codes, 4), few, round(100.0 * few / codes, 4), uses, ones, round(100.0 * ones / uses, 4)]::DOUBLE[]) AS value FROM t""",
    "prefix_subset_counts": f"""
SELECT code, count(*) AS n FROM ({_CODES}) WHERE rec_id IN (SELECT rec_id FROM ({_CODES}) WHERE starts_with(code, 'A01B') OR starts_with(code, 'A42') OR starts_with(code, 'H6')) GROUP BY 1""",
    "metric_stats": " UNION ALL ".join(f"SELECT '{c}' AS metric, count({c}) AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean FROM ({_METRICS})" for c in ("n_claims", "abstract_chars", "mean_words")),
    "p99_clip": f"SELECT rec_id, n_claims, abstract_chars FROM ({_clip(_METRICS, ['n_claims', 'abstract_chars'])})",
    "percentile_cap": "SELECT round(quantile_cont(n_chars, 0.99), 6) AS cap FROM documents",
    "hist_equal_width": f"""
WITH k AS ({_clip('SELECT n_chars FROM documents WHERE n_chars IS NOT NULL', ['n_chars'])}),
e AS (SELECT greatest(10, least(40, floor(sqrt(count(*)))))::BIGINT AS bins, min(n_chars)::DOUBLE AS low, max(n_chars)::DOUBLE AS high FROM k)
SELECT bin, round(low + bin * (high - low) / bins, 6) AS low, round(low + (bin + 1) * (high - low) / bins, 6) AS high, n
FROM (SELECT least(floor((n_chars - low) / ((high - low) / bins)), bins - 1)::BIGINT AS bin, count(*) AS n FROM k, e GROUP BY 1), e""",
    "hist_integer": f"SELECT n_claims AS value, count(*) AS n FROM ({_clip(f'SELECT n_claims FROM ({_METRICS}) WHERE n_claims > 0', ['n_claims'])}) GROUP BY 1",
    "hist_2d": f"""
WITH k AS ({_clip(_METRICS, ['n_claims', 'abstract_chars'])}), e AS (SELECT min(n_claims) AS xl, max(n_claims) AS xh, min(abstract_chars) AS yl, max(abstract_chars) AS yh FROM k)
SELECT least(floor((n_claims - xl) / ((xh - xl) / 20)), 19)::BIGINT AS x_bin, least(floor((abstract_chars - yl) / ((yh - yl) / 20)), 19)::BIGINT AS y_bin, count(*) AS n FROM k, e GROUP BY 1, 2""",
    "corpus_summary": """
SELECT count(*) AS records, round(sum(d) / count(*), 4) AS documents_per_record, round(sum(c) / sum(d), 4) AS claims_chars_per_document, round(sum(a) / sum(d), 4) AS abstract_chars_per_document, count(*) FILTER (d > 0) AS with_documents, count(*) FILTER (coded) AS with_codes
FROM (SELECT coalesce(len(published_documents), 0) AS d, coalesce(list_sum(list_transform(published_documents, lambda x: coalesce(length(array_to_string(x.claims, '')), 0))), 0) AS c,
  coalesce(list_sum(list_transform(published_documents, lambda x: coalesce(length(x.abstract), 0))), 0) AS a, ipcr_classification IS NOT NULL AS coded FROM patent_clean)""",
    "clean_record_fields": rf"""
WITH v AS (SELECT rec_id, application_number, CASE WHEN json_valid(response) AND json_type(response) = 'OBJECT' THEN response::JSON END AS response FROM patent_search)
SELECT rec_id, CASE WHEN {_STRIP('application_number')} <> '' THEN {_STRIP('application_number')} ELSE {_STRIP("json_extract_string(response, '$.bibliographicData.applicationNumber')")} END AS application_number,
  {_NAMES('applicant')} AS applicant, {_NAMES('inventors')} AS inventors,
  coalesce(list_filter(list_transform(list_filter(CASE WHEN json_type(response, '$.bibliographicData.inventionTitle') = 'ARRAY' THEN CAST(json_extract(response, '$.bibliographicData.inventionTitle') AS JSON[]) ELSE [] END,
    lambda x: json_type(x) = 'OBJECT' AND json_type(x, '$.title') = 'VARCHAR'), lambda x: {_STRIP('''json_extract_string(x, '$.title')''')}), lambda n: n <> '')[1], '') AS invention_title,
  coalesce(json_extract_string(response, '$.bibliographicData.patentApplicationType'), '') AS patent_application_type,
  len(list_filter(CASE WHEN json_type(response, '$.publishedDocuments') = 'ARRAY' THEN CAST(json_extract(response, '$.publishedDocuments') AS JSON[]) ELSE [] END, lambda x: json_type(x) = 'OBJECT')) AS documents
FROM v""",
    "parse_claims_roundtrip": rf"""
SELECT rec_id, pos, len(c) AS claims, len(c) AS parsed, array_to_string(list_transform(c, lambda x, i: concat(i, '. ', x)), chr(10)) AS text FROM (
  SELECT rec_id, pos, list_filter(list_transform(coalesce(d.claims, []), lambda x: regexp_replace(regexp_replace(trim(regexp_replace(coalesce(x, ''), '{_SPACES}', ' ', 'g')), '^[0-9]+\.\s*', ''), '\.$', '')),
    lambda x: regexp_full_match(x, '[A-Z][A-Za-z0-9 ,;:-]{{30,}}[a-z]') AND NOT regexp_matches(x, '(?i)claims|what is claimed|\d-|-\d')) AS c
  FROM (SELECT rec_id, unnest(published_documents) AS d, unnest(range(len(published_documents))) AS pos FROM patent_clean))""",
    "primary_document": f"SELECT rec_id, d.document_type_code AS document_type_code, d.file_name AS file_name FROM ({_PRIMARY})",
    "patent_texts": f"""
SELECT * FROM (SELECT {_STRIP('application_number')} AS application_number, coalesce(invention_title, '') AS invention_title, coalesce(primary_ipc, '') AS primary_ipc, {_STRIP('d.abstract')} AS abstract,
  array_to_string({_CLAIMS}, chr(10) || chr(10)) AS claims_text, coalesce({_CLAIMS}[1], '') AS claim_1, coalesce(d.document_type_code, '') AS document_type, rec_id
  FROM ({_PRIMARY}) WHERE coalesce(d.claims_parse_ok, true)) WHERE application_number <> '' AND abstract <> '' AND claims_text <> ''""",
    "text_exports_abstracts": f"SELECT {_STRIP('c.application_number')} AS application_number, {_STRIP('c.invention_title')} AS invention_title, {_STRIP('d.abstract')} AS abstract FROM patent_clean c LEFT JOIN ({_PRIMARY}) p ON c.rec_id = p.rec_id WHERE {_STRIP('c.application_number')} <> ''",
    "text_exports_first_claims": f"SELECT {_STRIP('c.application_number')} AS application_number, {_STRIP('c.invention_title')} AS invention_title, coalesce({_CLAIMS}[1], '') AS claim FROM patent_clean c LEFT JOIN ({_PRIMARY}) p ON c.rec_id = p.rec_id WHERE {_STRIP('c.application_number')} <> ''",
    "text_exports_claims": f"""
SELECT {_STRIP('application_number')} AS application_number, {_STRIP('invention_title')} AS invention_title, n AS claim_no, {_STRIP('claim')} AS claim
FROM (SELECT application_number, invention_title, unnest(d.claims) AS claim, unnest(range(1, len(d.claims) + 1)) AS n FROM ({_PRIMARY})) WHERE {_STRIP('application_number')} <> '' AND {_STRIP('claim')} <> ''""",
    "claim_seq": f"SELECT {_STRIP('application_number')} AS application_number, text_id, row_number() OVER (PARTITION BY {_STRIP('application_number')} ORDER BY text_id) AS claim_seq FROM patent_text WHERE {_STRIP('application_number')} <> '' AND {_STRIP('claim_1')} <> ''",
    "row_shards": "SELECT text_id, row_number() OVER (ORDER BY text_id) - 1 AS row_index, (row_number() OVER (ORDER BY text_id) - 1) // 1000 AS shard FROM patent_text",
    "pending_ids": f"SELECT DISTINCT {_STRIP('application_number')} AS application_number FROM patent_clean WHERE {_STRIP('application_number')} <> '' AND {_STRIP('application_number')} NOT IN (SELECT {_STRIP('application_number')} FROM patent_text)",
    "ids_recovered": "SELECT application_number FROM patent_text WHERE application_number IS NOT NULL UNION SELECT application_number FROM instructions WHERE application_number IS NOT NULL",
    "ordered_distinct": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS o FROM events) WHERE o = 1",
    "catalog_lookup": f"SELECT code, kind, title FROM (SELECT *, {_IPC('ipc_code')} AS code, row_number() OVER (PARTITION BY {_IPC('ipc_code')} ORDER BY ipc_code_raw DESC NULLS LAST, kind DESC NULLS LAST, title DESC) AS o FROM ipc_catalog WHERE {_IPC('ipc_code')} <> '' AND trim(title) <> '') WHERE o = 1",
    "catalog_join": f"""
SELECT c.rec_id, l.code, concat_ws(chr(10), concat_ws(' ', l.code, l.title), coalesce(nullif(l.definition_statement, ''), nullif(l.scheme_note, ''))) AS grounding
FROM (SELECT rec_id, {_IPC('primary_ipc')} AS code FROM patent_clean) c JOIN (
  SELECT * FROM (SELECT * EXCLUDE (ipc_code), {_IPC('ipc_code')} AS code, row_number() OVER (PARTITION BY {_IPC('ipc_code')} ORDER BY ipc_code_raw DESC NULLS LAST, kind DESC NULLS LAST, title DESC) AS o FROM ipc_catalog WHERE {_IPC('ipc_code')} <> '' AND trim(title) <> '')
  WHERE o = 1 AND trim(definition_statement) <> '') l ON c.code = l.code""",
    "catalog_best_kind": "SELECT ipc_code_raw, kind, title FROM (SELECT *, row_number() OVER (PARTITION BY ipc_code_raw ORDER BY list_position(['s','c','u','m','1','2','3','4','5','6','7','8','9'], kind) DESC, title NULLS FIRST) AS o FROM ipc_catalog WHERE kind IN ('s','c','u','m','1','2','3','4','5','6','7','8','9')) WHERE o = 1",
    "catalog_with_notes": """
SELECT b.ipc_code_raw, b.kind, coalesce(b.has_definition_entry, false) AS has_definition_entry, n.notes FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ipc_code_raw ORDER BY list_position(['s','c','u','m','1','2','3','4','5','6','7','8','9'], kind) DESC, title NULLS FIRST) AS o FROM ipc_catalog WHERE kind IN ('s','c','u','m','1','2','3','4','5','6','7','8','9')) WHERE o = 1) b
LEFT JOIN (SELECT ipc_code_raw, string_agg(DISTINCT scheme_note, ' ' ORDER BY scheme_note) AS notes FROM ipc_catalog WHERE scheme_note IS NOT NULL GROUP BY 1) n ON b.ipc_code_raw = n.ipc_code_raw""",
    "hash_sample": "SELECT application_number FROM (SELECT DISTINCT application_number FROM instructions WHERE application_number IS NOT NULL ORDER BY md5('42:' || application_number), application_number LIMIT 50) WHERE application_number NOT IN (SELECT application_number FROM patent_text WHERE application_number IS NOT NULL)",
    "symbol_format": """
SELECT DISTINCT ipc_code_raw, CASE WHEN length(ipc_code_raw) = 14 AND TRY_CAST(ipc_code_raw[5:8] AS INT) IS NOT NULL
  THEN concat(ipc_code_raw[1:4], CAST(CAST(ipc_code_raw[5:8] AS INT) AS VARCHAR), '/', CASE WHEN rtrim(ipc_code_raw[9:14], '0') = '' THEN '00' ELSE rtrim(ipc_code_raw[9:14], '0') END) ELSE ipc_code_raw END AS formatted FROM ipc_catalog""",
    "ipc_check": f"SELECT row_id, code, array_to_string({_IPC_RULES}, ',') AS failures FROM (SELECT *, nullif({_IPC('meta.primary_ipc')}, '') AS want, {_ANS_CODE} AS code, {_ANS_BODY} AS body FROM instructions WHERE lower(task) = 'ipc_reasoning')",
    "schema_check": f"SELECT row_id, array_to_string(list_filter({_SCHEMA}, CASE WHEN task IS DISTINCT FROM lower(task) THEN concat('task_mismatch:', coalesce(task, 'None')) END, CASE WHEN meta IS NULL THEN 'meta_not_object' END], lambda x: x IS NOT NULL), ',') AS failures FROM instructions",
    "task_light": f"SELECT row_id, array_to_string(list_filter({_LIGHT}, lambda x: x IS NOT NULL), ',') AS failures FROM instructions",
    "length_features": f"SELECT row_id, len({_TOKENS('input')}) AS len_input_tokens, len({_TOKENS('output')}) AS len_output_tokens, round(CASE WHEN len({_TOKENS('input')}) = 0 THEN 0 ELSE len({_TOKENS('output')})::DOUBLE / len({_TOKENS('input')}) END, 6) AS compression_ratio FROM instructions",
    "token_f1": f"SELECT row_id, round({_F1}, 6)::DOUBLE AS token_f1 FROM instructions",
    "answer_contained": f"SELECT row_id, {_CONTAINED} AS contained FROM instructions",
    "validate_records": f"SELECT row_id, len(rules) = 0 AS passed, array_to_string(rules, ',') AS failed_rules FROM ({_RULES})",
    "validate_report": f"SELECT task, count(*) AS total, count(*) FILTER (len(rules) = 0) AS passed, count(*) FILTER (len(rules) > 0) AS rejected, round(avg(CASE WHEN task = 'mrc' THEN {_F1} END), 6)::DOUBLE AS mean_token_f1 FROM ({_RULES}) GROUP BY 1",
    "validate_rule_counts": f"SELECT task, rule, count(*) AS n FROM (SELECT task, unnest(rules) AS rule FROM ({_RULES})) GROUP BY 1, 2",
    "ipc_accuracy_levels": rf"""
WITH p AS (SELECT nullif({_IPC('meta.primary_ipc')}, '') AS t, {_ANS_CODE} AS g FROM instructions WHERE lower(task) = 'ipc_reasoning'),
l AS (SELECT t, g, [t[1:1], CASE WHEN length(t) >= 3 THEN t[1:3] END, CASE WHEN length(t) >= 4 THEN t[1:4] END, CASE WHEN contains(t, '/') THEN split_part(t, '/', 1) END, t] AS a,
  [g[1:1], CASE WHEN length(g) >= 3 THEN g[1:3] END, CASE WHEN length(g) >= 4 THEN g[1:4] END, CASE WHEN contains(g, '/') THEN split_part(g, '/', 1) END, g] AS b FROM p WHERE t IS NOT NULL)
SELECT count(*) AS rows, round(avg(coalesce(regexp_full_match(g, '{_SYMBOL}'), false)::INT), 6) AS well_formed, round(avg(coalesce(a[1] = b[1], false)::INT), 6) AS section_accuracy, round(avg(coalesce(a[2] = b[2], false)::INT), 6) AS class_accuracy,
  round(avg(coalesce(a[3] = b[3], false)::INT), 6) AS subclass_accuracy, round(avg(coalesce(a[4] = b[4], false)::INT), 6) AS group_accuracy, round(avg(coalesce(a[5] = b[5], false)::INT), 6) AS full_accuracy FROM l""",
    "bigram_f1": f"""
WITH w AS (SELECT row_id, {_TOKENS('input')} AS a, {_TOKENS('output')} AS b FROM instructions),
g AS (SELECT row_id, CASE WHEN len(a) >= 2 AND len(b) >= 2 THEN list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) END AS a, CASE WHEN len(a) >= 2 AND len(b) >= 2 THEN list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1]) END AS b FROM w)
SELECT row_id, CASE WHEN a IS NULL THEN 0.0 ELSE round(2.0 * coalesce(list_sum(list_transform(list_intersect(list_distinct(a), list_distinct(b)), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) / (len(a) + len(b)), 6) END::DOUBLE AS bigram_f1 FROM g""",
    "application_split": """
SELECT row_id, CASE WHEN application_number IS NULL THEN NULL WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'test' END AS part
FROM (SELECT row_id, application_number, CAST('0x' || substr(md5('42:' || application_number), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM instructions)""",
    "verdict_kappa": f"""
WITH j AS (SELECT r.rule, v.pass FROM (SELECT row_id, len(rules) = 0 AS rule FROM ({_RULES})) r JOIN ({_VERDICTS}) v ON r.row_id = v.row_id WHERE v.pass IS NOT NULL),
t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE rule = pass) AS same, count(*) FILTER (WHERE rule) AS r, count(*) FILTER (WHERE pass) AS p FROM j)
SELECT n::BIGINT AS n, round(same / n, 6) AS agreement, round((same / n - (r * p + (n - r) * (n - p)) / (n * n)) / (1 - (r * p + (n - r) * (n - p)) / (n * n)), 6) AS kappa FROM t""",
    "judge_verdicts": f"SELECT row_id, score, pass, tags FROM ({_VERDICTS})",
    "judge_report": _REPORT,
    "judge_report_merged": _REPORT,
    "judge_tags": f"SELECT task, tag, count(*) AS n FROM (SELECT task, unnest(string_split(tags, ',')) AS tag FROM ({_VERDICTS})) GROUP BY 1, 2",
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "multi_hot": f"SELECT vec_id, array_to_string(list_transform(scores, lambda x: (x > 0.1)::INT), '') AS over, array_to_string(list_transform(scores, lambda x: (x > list_reverse_sort(scores)[4])::INT), '') AS top3 FROM ({_SCORES})",
    "prediction_lines": f"SELECT vec_id, array_to_string(labels, ',') AS labels, len(labels) AS n FROM ({_KEPT})",
    "kept_label_counts": f"SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM ({_KEPT})) GROUP BY 1",
    "label_accuracy": f"SELECT round(sum(list_sum(list_transform(scores, lambda x, i: ((x > 0.1) = (i - 1 = label))::INT)))::DOUBLE / sum(len(scores)), 6) AS accuracy FROM ({_SCORES})",
    "json_props": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props) AND json_type(props) = 'OBJECT'",
    "catalog_built": f"""
WITH best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ipc_code_raw ORDER BY list_position(['s','c','u','m','1','2','3','4','5','6','7','8','9'], kind) DESC, kind, trim(title), entry_type NULLS FIRST) AS o
  FROM ipc_catalog WHERE kind IN ('s','c','u','m','1','2','3','4','5','6','7','8','9') AND trim(title) <> '') WHERE o = 1),
extra AS (SELECT ipc_code_raw, string_agg(scheme_note, ' ' ORDER BY scheme_note, title NULLS FIRST) AS scheme_note, max(definition_statement) AS definition_statement FROM ipc_catalog GROUP BY 1)
SELECT b.ipc_code_raw, CASE WHEN length(b.ipc_code_raw) = 14 AND TRY_CAST(b.ipc_code_raw[5:8] AS INT) IS NOT NULL
  THEN concat(b.ipc_code_raw[1:4], CAST(CAST(b.ipc_code_raw[5:8] AS INT) AS VARCHAR), '/', CASE WHEN rtrim(b.ipc_code_raw[9:14], '0') = '' THEN '00' ELSE rtrim(b.ipc_code_raw[9:14], '0') END) ELSE b.ipc_code_raw END AS ipc_code,
  b.kind, trim(b.title) AS title, e.scheme_note, e.definition_statement, e.definition_statement IS NOT NULL AS has_definition_entry FROM best b JOIN extra e ON b.ipc_code_raw = e.ipc_code_raw""",
    "input_limit": "SELECT text_id, application_number FROM patent_text ORDER BY text_id LIMIT 1000",
    "success_limit": f"SELECT row_id, output FROM instructions WHERE row_id <= coalesce((SELECT row_id FROM instructions WHERE {_STRIP('output')} <> '' ORDER BY row_id LIMIT 1 OFFSET 99), 9223372036854775807)",
    "tasks_backfilled": "SELECT row_id, coalesce(nullif(task, ''), CASE WHEN ends_with(instruction, '?') THEN 'mrc' WHEN starts_with(input, 'Abstract:') THEN 'ipc_reasoning' ELSE 'abstract_drafting' END) AS task FROM instructions",
    "tasks_in_order": "SELECT (list_position(['ipc_reasoning', 'abstract_drafting', 'mrc'], lower(trim(task))) - 1)::INT AS task_order, task, count(*) AS n FROM instructions WHERE lower(trim(task)) IN ('ipc_reasoning', 'abstract_drafting', 'mrc') GROUP BY ALL",
    "coverage_counters": f"""
WITH t AS (SELECT {_STRIP('c.application_number')} <> '' AS a, q.d IS NOT NULL AS b, coalesce(len({_CLAIMS}), 0) AS n, {_STRIP('d.abstract')} <> '' AS e, coalesce(len(c.ipcr_classification), 0) > 0 AS f
  FROM patent_clean c LEFT JOIN ({_PRIMARY}) q ON c.rec_id = q.rec_id)
SELECT count(*) AS records, count(*) FILTER (a) AS with_application_number, count(*) FILTER (b) AS with_document, count(*) FILTER (n > 0) AS with_claims, count(*) FILTER (e) AS with_abstract, count(*) FILTER (f) AS with_codes,
  count(*) FILTER (NOT a) AS without_application_number, count(*) FILTER (NOT b) AS without_document, count(*) FILTER (n = 0) AS without_claims, count(*) FILTER (NOT e) AS without_abstract, count(*) FILTER (NOT f) AS without_codes, sum(n)::BIGINT AS claims FROM t""",
    "bert_limit_mark": f"""
WITH w AS (SELECT len({_TOKENS('claims_text')}) AS words FROM patent_text), p AS (SELECT words FROM w WHERE words > 0), k AS (SELECT quantile_cont(words, 0.99) AS cap FROM p)
SELECT words AS value, count(*) AS n, CASE WHEN first(cap) >= 512 THEN 512 END AS bert_limit FROM p, k WHERE words <= cap GROUP BY 1""",
    "judge_messages": """
SELECT row_id, 2::BIGINT AS messages, 'Judge the record.' AS system, application_number, CASE WHEN length(coalesce(input, '')) > 12000 THEN 12000 - 20 + 15 ELSE length(coalesce(input, '')) END AS chars FROM instructions""",
    "meta_blocks": f"SELECT row_id, meta.primary_ipc AS primary_ipc, len(rules) = 0 AS passed FROM ({_RULES})",
    "shards_written": """
WITH n AS (SELECT text_id, text_id % 2 AS odd, row_number() OVER (PARTITION BY text_id % 2 ORDER BY text_id) - 1 AS i FROM patent_text), e AS (SELECT max(i) // 1000 + 1 AS next FROM n WHERE odd = 0)
SELECT CASE WHEN odd = 0 THEN i // 1000 ELSE next + i // 1000 END AS shard, count(*) AS n, min(text_id) AS first, max(text_id) AS last FROM n, e GROUP BY 1""",
    "stream_ingest": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
}

_PICK = lambda a, b: f"CASE WHEN CAST('0x' || substr(md5(t.application_number), 1, 8) AS BIGINT) % 2 = 0 THEN '{a}' ELSE '{b}' END"
_MADE = lambda task, instruction, given, output, model, title, defined: f"""'{task}' AS task, t.application_number AS application_number, {instruction} AS instruction, {given} AS input, {output} AS output,
  nullif(t.primary_ipc, '') AS primary_ipc, nullif(t.document_type, '') AS document_type, '{model[0]}' AS model, '{model[1]}' AS provider, {title} AS ipc_title, {defined} AS has_definition_entry"""  # noqa: E731
_LOOKUP = f"""SELECT * FROM (SELECT * EXCLUDE (ipc_code), {_IPC('ipc_code')} AS code, row_number() OVER (PARTITION BY {_IPC('ipc_code')} ORDER BY ipc_code_raw DESC NULLS LAST, kind DESC NULLS LAST, title DESC) AS o FROM ipc_catalog WHERE {_IPC('ipc_code')} <> '' AND trim(title) <> '')
  WHERE o = 1 AND trim(definition_statement) <> ''"""
_ANSWER30 = "replace(replace(replace(left(t.claims_text, 30), chr(34), chr(39)), chr(10), ' '), chr(92), ' ')"
ORACLE |= {
    "abstract_drafting_records": f"SELECT {_MADE('abstract_drafting', _PICK('Draft an abstract.', 'Summarise the claims.'), 't.claims_text', 't.abstract', ('none', 'none'), 'NULL::VARCHAR', 'NULL::BOOLEAN')} FROM ({ORACLE['patent_texts']}) t",
    "ipc_reasoning_records": f"""SELECT {_MADE('ipc_reasoning', _PICK('Explain the class.', 'Justify the code.'), "concat('Abstract:', chr(10), t.abstract, chr(10), chr(10), 'Claims:', chr(10), t.claims_text)", "concat('Classification: ', l.code, chr(10), 'Justification: The claims fall under ', replace(left(concat_ws(' ', t.primary_ipc, l.title), 40), chr(34), chr(39)), '.')", ('stand-in', 'local'), 'l.title', 'l.has_definition_entry')}
FROM ({ORACLE['patent_texts']}) t JOIN ({_LOOKUP}) l ON {_IPC('t.primary_ipc')} = l.code""",
    "mrc_records": f"""SELECT {_MADE('mrc', "'What is claimed?'", 't.claims_text', _ANSWER30, ('stand-in', 'local'), 'NULL::VARCHAR', 'NULL::BOOLEAN')}
FROM ({ORACLE['patent_texts']}) t WHERE NOT regexp_matches({_ANSWER30}, '[\x00-\x1F]') AND trim({_ANSWER30}) <> ''""",
}

# JSON as text: members that are null are left out; texts beyond 12000 characters are cut.
_MEMBER = lambda k, v: f"CASE WHEN {v} IS NOT NULL THEN concat('\"{k}\":', to_json({v})) END"
_CUT = lambda c: f"CASE WHEN length(coalesce({c}, '')) > 12000 THEN concat(left({c}, 11980), chr(10), '…[truncated]…') ELSE coalesce({c}, '') END"
ORACLE["judge_payload"] = f"""
SELECT row_id, concat('{{', concat_ws(',', {_MEMBER('task', 'task')}, {_MEMBER('application_number', 'application_number')}, {', '.join(_MEMBER(k, '(' + _CUT(k) + ')') for k in ('instruction', 'input', 'output'))},
  concat('"meta":{{', concat_ws(',', {', '.join(_MEMBER(k, f'meta.{k}') for k in ('primary_ipc', 'ipc_title', 'has_definition_entry', 'document_type'))}), '}}')), '}}') AS payload FROM instructions"""

"""The same results as SQL for another engine, written independently of the Spark code.

Only the rendering of the documents and the wording of prompts are shared with it.
"""

from __future__ import annotations

from foliomill.doctypes import DEFAULT
from foliomill.operators import prompts
from foliomill.plans.catalog import LONG_OVERLAP, LONG_SIZE, NAMED, PARAGRAPH_SEARCH, SEARCHES
from foliomill.sources import business

SQL: dict[str, str] = {}
DOCS = f"docs AS (SELECT * FROM {business.as_sql()})"


def _clean(reply: str) -> str:
    inner = rf"regexp_replace({reply}, '```(?:json)?\s*\n?(.*?)\n?\s*```', '\1', 'gs')"
    return rf"regexp_replace({inner}, '^\s+|\s+$', '', 'g')"


def _inside(reply: str) -> str:
    fence = r"```(?:json)?\s*(.*?)```"
    picked = rf"CASE WHEN regexp_matches({reply}, '{fence}', 's') THEN regexp_extract({reply}, '{fence}', 1, 's') ELSE {reply} END"
    return rf"regexp_replace({picked}, '^\s+|\s+$', '', 'g')"


def _shown(x: str) -> str:
    return rf"regexp_replace(CAST(CAST({x} AS DECIMAL(18,4)) AS VARCHAR), '(\.\d+?)0+$', '\1')"


def _parsed(name: str, reply: str, extra: str = "", source: str = "docs", where: str = "true") -> str:
    """CTE with the cleaned reply ``t``, whether it is JSON, and the JSON ``j`` (null otherwise)."""
    return (
        f"{name} AS (SELECT *, json_valid(t) AS ok, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM "
        f"(SELECT job_id{extra}, {_clean(reply)} AS t FROM {source} WHERE {where}))"
    )


def _null(*paths: str) -> str:
    """A JSON null at one of the paths; a path through a list looks at all its elements."""
    at = [f"list_contains(json_type(j, '$.{p}'), 'NULL')" if "[*]" in p else f"json_type(j, '$.{p}') = 'NULL'" for p in paths]
    return "(ok AND (" + " OR ".join(f"coalesce({a}, false)" for a in at) + "))"


def _rule(source: str, rule: str, passed: str, good: str, bad: str) -> str:
    return f"SELECT job_id, '{rule}' AS rule, {passed} AS passed, {good} AS good, {bad} AS bad FROM {source}"


def _has(field: str) -> str:
    return f"(coalesce(j->>'$.{field}', '') <> '')"


def _len(field: str) -> str:
    return f"coalesce(json_array_length(j, '$.{field}'), 0)"


CONTRACT_NULLS = _null("parties", "clauses", "clauses[*].title", "terms", "terms.termination")
REPORT_NULLS = _null("kpis", "sections")
_BAD_NUMBERS = (
    "coalesce(len(list_filter(json_extract_string(j, '$.line_items[*].qty'), lambda x: x IS NOT NULL AND TRY_CAST(x AS DOUBLE) IS NULL)) > 0, false)"
)
_ITEM_FIELDS = [f"line_items[*].{f}" for f in ("description", "qty", "unit_price", "total")]
INVOICE_NULLS = f"({_null('line_items', *_ITEM_FIELDS, 'tax', 'grand_total')} OR {_BAD_NUMBERS})"


def _contract(name: str, c: str) -> str:
    signed = "coalesce(len(list_filter(json_extract_string(j, '$.clauses[*].title'), lambda x: contains(lower(x), 'sign'))) > 0, false)"
    ending = "lower(coalesce(j->>'$.terms.termination', ''))"
    odd = " OR ".join(f"contains({ending}, '{w}')" for w in ("perpetual", "irrevocable", "unlimited liability", "no termination"))
    rows = [
        _rule(c, "effective_date_present", _has("effective_date"), "'Effective date is present'", "'Missing effective date'"),
        _rule(c, "expiration_date_present", _has("expiration_date"), "'Expiration date is present'", "'Missing expiration date'"),
        _rule(c, "parties_identified", f"{_len('parties')} >= 2", f"'Found ' || {_len('parties')} || ' parties'", "'Fewer than 2 parties identified'"),
        _rule(c, "clauses_present", f"{_len('clauses')} > 0", f"'Found ' || {_len('clauses')} || ' clauses'", "'No clauses extracted'"),
        _rule(c, "signature_clause_present", signed, "'Signature clause found'", "'No signature/signing clause detected'"),
        _rule(c, "no_unusual_terms", f"NOT ({odd})", "'Termination terms appear standard'", "'Unusual termination terms detected'"),
    ]
    return f"{name} AS ({' UNION ALL '.join(rows)})"


def _invoice(name: str, c: str) -> str:
    """CTEs over line items: exact products, wrong lines, repeats, then the five rules."""
    num = "coalesce(CAST(TRY_CAST({} AS DOUBLE) AS DECIMAL(18,4)), 0)"
    q, u, t = (num.format(f"it->>'{f}'") for f in ("qty", "unit_price", "total"))
    tax, grand = (num.format(f"(j->>'{f}')") for f in ("tax", "grand_total"))
    message = (
        f"'Line ' || line || ': ' || {_shown('q')} || ' x ' || {_shown('u')} || ' = ' || {_shown('e')} "
        f"|| ', but listed as ' || {_shown('t')}"
    )
    expected, sub = "round(coalesce(s, 0) + tx, 2)", "coalesce(s, 0)"
    mismatch = (
        f"'Expected ' || {_shown(expected)} || ' (subtotal ' || {_shown(sub)} || ' + tax ' || {_shown('tx')} || '), got ' || {_shown('g')}"
    )
    rows = [
        _rule(f"{name}_all", "line_item_math", "wrong IS NULL", "'All line item calculations correct'", "wrong"),
        _rule(f"{name}_all", "no_duplicate_items", "dup IS NULL", "'No duplicate items'", "'Duplicate items: ' || dup"),
        _rule(f"{name}_all", "grand_total_correct", f"abs({expected} - g) < 0.01", "'Grand total matches computed total'", mismatch),
        _rule(f"{name}_all", "vendor_present", _has("vendor"), "'Vendor identified'", "'Missing vendor name'"),
        _rule(f"{name}_all", "invoice_number_present", _has("invoice_number"), "'Invoice number present'", "'Missing invoice number'"),
    ]
    return (
        f"{name}_items AS (SELECT job_id, unnest(json_extract(j, '$.line_items[*]')) AS it, "
        f"unnest(range(1, 1 + CAST(len(json_extract(j, '$.line_items[*]')) AS BIGINT))) AS line FROM {c}), "
        f"{name}_nums AS (SELECT job_id, line, q, u, t, round(q * u, 2) AS e, d, "
        f"row_number() OVER (PARTITION BY job_id, d ORDER BY line) AS nth FROM (SELECT job_id, line, {q} AS q, {u} AS u, {t} AS t, "
        f"lower(trim(coalesce(it->>'description', ''))) AS d FROM {name}_items)), "
        f"{name}_bad AS (SELECT job_id, line, {message} AS message FROM {name}_nums WHERE abs(e - t) > 0.01), "
        f"{name}_all AS (SELECT {c}.*, {tax} AS tx, {grand} AS g, s, wrong, dup FROM {c} "
        f"LEFT JOIN (SELECT job_id, sum(e) AS s FROM {name}_nums GROUP BY 1) USING (job_id) "
        f"LEFT JOIN (SELECT job_id, string_agg(message, '; ' ORDER BY line) AS wrong FROM {name}_bad GROUP BY 1) USING (job_id) "
        f"LEFT JOIN (SELECT job_id, string_agg(d, ', ' ORDER BY line) AS dup FROM {name}_nums WHERE nth > 1 AND d <> '' GROUP BY 1) USING (job_id)), "
        f"{name} AS ({' UNION ALL '.join(rows)})"
    )


def _report(name: str, c: str) -> str:
    v = "CAST(it->>'value' AS DOUBLE)"
    issue = (
        f"coalesce(it->>'name', 'unknown') || CASE WHEN {v} < 0 THEN ': negative value (' ELSE ': extremely large value (' END || (it->>'value') || ')'"
    )
    rows = [
        _rule(f"{name}_all", "kpis_present", f"{_len('kpis')} > 0", f"'Found ' || {_len('kpis')} || ' KPIs'", "'No KPIs extracted'"),
        _rule(f"{name}_all", "kpi_values_in_range", "issues IS NULL", "'All KPI values in expected range'", "issues"),
        _rule(f"{name}_all", "title_present", _has("title"), "'Report title present'", "'Missing report title'"),
        _rule(f"{name}_all", "period_present", _has("period"), "'Reporting period present'", "'Missing reporting period'"),
        _rule(f"{name}_all", "sections_present", f"{_len('sections')} > 0", f"'Found ' || {_len('sections')} || ' sections'", "'No sections extracted'"),
    ]
    return (
        f"{name}_kpis AS (SELECT job_id, unnest(json_extract(j, '$.kpis[*]')) AS it, "
        f"unnest(range(1, 1 + CAST(len(json_extract(j, '$.kpis[*]')) AS BIGINT))) AS pos FROM {c}), "
        f"{name}_odd AS (SELECT job_id, string_agg({issue}, '; ' ORDER BY pos) AS issues FROM "
        f"(SELECT * FROM {name}_kpis WHERE json_type(it, '$.value') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')) "
        f"WHERE {v} < 0 OR abs({v}) > 1e12 GROUP BY 1), "
        f"{name}_all AS (SELECT * FROM {c} LEFT JOIN {name}_odd USING (job_id)), "
        f"{name} AS ({' UNION ALL '.join(rows)})"
    )


_ROWS = "SELECT job_id, rule, passed, CASE WHEN passed THEN good ELSE bad END AS detail FROM {}"


def _rules_query(kind: str, build, nulls: str) -> str:
    parts = [
        DOCS,
        _parsed("c0", f"{kind}_reply"),
        f"c AS (SELECT * FROM c0 WHERE NOT coalesce({nulls}, false))",
        build("r", "c"),
    ]
    return f"WITH {', '.join(parts)} {_ROWS.format('r')}"


# --- sources, admission, state ----------------------------------------------------------

SQL["src_documents"] = "SELECT doc_id AS source_key, length(text) AS n_chars, md5(text) AS fingerprint FROM documents"
SQL["admit_jobs"] = """
SELECT source_key, reason IS NULL AS accepted, reason FROM (
  SELECT doc_id AS source_key,
    CASE WHEN doc_id % 50 = 7 THEN 'empty document_text' WHEN doc_id % 8 = 2 THEN 'unsupported document_type' END AS reason
  FROM documents)"""
SQL["init_jobs"] = """
SELECT doc_id AS source_key, CAST(doc_id AS VARCHAR) AS job_id, 'unknown' AS document_type, 0.0::DOUBLE AS classification_confidence,
  '' AS summary, 'pending' AS status, false AS requires_review, false AS approved, '' AS review_feedback,
  0.0::DOUBLE AS total_cost, 0::BIGINT AS error_count, '2024-01-01 00:00:00' AS created_at
FROM documents"""
_VERSIONS = """versions AS (SELECT user_id AS job_id, event_id AS version,
  '{"status":"' || event_type || '","step":' || event_id || '}' AS state FROM events)"""
_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY version DESC) AS rn
  FROM versions) WHERE rn = 1)"""
_SNAP = "left(md5(CAST({0} AS VARCHAR) || ':' || CAST({1} AS VARCHAR)), 12)"
SQL["state_latest"] = f"""WITH {_VERSIONS}, {_LATEST}
SELECT c_custkey AS job_id, version, state FROM customer LEFT JOIN latest ON c_custkey = job_id"""
SQL["state_bucketed"] = f"""WITH {_VERSIONS}, {_LATEST}, first AS (SELECT job_id, arg_min(state, version) AS state FROM versions GROUP BY 1)
SELECT c_custkey AS job_id, l.version AS version_before, l.state AS state_before, l.version + 1 AS version, f.state
FROM customer LEFT JOIN latest l ON c_custkey = l.job_id LEFT JOIN first f ON c_custkey = f.job_id"""
SQL["snapshot_jobs"] = f"""WITH {_VERSIONS}, {_LATEST}
SELECT c_custkey AS job_id, CASE WHEN version IS NOT NULL THEN left(md5(job_id || ':' || version || ':2024-02-01'), 12) END AS snapshot_id, version,
  CASE WHEN version IS NULL THEN 'No state found for job ' || c_custkey END AS error
FROM customer LEFT JOIN latest ON c_custkey = job_id"""
SQL["rollback_jobs"] = f"""WITH {_VERSIONS}, snaps AS (SELECT *, {_SNAP.format('job_id', 'version')} AS snapshot_id FROM versions)
SELECT r.job_id, r.snapshot_id, s.state, s.state IS NOT NULL AS restored
FROM (SELECT DISTINCT job_id + CASE WHEN version % 3 = 0 THEN 1 ELSE 0 END AS job_id, snapshot_id FROM snaps) r
LEFT JOIN snaps s ON r.job_id = s.job_id AND r.snapshot_id = s.snapshot_id"""
SQL["rollback_then_load"] = f"""WITH {_VERSIONS}, {_LATEST},
first AS (SELECT job_id, min_by(state, version) AS state, min(version) AS version FROM versions GROUP BY job_id)
SELECT c_custkey AS job_id, CASE WHEN f.job_id IS NULL THEN l.version ELSE l.version + 1099511627776 - f.version END AS version,
  CASE WHEN f.job_id IS NULL THEN l.state ELSE f.state END AS state
FROM customer LEFT JOIN latest l ON c_custkey = l.job_id LEFT JOIN first f ON c_custkey = f.job_id"""
SQL["list_snapshots"] = f"""
SELECT user_id AS job_id, {_SNAP.format('user_id', 'event_id')} AS snapshot_id, epoch_us(ts) AS created_at
FROM events ORDER BY 1, 3, 2"""
SQL["state_json_roundtrip"] = """
SELECT doc_id, md5(text) AS fingerprint, lang, round(doc_id / 1000, 6) AS confidence, source FROM documents"""

# --- projections and routing ------------------------------------------------------------

SQL["text_window"] = """SELECT doc_id, md5(left(text, 4000)) AS first_4000, md5(left(text, 6000)) AS first_6000,
  md5(left(text, 8000)) AS first_8000 FROM documents"""


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _by_kind(ask) -> str:
    whens = " ".join(f"WHEN '{t.name}' THEN {_lit(ask(t))}" for t in DEFAULT.types)
    return f"CASE kind {whens} ELSE {_lit(ask(None))} END"


def _prompt_sql() -> str:
    cols = []
    names = ", ".join(DEFAULT.names)
    classify = f'Which type is this document: {names}? Answer with JSON {{"type", "confidence"}} only.\n\n'
    issues = f" || {_lit(chr(10) * 2 + 'Validation issues:' + chr(10))} || '[]'"
    for p in ("N", "G"):
        e = _by_kind(lambda t, p=p: prompts._extract_ask(t, p, DEFAULT))
        a = _by_kind(lambda t, p=p: prompts._analyze_ask(t or DEFAULT.get("contract"), p, t.name if t else "unknown"))
        tail = (
            f"document_text || {_lit(chr(10) * 2 + 'Extracted data:' + chr(10))} || extract_json"
            f"{issues if p == 'N' else ''}"
        )
        cols += [
            f"md5({_lit(classify)} || document_text) AS classify_{p.lower()}",
            f"md5({e} || document_text) AS extract_{p.lower()}",
            f"md5({a} || {tail}) AS analyze_{p.lower()}",
        ]
    return f"WITH {DOCS} SELECT job_id, {', '.join(cols)} FROM docs"


SQL["prompt_columns"] = _prompt_sql()


def _keyword_sql() -> str:
    """The stand-in model: words counted per type, the first type of the most hits."""
    names = ", ".join(DEFAULT.names)
    prompt = _lit(f'Which type is this document: {names}? Answer with JSON {{"type", "confidence"}} only.\n\n') + " || document_text"
    words = {"c": "agreement|party|parties|clause|termination|hereby", "i": "invoice|total|due|vendor|tax", "r": "report|revenue|quarter|kpi|summary"}
    hits = ", ".join(rf"len(regexp_extract_all(p, '(?i)\b(?:{w})\b')) AS {k}" for k, w in words.items())
    return f"""WITH {DOCS}, h AS (SELECT job_id, {hits} FROM (SELECT job_id, {prompt} AS p FROM docs)),
b AS (SELECT job_id, c + i + r AS n, greatest(c, i, r) AS best, CASE WHEN c >= i AND c >= r THEN 'contract' WHEN i >= r THEN 'invoice' ELSE 'report' END AS kind FROM h)
SELECT job_id, CASE WHEN n = 0 THEN '{{"type": "unknown", "confidence": 0.0}}'
  ELSE '{{"type": "' || kind || '", "confidence": ' || CAST(round_even(best / n, 4) AS VARCHAR) || '}}' END AS reply, CAST(NULL AS VARCHAR) AS reply_error FROM b"""


SQL["batch_infer"] = SQL["batch_infer_once"] = _keyword_sql()

_FIELD_ROWS = ", ".join(
    f"('{kind}', '{f}')"
    for kind, fields in [(t.name, t.requested) for t in DEFAULT.types] + [("memo", DEFAULT.generic_fields)]
    for f in fields
)
_FIELDS = f"""{_parsed('f', 'fields_reply', ', kind')},
wanted(kind, field) AS (VALUES {_FIELD_ROWS}),
vals AS (SELECT job_id, kind, field, CASE WHEN json_type(json_extract(j, '$.' || field)) <> 'NULL'
  THEN CAST(json(json_extract(j, '$.' || field)) AS VARCHAR) END AS v FROM f JOIN wanted USING (kind) WHERE ok)"""
SQL["project_fields"] = f"""WITH {DOCS}, {_FIELDS}
SELECT job_id, field, TRY_CAST(v AS DOUBLE) AS as_number, CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN v END AS as_json FROM vals"""

_JOBS = """jobs AS (SELECT o_orderkey AS job_id,
  CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'review' WHEN 'P' THEN
    CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'extracting' WHEN 2 THEN 'failed' END END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'report' END AS document_type,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus = 'O' END AS requires_review,
  CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS error_count, o_orderdate FROM orders)"""
SQL["job_status"] = f"""WITH {_JOBS} SELECT job_id, coalesce(status, 'unknown') AS status,
  coalesce(document_type, 'unknown') AS document_type, coalesce(requires_review, false) AS requires_review,
  error_count::BIGINT AS error_count, epoch_us(o_orderdate) AS created_at,
  epoch_us(o_orderdate + CASE WHEN job_id % 3 <> 2 THEN INTERVAL 5 SECONDS ELSE INTERVAL 0 SECONDS END) AS updated_at FROM jobs"""
SQL["inflight_jobs"] = f"""WITH {_JOBS} SELECT count(*) FILTER (WHERE status IN
  ('pending', 'classifying', 'extracting', 'validating', 'analyzing')) AS pending_jobs FROM jobs"""
SQL["route_extraction"] = f"""WITH {DOCS} SELECT job_id, kind,
  CASE WHEN kind = 'invoice' THEN 'extract_invoice' WHEN kind = 'report' THEN 'extract_report' ELSE 'extract_contract' END AS route
FROM docs"""

SQL["extract_named_fields"] = f"""WITH {DOCS}, n AS (SELECT job_id, CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN t::JSON END AS j
  FROM (SELECT job_id, {_inside("x")} AS t FROM (SELECT job_id, CASE WHEN k % 4 = 0 THEN fields_reply ELSE 'Sure! ' || fields_reply || ' Done.' END AS x FROM docs))),
v AS (SELECT job_id, field, CASE WHEN json_type(json_extract(j, '$.' || field)) <> 'NULL' THEN CAST(json(json_extract(j, '$.' || field)) AS VARCHAR) END AS v
  FROM n, (SELECT unnest({list(NAMED)}) AS field))
SELECT job_id, field, TRY_CAST(v AS DOUBLE) AS as_number, CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN v END AS as_json FROM v"""
SQL["new_document_type"] = """WITH l AS (SELECT doc_id AS job_id, doc_id % 3 = 0 AS blank, doc_id % 5 <> 1 AS asked,
  least(3, len(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+ing'))) AS topics FROM documents)
SELECT job_id, 'letter' AS document_type, concat_ws(',', CASE WHEN blank THEN 'sender_present' END, CASE WHEN topics < 2 THEN 'topics_present' END) AS failed,
  CASE WHEN blank OR topics < 2 OR NOT asked THEN 'review_needed' ELSE 'output' END AS gate, CASE WHEN blank THEN '' ELSE 'S' || job_id END AS sender FROM l"""
SQL["user_tools"] = """SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[a-z0-9.]+@[a-z0-9.]+')) AS addresses,
  CAST(list_max(list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w))) AS BIGINT) AS longest_word FROM documents"""

# Whole run, profile N: classification, checks of each type, errors, gate.
_CONF = "TRY_CAST(j->>'$.confidence' AS DOUBLE)"
_CLASSIFIED = f"""{_parsed('p', 'classify_reply', ', requested_type, kind, extract_reply, analysis_reply, fields_reply, invoice_text, contract_text, report_text, document_text, analysis_g_reply')},
cls AS (SELECT *, CASE WHEN requested_type IS NOT NULL THEN NULL WHEN NOT ok THEN 'reply is not valid JSON'
    WHEN json_type(j, '$.confidence') = 'NULL' OR (j->>'$.confidence' IS NOT NULL AND {_CONF} IS NULL)
    THEN 'confidence is not a number' END AS cmsg FROM p),
typed AS (SELECT * EXCLUDE (t, ok, j),
  CASE WHEN requested_type IS NOT NULL THEN requested_type WHEN cmsg IS NULL AND j->>'$.type' IN ('contract', 'invoice', 'report')
    THEN j->>'$.type' ELSE 'unknown' END AS document_type,
  CASE WHEN requested_type IS NOT NULL THEN 1.0 WHEN cmsg IS NOT NULL OR j->>'$.type' NOT IN ('contract', 'invoice', 'report') THEN 0.0
    ELSE greatest(0.0, least(1.0, coalesce({_CONF}, 0.0))) END AS conf_n,
  CASE WHEN requested_type IS NOT NULL THEN 1.0 WHEN cmsg IS NOT NULL THEN 0.0 ELSE coalesce({_CONF}, 0.0) END AS conf_g
  FROM cls)"""
SQL["classify_docs"] = f"""WITH {DOCS}, {_CLASSIFIED}
SELECT job_id, document_type AS type_n, conf_n AS confidence_n, CASE WHEN cmsg IS NULL THEN 'classifying' ELSE 'failed' END AS status_n,
  document_type AS type_g, conf_g AS confidence_g, 'classifying' AS status_g FROM typed"""
_NULLS = f"""CASE document_type WHEN 'contract' THEN {CONTRACT_NULLS} WHEN 'invoice' THEN {INVOICE_NULLS}
  WHEN 'report' THEN {REPORT_NULLS} ELSE false END"""
_RUN = f"""{DOCS}, {_CLASSIFIED},
{_parsed('ex0', 'extract_reply', ', document_type, conf_n, cmsg, analysis_reply', 'typed')},
ex AS (SELECT *, coalesce({_NULLS}, false) AS broken FROM ex0),
c_contract AS (SELECT * FROM ex WHERE document_type = 'contract' AND NOT broken),
c_invoice AS (SELECT * FROM ex WHERE document_type = 'invoice' AND NOT broken),
c_report AS (SELECT * FROM ex WHERE document_type = 'report' AND NOT broken),
{_contract('r_contract', 'c_contract')}, {_invoice('r_invoice', 'c_invoice')}, {_report('r_report', 'c_report')},
r_unknown AS (SELECT job_id, 'document_type_supported' AS rule, false AS passed, '' AS good,
  'Unknown document type — no specific validations available' AS bad FROM ex WHERE document_type = 'unknown'),
rules(job_id, rule, passed, detail, ord) AS (
  SELECT job_id, rule, passed, CASE WHEN passed THEN good ELSE bad END,
    list_position(['effective_date_present', 'expiration_date_present', 'parties_identified', 'clauses_present',
      'signature_clause_present', 'no_unusual_terms', 'line_item_math', 'no_duplicate_items', 'grand_total_correct', 'vendor_present',
      'invoice_number_present', 'kpis_present', 'kpi_values_in_range', 'title_present', 'period_present', 'sections_present',
      'document_type_supported'], rule)
  FROM (SELECT * FROM r_contract UNION ALL SELECT * FROM r_invoice UNION ALL SELECT * FROM r_report UNION ALL SELECT * FROM r_unknown)),
per_job AS (SELECT job_id, count(*) AS n, avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) AS rate,
  string_agg(rule, ',' ORDER BY ord) FILTER (WHERE NOT passed) AS failed FROM rules GROUP BY 1),
final AS (SELECT ex.*, coalesce(n, 0) AS n_checks, coalesce(rate, 0.5) AS rate, coalesce(failed, '') AS failed,
    NOT json_valid({_clean('analysis_reply')}) AS abad, {_clean('analysis_reply')} AS atext
  FROM ex LEFT JOIN per_job USING (job_id)),
gated AS (SELECT *, CASE WHEN conf_n < 0.8 OR failed <> '' OR cmsg IS NOT NULL OR NOT ok OR broken OR abad
  THEN 'review_needed' ELSE 'output' END AS gate FROM final)"""
SQL["gate_rules"] = f"WITH {_RUN} SELECT job_id, document_type, conf_n AS classification_confidence, failed, gate FROM gated"
SQL["review_queue"] = f"""WITH {_RUN} SELECT job_id, document_type, 'review' AS status, true AS requires_review, false AS approved
FROM gated WHERE gate = 'review_needed'"""
SQL["final_output"] = f"""WITH {_RUN} SELECT job_id, document_type, 'complete' AS status, false AS requires_review, true AS approved,
  CAST(atext AS JSON)->>'$.summary' AS summary FROM gated WHERE gate = 'output'"""
SQL["stream_intake"] = f"""WITH {_RUN} SELECT job_id, document_type, gate,
  CASE WHEN gate = 'output' THEN 'complete' ELSE 'review' END AS status FROM gated"""
SQL["rules_unknown"] = f"WITH {_RUN} {_ROWS.format('r_unknown')}"
SQL["pass_rate"] = f"WITH {_RUN} SELECT job_id, n_checks, round(rate, 6) AS pass_rate FROM final"
SQL["overall_confidence"] = f"WITH {_RUN} SELECT job_id, round((conf_n + rate) / 2, 6) AS confidence FROM final"
SQL["rule_tally"] = f"""WITH {_RUN} SELECT document_type, rule, count(*) AS total, count(*) FILTER (WHERE passed) AS passed,
  count(*) FILTER (WHERE NOT passed) AS failed FROM rules JOIN ex USING (job_id) GROUP BY 1, 2"""
SQL["stage_errors"] = f"""WITH {_RUN}, lines AS (
  SELECT job_id, 1 AS o, 'classifier: ' || cmsg AS error FROM final WHERE cmsg IS NOT NULL
  UNION ALL SELECT job_id, 2, CASE document_type WHEN 'invoice' THEN 'extract_invoice' WHEN 'report' THEN 'extract_report'
    ELSE 'extract_contract' END || ': reply is not valid JSON' FROM final WHERE NOT ok
  UNION ALL SELECT job_id, 3, 'validator: a required value is null or not a number' FROM final WHERE broken
  UNION ALL SELECT job_id, 4, 'analyzer: reply is not valid JSON' FROM final WHERE abad)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY o) - 1 AS pos, error FROM lines"""

SQL["stage_trace"] = f"""WITH {_RUN}, n AS (SELECT count(*) AS rows, count(cmsg) AS c, count(*) FILTER (WHERE NOT ok) AS e,
  count(*) FILTER (WHERE broken) AS v, count(*) FILTER (WHERE abad) AS a FROM final)
SELECT unnest(['classify', 'extract', 'validate', 'analyze', 'settle']) AS node_name, rows AS rows_in, rows AS rows_out,
  unnest([c, e, v, a, 0]) AS failures FROM n"""

# Profile G: required fields, total validation, gate.
_TRUTHY = "coalesce(v NOT IN ('\"\"', '[]', '{}'), false)"
_REQUIRED = ", ".join(f"('{t.name}', '{f}')" for t in DEFAULT.types for f in t.required)
SQL["rules_required_fields"] = f"""WITH {DOCS}, {_FIELDS}, req(kind, field) AS (VALUES {_REQUIRED})
SELECT kind_rows.job_id, field, 'required_present' AS "check", {_TRUTHY} AS passed,
  CASE WHEN {_TRUTHY} THEN 'Present: ' ELSE 'Missing: ' END || field AS message
FROM (SELECT job_id, kind, field FROM f JOIN req USING (kind)) kind_rows LEFT JOIN vals USING (job_id, kind, field)"""


def _amounts(name: str, source: str, text: str, extra: str = "") -> str:
    """Positions and values of the distinct positive amounts of a text."""
    pats = [
        r"[$£€]\s*[0-9,]+\.?[0-9]*",
        r"(?i)\b(?:USD|EUR|GBP|CAD|AUD)\s*[0-9,]+\.?[0-9]*",
        r"(?i)[0-9,]+\.?[0-9]*\s*(?:USD|EUR|GBP|CAD|AUD)\b",
    ]
    found = " || ".join(f"regexp_extract_all({text}, '{p}')" for p in pats)
    return (
        f"{name}_raw AS (SELECT job_id{extra}, unnest(raw) AS r, unnest(range(len(raw))) AS o FROM "
        f"(SELECT job_id{extra}, {found} AS raw FROM {source})), "
        f"{name} AS (SELECT job_id{extra}, value, min(o) AS o FROM (SELECT *, "
        f"TRY_CAST(regexp_replace(r, '[^0-9.]', '', 'g') AS DOUBLE) AS value FROM {name}_raw) WHERE value > 0 GROUP BY ALL)"
    )


def _total_check(kind: str, text: str, source: str = "docs") -> str:
    return f"""{_parsed('tv', 'fields_reply', f', {kind} AS tk', source)}, {_amounts('am', source, text)},
tsum AS (SELECT job_id, sum(CAST(value AS DECIMAL(30,6))) AS s FROM am GROUP BY 1),
totals AS (SELECT job_id, abs(s - CAST(TRY_CAST(j->>'$.total' AS DOUBLE) AS DECIMAL(30,6))) <= 0.01 AS passed
  FROM tv JOIN tsum USING (job_id) WHERE ok AND tk = 'invoice' AND TRY_CAST(j->>'$.total' AS DOUBLE) IS NOT NULL)"""


SQL["rules_total_validation"] = f"""WITH {DOCS}, {_total_check("'invoice'", 'invoice_text')}
SELECT job_id, 'total' AS field, 'total_validation' AS "check", passed,
  CASE WHEN passed THEN 'Total validation passed' ELSE 'Total validation failed' END AS message FROM totals"""
SQL["gate_overall"] = f"""WITH {DOCS}, {_CLASSIFIED}, gd AS (SELECT * REPLACE (document_type AS kind) FROM typed),
{_FIELDS.replace('FROM docs', 'FROM gd')}, req(kind, field) AS (VALUES {_REQUIRED}),
{_total_check('document_type', 'document_text', 'gd')},
outcomes AS (SELECT job_id, {_TRUTHY} AS passed FROM (SELECT job_id, kind, field FROM f JOIN req USING (kind)) LEFT JOIN vals USING (job_id, kind, field)
  UNION ALL SELECT job_id, passed FROM totals),
rates AS (SELECT job_id, avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END) AS rate FROM outcomes GROUP BY 1),
g AS (SELECT job_id, document_type, (conf_g + coalesce(rate, 0.5)) / 2 AS confidence, cmsg,
  json_valid({_clean('fields_reply')}) AS fok, json_valid({_clean('analysis_g_reply')}) AS aok,
  CASE WHEN json_valid({_clean('analysis_g_reply')}) THEN json_array_length(({_clean('analysis_g_reply')})::JSON, '$.anomalies') ELSE 0 END AS anomaly_count
  FROM gd LEFT JOIN rates USING (job_id))
SELECT job_id, document_type, round(confidence, 6) AS confidence, anomaly_count::BIGINT AS anomaly_count,
  CASE WHEN confidence >= 0.7 AND anomaly_count = 0 THEN 'output' ELSE 'mark_review' END AS gate,
  CASE WHEN confidence >= 0.7 AND anomaly_count = 0 AND cmsg IS NULL AND fok AND aok THEN 'output' ELSE 'review_needed' END AS gate_with_errors
FROM g"""

# --- model replies ----------------------------------------------------------------------

SQL["parse_replies"] = f"""WITH {DOCS}, {_parsed('p', 'classify_reply')}
SELECT job_id, ok AS readable, j->>'$.type' AS type, TRY_CAST(j->>'$.confidence' AS DOUBLE) AS confidence FROM p"""


def _strings(path: str) -> str:
    """Strings of a JSON list joined by |, nulls left out; null when the list is missing."""
    return f"array_to_string(list_filter(json_extract_string(j, '{path}'), lambda x: x IS NOT NULL), '|')"


def _joined(field: str, path: str) -> str:
    return f"CASE WHEN json_type(j, '$.{field}') = 'ARRAY' THEN coalesce({_strings(path)}, '') END"


SQL["extract_contracts"] = f"""WITH {DOCS}, {_parsed('p', 'contract_reply')}
SELECT job_id, ok AS readable, j->>'$.effective_date' AS effective_date, j->>'$.expiration_date' AS expiration_date,
  {_len('parties')}::BIGINT AS n_parties, {_joined('parties', '$.parties[*]')} AS parties, {_len('clauses')}::BIGINT AS n_clauses,
  {_joined('clauses', '$.clauses[*].title')} AS titles, j->>'$.obligations[0].obligation' AS obligation,
  j->>'$.terms.duration' AS duration, j->>'$.terms.termination' AS termination FROM p"""
SQL["extract_invoices"] = f"""WITH {DOCS}, {_parsed('p', 'invoice_reply')}
SELECT job_id, ok AS readable, j->>'$.vendor' AS vendor, j->>'$.invoice_number' AS invoice_number,
  j->>'$.invoice_date' AS invoice_date, j->>'$.due_date' AS due_date, {_len('line_items')}::BIGINT AS n_items,
  {_joined('line_items', '$.line_items[*].description')} AS descriptions, {_joined('line_items', '$.line_items[*].qty')} AS qty,
  TRY_CAST(j->>'$.tax' AS DOUBLE) AS tax, TRY_CAST(j->>'$.grand_total' AS DOUBLE) AS grand_total FROM p"""
SQL["extract_reports"] = f"""WITH {DOCS}, {_parsed('p', 'report_reply')}
SELECT job_id, ok AS readable, j->>'$.title' AS title, j->>'$.period' AS period, {_len('kpis')}::BIGINT AS n_kpis,
  j->>'$.kpis[0].name' AS kpi, j->>'$.kpis[0].value' AS value, j->>'$.kpis[0].unit' AS unit, {_len('sections')}::BIGINT AS n_sections,
  j->>'$.sections[0].summary' AS first_summary FROM p"""
SQL["extract_table"] = f"""WITH {DOCS}, p AS (SELECT job_id, t, CASE WHEN json_valid(t) THEN t::JSON END AS j
  FROM (SELECT job_id, {_inside('table_reply')} AS t FROM docs)),
e AS (SELECT job_id, unnest(json_extract(j, '$[*]')) AS it, unnest(range(CAST(len(json_extract(j, '$[*]')) AS BIGINT))) AS row_no
  FROM p WHERE json_type(j) = 'ARRAY')
SELECT job_id, row_no, it->>'$.item' AS item, it->>'$.qty' AS qty FROM e WHERE json_type(it) = 'OBJECT'"""


def _severity(level: str) -> str:
    return f"coalesce(len(list_filter(json_extract_string(j, '$.risks[*].severity'), lambda x: lower(x) = '{level}')), 0)::BIGINT AS {level}_risks"


SQL["analysis_counts"] = f"""WITH {DOCS}, {_parsed('p', 'analysis_reply')}
SELECT job_id, {_len('risks')}::BIGINT AS risk_count, {_len('anomalies')}::BIGINT AS anomaly_count, {_len('insights')}::BIGINT AS insight_count,
  {_severity('high')}, {_severity('medium')}, {_severity('low')}, coalesce(j->>'$.summary', '') AS summary,
  CASE WHEN ok THEN 'analyzing' ELSE 'failed' END AS status FROM p"""

# --- text and retrieval -----------------------------------------------------------------

_MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_DATES = " || ".join(
    f"regexp_extract_all(document_text, '{p}')"
    for p in (
        r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
        r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b",
        r"\b[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}\b",
        rf"(?i)\b[0-9]{{1,2}}\s+{_MONTHS}\s+[0-9]{{4}}\b",
        rf"(?i)\b{_MONTHS}\s+[0-9]{{1,2}},?\s+[0-9]{{4}}\b",
    )
)
SQL["extract_dates"] = f"""WITH {DOCS}, hits AS (SELECT job_id, unnest(d) AS value, unnest(range(len(d))) AS o
  FROM (SELECT job_id, {_DATES} AS d FROM docs))
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY min(o)) - 1 AS pos, value FROM hits GROUP BY job_id, value"""
SQL["extract_amounts"] = f"""WITH {DOCS}, {_amounts('am', 'docs', 'document_text')}
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY o) - 1 AS pos, value FROM am"""
_PARAS = r"""paras AS (SELECT job_id, o, p FROM (SELECT job_id, unnest(range(len(ps))) AS o,
  regexp_replace(unnest(ps), '^\s+|\s+$', '', 'g') AS p FROM (SELECT job_id,
  regexp_split_to_array(regexp_replace(document_text, '^\s+|\s+$', '', 'g'), '\n\s*\n') AS ps FROM docs)) WHERE p <> '')"""
SQL["paragraphs"] = f"""WITH {DOCS}, {_PARAS}
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY o) - 1 AS pos, p AS paragraph FROM paras"""
SQL["token_counts"] = """SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)"""

_QUERY_ROWS = ", ".join(f"('{name}', {_lit(q)})" for name, q in SEARCHES.items())
def _bm25(queries: str) -> str:
    """BM25 of all documents for queries(query, q); a score adds its parts in the order of the query's words."""
    return f"""{queries},
asked AS (SELECT query, unnest(t) AS term, unnest(range(len(t))) AS place FROM (SELECT query, regexp_extract_all(lower(q), '[a-z0-9]+') AS t FROM queries)),
toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
lens AS (SELECT doc_id, len(t) AS dl FROM toks),
stats AS (SELECT count(*) AS n_docs, avg(dl) AS avg_length FROM lens),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks)
  WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
df AS (SELECT term, count(tf.doc_id) AS df FROM (SELECT DISTINCT term FROM asked) LEFT JOIN tf USING (term) GROUP BY 1),
scores AS (SELECT query, doc_id, list_reduce(list(ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.5)
    / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_length)) ORDER BY place), lambda a, b: a + b) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (doc_id) CROSS JOIN stats GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM scores)"""


_BM25 = _bm25(f"queries(query, q) AS (VALUES {_QUERY_ROWS})")
SQL["extract_long_contracts"] = f"""WITH t AS (SELECT doc_id, 'Between P' || doc_id % 7 || ' and P' || doc_id % 5 || ', lasts ' || doc_id % 30 || ' months. '
    || coalesce(text, '') || ' Effective 2024-01-1' || doc_id % 9 || '. Signature of P' || doc_id % 7 AS d FROM documents),
c AS (SELECT doc_id, no, substring(d, no * {LONG_SIZE - LONG_OVERLAP} + 1, {LONG_SIZE}) AS x FROM (SELECT doc_id, d,
  unnest(range(greatest(1, CAST(ceil((length(d) - {LONG_OVERLAP}) / {LONG_SIZE - LONG_OVERLAP}) AS BIGINT)))) AS no FROM t)),
r AS (SELECT *, length(x) % 9 = 4 AND NOT contains(x, 'Signature') AS broken FROM c),
p AS (SELECT doc_id, no, unnest(v) AS v, unnest(range(len(v))) AS i FROM (SELECT doc_id, no, regexp_extract_all(x, 'P[0-9]') AS v FROM r WHERE NOT broken)),
ps AS (SELECT doc_id, string_agg(v, '|' ORDER BY o) AS parties FROM (SELECT doc_id, v, min(struct_pack(no := no, i := i)) AS o FROM p GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT doc_id, no, unnest(v) AS v, unnest(range(len(v))) AS i FROM (SELECT doc_id, no, regexp_extract_all(x, 'Signature of (P[0-9])', 1) AS v FROM r WHERE NOT broken)),
ss AS (SELECT doc_id, string_agg('Signature ' || v, '|' ORDER BY o) AS clauses FROM (SELECT doc_id, v, min(struct_pack(no := no, i := i)) AS o FROM s GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE broken) AS n_unreadable,
  arg_min(e, no) FILTER (WHERE NOT broken AND e <> '') AS effective_date, arg_min(m, no) FILTER (WHERE NOT broken AND m <> '') AS duration
  FROM (SELECT *, regexp_extract(x, 'Effective ([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS e, regexp_extract(x, 'lasts ([0-9]+ months)', 1) AS m FROM r) GROUP BY 1)
SELECT doc_id, n_chunks, n_unreadable, coalesce(parties, '') AS parties, coalesce(clauses, '') AS clauses, effective_date, duration
FROM f LEFT JOIN ps USING (doc_id) LEFT JOIN ss USING (doc_id)"""
SQL["bm25_stats"] = f"WITH {_BM25} SELECT n_docs, round(avg_length, 6) AS avg_length FROM stats"
SQL["bm25_df"] = f"WITH {_BM25} SELECT term, df FROM df"
SQL["bm25_scores"] = f"WITH {_BM25} SELECT query, doc_id, round(score, 6) AS score FROM scores"
SQL["bm25_topk"] = f"WITH {_BM25} SELECT query, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 8"
SQL["bm25_fallback"] = f"""WITH {_BM25},
first AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE text <> '' ORDER BY doc_id LIMIT 5)
SELECT query, rank, doc_id, round(score, 6) AS score, false AS fallback FROM ranked WHERE rank <= 5
UNION ALL SELECT query, rank, doc_id, 0.0, true FROM queries, first WHERE q <> '' AND query NOT IN (SELECT query FROM ranked)"""


_BENCHMARK = _bm25("queries AS (SELECT item_id AS query, text AS q FROM benchmark)")
SQL["bm25_benchmark"] = f"""WITH {_BENCHMARK},
first AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE text <> '' ORDER BY doc_id LIMIT 10)
SELECT query AS item_id, rank, doc_id, round(score, 6) AS score, false AS fallback FROM ranked WHERE rank <= 10
UNION ALL SELECT query, rank, doc_id, 0.0, true FROM queries, first WHERE q <> '' AND query NOT IN (SELECT query FROM ranked)"""
SQL["bm25_benchmark_df"] = f"WITH {_BENCHMARK} SELECT term, df FROM df"


def _inside_documents(key: str, paras: str, asked: str, k: int) -> str:
    """BM25 over the paragraphs of each document; paras(key, pos, p), asked(key, term)."""
    return f"""{paras}, {asked},
toks AS (SELECT {key}, pos, regexp_extract_all(lower(p), '[a-z0-9]+') AS t FROM paras),
lens AS (SELECT {key}, pos, len(t) AS dl FROM toks),
stats AS (SELECT {key}, count(*) AS n, avg(dl) AS avg_dl FROM lens GROUP BY 1),
tf AS (SELECT {key}, pos, term, count(*) AS tf FROM (SELECT {key}, pos, unnest(t) AS term FROM toks) GROUP BY 1, 2, 3),
hit AS (SELECT tf.* FROM tf SEMI JOIN asked USING ({key}, term)),
df AS (SELECT {key}, term, count(*) AS df FROM hit GROUP BY 1, 2),
scores AS (SELECT {key}, pos, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))) AS score
  FROM asked JOIN hit USING ({key}, term) JOIN df USING ({key}, term) JOIN lens USING ({key}, pos) JOIN stats USING ({key}) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(score, 9) DESC, pos) AS rank, false AS fallback FROM scores
  UNION ALL SELECT {key}, pos, 0.0, pos AS rank, true FROM paras WHERE {key} NOT IN (SELECT {key} FROM scores)),
shown AS (SELECT * FROM ranked JOIN paras USING ({key}, pos) WHERE rank <= {k})"""


_LINE_PARAS = r"""paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS pos, p FROM (
  SELECT doc_id, unnest(range(len(ps))) AS o, regexp_replace(unnest(ps), '^\s+|\s+$', '', 'g') AS p FROM (
  SELECT doc_id, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS ps FROM documents)) WHERE p <> '')"""
_ASKED = f"asked AS (SELECT doc_id, unnest(regexp_extract_all('{PARAGRAPH_SEARCH}', '[a-z0-9]+')) AS term FROM documents)"
SQL["bm25_in_document"] = f"""WITH {_inside_documents('doc_id', _LINE_PARAS, _ASKED, 5)}
SELECT doc_id, rank, pos, round(score, 6) AS score, md5(p) AS paragraph, fallback FROM shown"""
_JOB_PARAS = _PARAS.replace("paras AS (SELECT job_id, o, p FROM", "paras AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY o) AS pos, p FROM")
_JOB_ASKED = """asked AS (SELECT job_id, unnest(regexp_extract_all(
  CASE k % 4 WHEN 0 THEN 'grand total' WHEN 1 THEN 'buyer fee fee' WHEN 2 THEN '...' ELSE kind END, '[a-z0-9]+')) AS term FROM docs)"""
SQL["bm25_in_business_document"] = f"""WITH {DOCS}, {_inside_documents('job_id', _JOB_PARAS, _JOB_ASKED, 2)}
SELECT job_id, rank, pos, round(score, 6) AS score, p AS paragraph, fallback FROM shown"""

# --- rules ------------------------------------------------------------------------------

SQL["rules_contract"] = _rules_query("contract", _contract, CONTRACT_NULLS)
SQL["rules_invoice"] = _rules_query("invoice", _invoice, INVOICE_NULLS)
SQL["rules_report"] = _rules_query("report", _report, REPORT_NULLS)
SQL["line_item_math_detail"] = SQL["rules_invoice"].rsplit("SELECT job_id, rule, passed", 1)[0] + "SELECT job_id, line, message FROM r_bad"
SQL["pass_rate_from_table"] = (
    SQL["rules_invoice"].rsplit("SELECT job_id, rule, passed", 1)[0]
    + "SELECT docs.job_id, round(coalesce(avg(CASE WHEN passed THEN 1.0 WHEN NOT passed THEN 0.0 END), 0.5), 6) AS pass_rate "
    "FROM docs LEFT JOIN r ON docs.job_id = r.job_id GROUP BY 1"
)

_LINES = """lines AS (SELECT l_orderkey AS job_id, l_linenumber::BIGINT AS line, p_name AS description, l_partkey, l_suppkey, l_shipdate,
  l_extendedprice, CAST(l_quantity AS DECIMAL(18,4)) AS q, CAST(p_retailprice AS DECIMAL(18,4)) AS u,
  round(CAST(l_quantity AS DECIMAL(18,4)) * CAST(p_retailprice AS DECIMAL(18,4)), 2) AS e,
  CASE WHEN l_linenumber = 1 AND l_orderkey % 7 = 0 THEN 1.00 WHEN l_linenumber = 2 AND l_orderkey % 13 = 0 THEN 0.01 ELSE 0.00 END AS extra
  FROM lineitem JOIN part ON l_partkey = p_partkey),
nth AS (SELECT *, row_number() OVER (PARTITION BY job_id, lower(trim(description))
  ORDER BY line, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS n FROM lines),
heads AS (SELECT o_orderkey AS job_id, coalesce(s, 0) AS s, o_orderkey % 100 AS tax,
  CASE WHEN o_orderkey % 17 = 0 THEN 0.01 WHEN o_orderkey % 19 = 0 THEN 5.00 ELSE 0.00 END AS wrong
  FROM orders LEFT JOIN (SELECT job_id, sum(e) AS s FROM lines GROUP BY 1) ON o_orderkey = job_id)"""
SQL["rules_invoice_lines"] = f"""WITH {_LINES},
per AS (SELECT job_id, count(*) AS lines, count(*) FILTER (WHERE extra > 0.01) AS wrong_lines,
  count(*) FILTER (WHERE n > 1) AS repeated_lines FROM nth GROUP BY 1)
SELECT job_id, coalesce(lines, 0) AS lines, coalesce(wrong_lines, 0)::BIGINT AS wrong_lines, coalesce(repeated_lines, 0)::BIGINT AS repeated_lines,
  coalesce(wrong_lines, 0) = 0 AS line_item_math, coalesce(repeated_lines, 0) = 0 AS no_duplicate_items, wrong < 0.01 AS grand_total_correct
FROM heads LEFT JOIN per USING (job_id)"""
SQL["line_table_math_errors"] = f"""WITH {_LINES} SELECT job_id, line, 'Line ' || line || ': ' || {_shown('q')} || ' x ' || {_shown('u')}
  || ' = ' || {_shown('e')} || ', but listed as ' || {_shown('e + extra')} AS message FROM lines WHERE extra > 0.01"""
SQL["duplicate_items"] = f"WITH {_LINES} SELECT job_id, line, l_partkey, l_suppkey, description FROM nth WHERE n > 1"
SQL["repeated_descriptions"] = f"""WITH {_LINES} SELECT job_id, lower(trim(description)) AS description, count(*) - 1 AS repeats
FROM lines GROUP BY 1, 2 HAVING count(*) > 1"""
SQL["reconcile_totals"] = f"""WITH {_LINES} SELECT job_id, CAST(s AS DOUBLE) AS actual, CAST(s + wrong AS DOUBLE) AS expected, wrong <= 0.01 AS matches
FROM heads"""
SQL["sum_exact"] = """SELECT l_partkey, CASE l_partkey % 50 WHEN 1 THEN 'infinite' WHEN 2 THEN 'no number'
  WHEN 3 THEN CASE WHEN bool_and(l_linenumber = 1) OR bool_and(l_linenumber <> 1) THEN 'infinite' ELSE 'no number' END
  ELSE CAST(sum(CAST(l_extendedprice AS DECIMAL(30,2))) AS VARCHAR) END AS total,
  5 * count(*) + count(*) FILTER (WHERE l_partkey % 50 IN (1, 2, 3)) AS n_values FROM lineitem GROUP BY 1"""
SQL["sum_values"] = """SELECT p_partkey, round(coalesce(fsum(l_extendedprice), 0), 6) AS total,
  count(l_extendedprice) AS n_values FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1"""

# --- trace and numbers ------------------------------------------------------------------

_TRACE = """trace AS (SELECT event_id, user_id AS job_id, CASE WHEN event_id % 11 <> 4 THEN event_type END AS node_name, ts,
  CASE WHEN event_id % 10 <> 3 THEN value END AS duration_ms, CASE WHEN event_id % 7 <> 2 THEN value / 1000 END AS cost,
  CASE WHEN event_type = 'error' THEN 'failed ' || event_id END AS error,
  epoch_us(ts) + CAST(CAST(value AS DECIMAL(18,6)) * 1000 AS BIGINT) AS done,
  CASE event_id % 5 WHEN 0 THEN 'document_text' WHEN 1 THEN 'extracted_data,document_type' ELSE '' END AS input_keys,
  CASE event_id % 3 WHEN 0 THEN event_type || ',status' ELSE '' END AS output_keys FROM events)"""
_TOTALS = """count(*) AS steps, count(error) AS failed_steps, round(coalesce(fsum(cost), 0), 6) AS total_cost,
  round(coalesce(fsum(duration_ms), 0), 6) AS total_duration_ms"""
SQL["job_trace"] = f"""WITH {_TRACE} SELECT job_id, coalesce(node_name, 'unknown') AS node_name, epoch_us(ts) AS started_at,
  done AS completed_at, input_keys, output_keys, coalesce(duration_ms, 0) AS duration_ms, round(coalesce(cost, 0), 6) AS cost, coalesce(error, '') AS error FROM trace"""
SQL["trace_totals"] = f"WITH {_TRACE} SELECT job_id, {_TOTALS} FROM trace GROUP BY 1"
SQL["trace_by_node"] = f"WITH {_TRACE} SELECT job_id, coalesce(node_name, 'unknown') AS node_name, {_TOTALS} FROM trace GROUP BY 1, 2"
SQL["step_duration"] = "SELECT event_id, round(value, 6) AS duration_ms FROM events"
SQL["pct_change"] = """WITH e AS (SELECT event_id, user_id, floor(value / 25) AS new_value, lag(floor(value / 25))
  OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_value FROM events)
SELECT event_id, user_id, old_value, new_value, CASE WHEN old_value <> 0 THEN round((new_value - old_value) / abs(old_value) * 100, 6) END AS pct_change,
  coalesce(old_value = 0, false) AS change_error FROM e"""
SQL["derived_metric"] = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  CASE WHEN l_quantity <> 10 THEN l_extendedprice * (1 - l_discount) / (l_quantity - 10) + sqrt(l_tax * 100) END AS metric,
  l_quantity = 10 AS metric_error FROM lineitem"""
SQL["scalar_functions"] = """WITH x AS (SELECT p_partkey, p_retailprice AS r, p_size - 25 AS a, p_partkey % 7 - 3 AS b FROM part)
SELECT p_partkey, CASE WHEN b <> 0 THEN CAST(CAST(floor(a / b) AS BIGINT) AS DOUBLE) END AS floor_div, CASE WHEN b <> 0 THEN CAST(a - b * CAST(floor(a / b) AS BIGINT) AS DOUBLE) END AS modulo,
  round(pow(1.01, a * 30), 6) AS power, greatest(0.0, least(1.0, a / 20.0)) AS clamped, round(log10(r), 6) AS log10,
  round(ln(r) + sin(a) + cos(a) + tan(a) + sqrt(abs(a)) + pi() + exp(1), 6) AS mixed, CAST(ceil(r / 7) - floor(r / 7) AS BIGINT) AS gap FROM x"""

# --- review -----------------------------------------------------------------------------

_ACTIONS = """acts AS (SELECT CAST(user_id AS VARCHAR) AS job_id, ts, event_id AS seq, action, feedback,
    action <> 'reject' OR feedback <> '' AS valid FROM (SELECT *,
    CASE event_type WHEN 'signup' THEN 'submit' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' END AS action,
    CASE WHEN CAST(props->>'$.k' AS BIGINT) % 9 <> 0 THEN 'note ' || (props->>'$.k') ELSE '' END AS feedback FROM events)
  WHERE action IS NOT NULL)"""
SQL["decision_guard"] = f"""WITH {_ACTIONS}, jobs AS (SELECT CAST(s_suppkey AS VARCHAR) AS job_id,
  s_suppkey % 4 = 0 OR s_suppkey % 8 = 2 AS waiting FROM supplier)
SELECT seq, acts.job_id, action, CASE WHEN NOT valid THEN 'invalid' WHEN waiting IS NULL THEN 'not_found' WHEN waiting THEN 'ok'
  ELSE 'conflict' END AS verdict FROM acts LEFT JOIN jobs USING (job_id) WHERE action <> 'submit'"""
_LIFE = f"""{_ACTIONS},
epochs AS (SELECT *, count(*) FILTER (WHERE action = 'submit') OVER (PARTITION BY job_id ORDER BY ts, seq) AS epoch FROM acts WHERE valid),
placed AS (SELECT *, count(*) FILTER (WHERE action <> 'submit') OVER (PARTITION BY job_id, epoch ORDER BY ts, seq) AS nth FROM epochs),
life AS (SELECT job_id, ts, seq, action, feedback, CASE WHEN action = 'submit' THEN 'submitted' WHEN epoch = 0 THEN 'not_found'
  WHEN nth > 1 THEN 'conflict' WHEN action = 'approve' THEN 'approved' ELSE 'rejected' END AS outcome FROM placed
  UNION ALL SELECT job_id, ts, seq, action, feedback, 'invalid' FROM acts WHERE NOT valid)"""
SQL["review_outcome"] = f"WITH {_LIFE} SELECT job_id, seq, action, outcome FROM life"
SQL["review_status"] = f"""WITH {_LIFE}, eff AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS back,
  count(*) FILTER (WHERE action = 'submit') OVER (PARTITION BY job_id) AS submits,
  count(*) FILTER (WHERE action <> 'submit') OVER (PARTITION BY job_id) AS effective_decisions
  FROM life WHERE outcome IN ('submitted', 'approved', 'rejected'))
SELECT job_id, CASE outcome WHEN 'submitted' THEN 'review' WHEN 'approved' THEN 'complete' ELSE 'failed' END AS status,
  outcome = 'submitted' AS requires_review, outcome = 'approved' AS approved, CASE WHEN action = 'submit' THEN '' ELSE feedback END AS review_feedback,
  submits, effective_decisions FROM eff WHERE back = 1"""
SQL["stream_review"] = SQL["review_status"]

"""Business documents derived row by row from the orders table.

The given texts hold no dates, amounts, invoices or contracts, so each order is rendered as an
invoice, a contract and a report: a text and the replies a model would give for it, with gaps and
mistakes at known places.  Every column is an SQL expression over its own row, so the rendering
is distributed like the orders are and never groups anything.  The expressions use only SQL that
other engines share, so a check can render the same documents there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.sources.documents import spread_rows

JIT_LIMIT = 8000
NL = "chr(10)"
FENCE = "'```'"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _cents(x: str) -> str:
    """Amount in cents as text with two decimals."""
    return _s(f"CAST(({x}) AS DECIMAL(16, 0)) * CAST(0.01 AS DECIMAL(3, 2))")


def _pick(index: str, *choices: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices[:-1]))
    return f"(CASE {index} {whens} ELSE {choices[-1]} END)"


def _quoted(text: str) -> str:
    return f"('\"' || {text} || '\"')"


MONTHS = "January  February March    April    May      June     July     August   SeptemberOctober  November December "
_D2, _M2 = f"lpad({_s('d')}, 2, '0')", f"lpad({_s('m')}, 2, '0')"
_MONTH = f"rtrim(substring('{MONTHS}', CAST(m AS INT) * 9 - 8, 9))"

ORDER = {
    "k": "o_orderkey",
    "h": "CAST(floor(o_orderkey / 10) AS BIGINT)",
    "c": "CAST(round(o_totalprice * 100) AS BIGINT)",
    "p": "o_custkey",
    "y": "year(o_orderdate)",
    "m": "month(o_orderdate)",
    "d": "day(o_orderdate)",
}

LINES = (1, 2, 3, 4)
NUMBERS = {
    "n": "1 + h % 4",
    "iso": f"{_s('y')} || '-' || {_M2} || '-' || {_D2}",
    "written": _pick(
        "k % 5",
        f"{_s('y')} || '-' || {_M2} || '-' || {_D2}",
        f"{_M2} || '/' || {_D2} || '/' || {_s('y')}",
        f"{_D2} || '-' || {_M2} || '-' || {_s('y')}",
        f"{_s('d')} || ' ' || {_MONTH} || ' ' || {_s('y')}",
        f"{_MONTH} || ' ' || {_s('d')} || ', ' || {_s('y')}",
    ),
    **{f"q{i}": f"1 + (k + {3 * i}) % 9" for i in LINES},
    **{f"u{i}": f"100 + (c + {7919 * i} * (k % 97)) % 50000" for i in LINES},
    **{
        f"n{i}": _pick(
            f"(k * {i} + {i * i}) % 6",
            "'Cloud Hosting'", "'Support Plan'", "' support plan '", "'API License'", "'Data Backup'", "''",
        )
        for i in LINES
    },
}

SUMS = {
    # Line 1 is wrong by 1.50 in every seventh invoice; line 2 by exactly one cent in every 13th.
    **{
        f"t{i}": f"q{i} * u{i}"
        + (" + (CASE WHEN k % 7 = 0 THEN 150 ELSE 0 END)" if i == 1 else "")
        + (" + (CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END)" if i == 2 else "")
        for i in LINES
    },
    "sub": " + ".join(f"(CASE WHEN n >= {i} THEN q{i} * u{i} ELSE 0 END)" for i in LINES),
}
TOTALS = {
    "tax": "CAST(floor(sub * 8 / 100) AS BIGINT)",
    "grand": (
        "sub + CAST(floor(sub * 8 / 100) AS BIGINT) + (CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END)"
        " + (CASE WHEN k % 19 = 0 THEN 500 ELSE 0 END)"
    ),
}


def _shown(cents: str) -> str:
    """Amount in one of the three notations."""
    return _pick("h % 3", f"'$' || {_cents(cents)}", f"'USD ' || {_cents(cents)}", f"{_cents(cents)} || ' EUR'")


def _reply(json: str) -> str:
    """A reply around the JSON: fenced or plain, sometimes with chatter or cut off."""
    return (
        f"(CASE WHEN k % 29 = 0 THEN 'Here it is: ' || {FENCE} || {NL} || {json} || {NL} || {FENCE} "
        f"WHEN k % 31 = 0 THEN left({json}, 40) "
        f"WHEN h % 3 = 0 THEN {FENCE} || 'json' || {NL} || {json} || {NL} || {FENCE} "
        f"WHEN h % 3 = 1 THEN {FENCE} || {NL} || {json} || {NL} || {FENCE} "
        f"ELSE ' ' || {json} || {NL} END)"
    )


def _given(case: str, text: str) -> str:
    """JSON string that is null or empty at some places."""
    return f"(CASE {case} WHEN 0 THEN 'null' WHEN 1 THEN '\"\"' ELSE {_quoted(text)} END)"


def _item(i: int) -> str:
    qty = f"CAST(q{i} AS STRING)"
    if i == 1:
        qty = (
            f"(CASE WHEN k % 41 = 0 THEN 'null' WHEN k % 43 = 0 THEN '\"many\"' "
            f"WHEN k % 5 = 0 THEN {_quoted(qty)} ELSE {qty} END)"
        )
    return (
        f"'{{\"description\": \"' || n{i} || '\", \"qty\": ' || {qty} || ', \"unit_price\": ' || {_cents(f'u{i}')}"
        f" || ', \"total\": ' || {_cents(f't{i}')} || '}}'"
    )


INVOICE_JSON = (
    f"'{{\"vendor\": ' || {_given('h % 11', _s('p'))} || ', \"invoice_number\": ' || {_given('h % 12', _s('k'))}"
    f" || ', \"invoice_date\": \"' || iso || '\", \"line_items\": [' || {_item(1)}"
    + "".join(f" || (CASE WHEN n >= {i} THEN ', ' || {_item(i)} ELSE '' END)" for i in (2, 3, 4))
    + f" || ']' || (CASE WHEN h % 23 = 0 THEN '' ELSE ', \"tax\": ' || {_cents('tax')} END)"
    f" || ', \"grand_total\": ' || {_cents('grand')} || '}}'"
)
INVOICE_TEXT = (
    f"'INVOICE' || {NL} || {NL} || 'Vendor: Supplier ' || {_s('p')} || {NL} || 'Invoice Number: INV-' || {_s('k')}"
    f" || {NL} || 'Invoice Date: ' || written || {NL} || 'Due Date: ' || iso || {NL} || '  ' || {NL} || 'Line Items:'"
    + "".join(
        f" || (CASE WHEN n >= {i} THEN {NL} || n{i} || ' ' || {_s(f'q{i}')} || ' x ' || {_shown(f'u{i}')} ELSE '' END)"
        for i in LINES
    )
    + f" || {NL} || {NL} || 'Tax: ' || {_shown('tax')} || {NL} || 'Grand Total: ' || {_shown('grand')}"
)

_TITLES = "'Scope'", "'Payment'", "'Design Work'", "'Term'"
CONTRACT_JSON = (
    f"'{{\"parties\": [' || (CASE WHEN h % 6 = 0 THEN '\"Buyer\"' WHEN h % 25 = 0 THEN '' ELSE '\"Buyer\", \"Seller\"' END)"
    f" || '], \"effective_date\": ' || {_given('h % 14', 'iso')}"
    f" || (CASE WHEN h % 11 = 0 THEN '' ELSE ', \"expiration_date\": ' || {_given('h % 15', 'iso')} END)"
    f" || (CASE WHEN h % 37 = 0 THEN ', \"clauses\": null' WHEN h % 19 = 0 THEN '' ELSE "
    f"', \"clauses\": [{{\"title\": \"' || {_pick('h % 5', *_TITLES, chr(39) + 'Other' + chr(39))} || '\", \"text\": \"x\"}}'"
    f" || (CASE WHEN k % 4 = 0 THEN '' ELSE ', {{\"title\": \"SIGNATURES\", \"text\": \"y\"}}' END) || ']' END)"
    f" || ', \"obligations\": [{{\"party\": \"Buyer\", \"obligation\": \"Pay ' || {_cents('c')} || '\"}}]'"
    f" || ', \"terms\": {{\"duration\": \"' || {_s('n')} || ' years\", \"termination\": \"' || "
    + _pick("h % 8", "'Irrevocable'", "'No Termination before term'", "'60 days notice'", "'Unlimited Liability'", "'30 days'")
    + " || '\"}}'"
)
CONTRACT_TEXT = (
    f"'AGREEMENT' || {NL} || {NL} || 'This Agreement is made on ' || written || ' between Buyer ' || {_s('p')}"
    f" || ' and Seller.' || {NL} || {NL} || '1. SCOPE' || {NL} || 'Services run until ' || iso || '.' || {NL} || {NL}"
    f" || '2. PAYMENT' || {NL} || 'The buyer pays a fee of ' || {_shown('c')} || ' each year.'"
)

REPORT_JSON = (
    f"'{{\"title\": ' || {_given('h % 10', chr(39) + 'Review' + chr(39))} || ', \"period\": ' || {_given('h % 9', _s('y'))}"
    f" || ', \"kpis\": [' || (CASE WHEN h % 18 = 0 THEN '' ELSE '{{\"name\": \"Revenue\", \"value\": ' || "
    f"(CASE WHEN k % 9 = 0 THEN '-' || {_s('c')} WHEN k % 23 = 0 THEN '9000000000000' WHEN k % 8 = 0 THEN 'null' "
    f"WHEN k % 5 = 0 THEN '\"-5%\"' ELSE {_s('c')} END)"
    f" || ', \"unit\": \"USD\"}}, {{\"value\": ' || (CASE WHEN h % 16 = 0 THEN '-7' ELSE '72' END) || '}}' END)"
    f" || '], \"sections\": [' || (CASE WHEN h % 13 = 0 THEN '' ELSE '{{\"heading\": \"Summary\", \"summary\": \"up\"}}' END)"
    f" || ']}}'"
)
REPORT_TEXT = (
    f"'REVIEW ' || {_s('y')} || {NL} || 'Report Date: ' || written || {NL} || {NL} || 'Revenue grew to ' || {_shown('c')}"
    f" || ' while costs were ' || {_shown('tax')} || '.' || {NL} || {NL} || 'RISKS' || {NL} || 'Pricing pressure remains.'"
)

KIND = "(CASE WHEN k % 10 < 4 THEN 'invoice' WHEN k % 10 < 7 THEN 'contract' WHEN k % 10 < 9 THEN 'report' ELSE 'memo' END)"
CLASSIFY_JSON = (
    f"'{{\"type\": \"' || kind || '\"' || (CASE h % 11 WHEN 0 THEN ', \"confidence\": \"0.9\"' WHEN 1 THEN ', \"confidence\": 1.4'"
    " WHEN 2 THEN ', \"confidence\": -0.2' WHEN 3 THEN ', \"confidence\": null' WHEN 4 THEN ''"
    f" WHEN 5 THEN ', \"confidence\": \"high\"' ELSE ', \"confidence\": 0.' || {_s('70 + k % 30')} END) || '}}'"
)
# Replies in the flat field lists of profile G.
FIELDS_JSON = _pick(
    "h % 4",
    f"'{{\"invoice_number\": \"' || {_s('k')} || '\", \"total\": ' || {_cents('grand')} || ', \"parties\": [\"A\"], \"title\": \"T\", "
    "\"key_findings\": [], \"effective_date\": \"\", \"summary\": \"s\"}'",
    f"'{{\"invoice_number\": null, \"total\": \"' || {_cents('c')} || '\", \"parties\": [], \"effective_date\": \"' || iso || '\", "
    "\"title\": \"\", \"key_findings\": [\"up\"], \"vendor\": {\"name\": \"v\"}}'",
    f"'{{\"total\": \"n/a\", \"title\": 0, \"key_findings\": \"\", \"parties\": {{}}, \"effective_date\": 2024}}'",
    f"'{{\"invoice_number\": ' || {_s('k')} || ', \"total\": null, \"title\": \"T\", \"key_findings\": \"x\"}}'",
)
TABLE_JSON = (
    "(CASE WHEN h % 7 = 0 THEN '{\"item\": \"only\"}' WHEN h % 7 = 1 THEN '[]' ELSE '[{\"item\": \"' || n1 || '\", \"qty\": ' || "
    f"{_s('q1')} || '}}, 5, \"x\", {{\"qty\": \"' || {_s('q2')} || '\", \"extra\": 1}}]' END)"
)
_LEVEL = _pick("h % 3", "'high'", "'Medium'", "'low'")
ANALYSIS_JSON = (
    "'{' || (CASE WHEN k % 3 = 0 THEN '' ELSE '\"risks\": [{\"risk\": \"late\", \"severity\": \"' || "
    f"{_LEVEL} || '\", \"clause\": \"2\"}}' || (CASE WHEN k % 4 = 0 THEN ', {{\"risk\": \"cost\", \"severity\": \"high\"}}' ELSE '' END) || '], ' END)"
    " || (CASE WHEN k % 6 = 0 THEN '\"anomalies\": [{\"type\": \"pricing\", \"detail\": \"d\", \"severity\": \"low\"}], ' ELSE '' END)"
    " || (CASE WHEN k % 5 = 0 THEN '\"insights\": [{\"insight\": \"i\", \"metric\": \"Revenue\"}], ' ELSE '' END)"
    f" || '\"summary\": \"Document ' || {_s('k')} || '\"}}'"
)
ANALYSIS_G_JSON = (
    "'{\"risks\": [' || (CASE WHEN k % 3 = 0 THEN '' ELSE '\"late\", \"cost\"' END) || '], \"anomalies\": [' || "
    "(CASE WHEN k % 6 = 0 THEN '\"price\"' ELSE '' END) || '], \"insights\": ["
    f"], \"summary\": \"Document ' || {_s('k')} || '\"}}'"
)
# The submitter names the type of some documents.
REQUESTED = "(CASE WHEN h % 27 = 5 THEN 'invoice' WHEN h % 27 = 6 THEN 'unknown' ELSE CAST(NULL AS STRING) END)"

DOCUMENTS = {
    "job_id": f"'job-' || {_s('k')}",
    "kind": KIND,
    "invoice_text": INVOICE_TEXT,
    "contract_text": CONTRACT_TEXT,
    "report_text": REPORT_TEXT,
    "requested_type": REQUESTED,
    "invoice_json": INVOICE_JSON,
    "contract_json": CONTRACT_JSON,
    "report_json": REPORT_JSON,
    "fields_json": FIELDS_JSON,
    "table_json": TABLE_JSON,
    "analysis_json": ANALYSIS_JSON,
    "analysis_g_json": ANALYSIS_G_JSON,
}
MIXED = {
    "classify_json": CLASSIFY_JSON,
    "extract_json": "(CASE kind WHEN 'invoice' THEN invoice_json WHEN 'report' THEN report_json ELSE contract_json END)",
    "document_text": "(CASE kind WHEN 'invoice' THEN invoice_text WHEN 'report' THEN report_text ELSE contract_text END)",
}
REPLIES = {
    f"{name}_reply": _reply(f"{name}_json")
    for name in ("classify", "extract", "invoice", "contract", "report", "fields", "table", "analysis", "analysis_g")
}
STAGES = (ORDER, NUMBERS, SUMS, TOTALS, DOCUMENTS, MIXED, REPLIES)


def render(orders: DataFrame, *columns: str) -> DataFrame:
    """The named rendered columns (all without names) and those they are built from."""
    needed = set(columns) or {name for stage in STAGES for name in stage}
    for stage in reversed(STAGES):
        for name in needed & stage.keys():
            needed |= set(re.findall(r"[a-z_0-9]+", stage[name]))
    for stage in STAGES:
        mine = {name: F.expr(sql) for name, sql in stage.items() if name in needed}
        orders = orders.withColumns(mine) if mine else orders
    return orders


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    # Put into one method, the rendering is larger than what the JVM compiles (8000 bytes) and stays interpreted.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_LIMIT)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    used = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return render(spread_rows(orders.select(*used)), *columns)


def as_sql(table: str = "orders") -> str:
    """The same rendering as one SQL text."""
    sql = table
    for i, stage in enumerate(STAGES):
        columns = ", ".join(f"{expr} AS {name}" for name, expr in stage.items())
        sql = f"(SELECT *, {columns} FROM {sql}) AS s{i}"
    return sql

"""SQL for role detection: the facts of columns, the evidence for roles, the domain, and what is warned of."""

from __future__ import annotations

from colonnade.plans.roles import DOMAIN_ROLES, NUMBER_ROLES, ROLE_WORDS, TEXT_ROLES, YES_NO, normalize_name

SHAPE = r"\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4}"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _facts(source: str, columns: dict[str, str]) -> str:
    """One SELECT a column; kinds are number, text, time and other."""
    out = []
    for i, (name, kind) in enumerate(columns.items()):
        c = f'"{name}"'
        text = f"CAST({c} AS VARCHAR)"
        repeated = f"count(DISTINCT {c}) BETWEEN 1 AND greatest(50, count(*) * 0.5)" if kind == "text" else "false"
        dated = {
            "time": f"count({c}) > 0",
            "text": f"count({c}) > 0 AND count(*) FILTER (regexp_matches({c}, '{SHAPE}')) >= 0.5 * count({c}) AND count(TRY_CAST({c} AS TIMESTAMP)) >= 0.6 * count({c})",
        }.get(kind, "false")
        answers = f"count({c}) > 0 AND count(*) FILTER (lower(trim({text})) IN ({', '.join(repr(w) for w in YES_NO)})) = count({c})"
        short = f"count({c}) > 0 AND count(*) FILTER (length({text}) BETWEEN 2 AND 30) > 0.8 * count({c})"
        out.append(
            f"SELECT {i} AS position, '{name}' AS \"column\", '{normalize_name(name)}' AS plain, {str(kind == 'number').lower()} AS numeric, "
            f"{repeated} AS repeated_text, {dated} AS date_like, {answers} AS yes_no, {short} AS short_text FROM {source}"
        )
    return " UNION ALL ".join(out)


def candidate_ctes(source: str, columns: dict[str, str]) -> str:
    """CTEs up to ``candidates`` and ``matched``, to follow the CTEs that define ``source``."""
    words = ", ".join(f"({i}, '{role}', {_list(normalize_name(w) for w in own)})" for i, (role, own) in enumerate(ROLE_WORDS.items()))
    return f""", facts AS ({_facts(source, columns)}),
    wanted(rank, role, words) AS (VALUES {words}),
    pairs AS (SELECT *, list_contains(words, plain) AS exact, len(list_filter(words, lambda w: contains(plain, w))) > 0 AS part,
              len(list_filter(words, lambda w: length(w) > 2 AND list_has_any(str_split(plain, '_'), str_split(w, '_')))) > 0 AS token FROM facts, wanted),
    evidence AS (
      SELECT *, CASE WHEN exact THEN 0.72 WHEN part THEN 0.55 WHEN token THEN 0.38 ELSE 0 END AS named,
        CASE WHEN exact THEN 'exact name match' WHEN part THEN 'partial name match' WHEN token THEN 'token overlap' END AS named_text,
        CASE WHEN role = 'date' THEN CASE WHEN date_like THEN 0.25 ELSE -0.15 END
             WHEN list_contains({_list(sorted(NUMBER_ROLES))}, role) THEN CASE WHEN numeric THEN 0.18 ELSE -0.2 END
             WHEN list_contains({_list(sorted(TEXT_ROLES))}, role) AND repeated_text THEN 0.14 ELSE 0 END AS dtype,
        CASE WHEN role IN ('target', 'conversion', 'overtime') AND yes_no THEN 0.18 WHEN role = 'country' AND short_text THEN 0.05 ELSE 0 END AS pattern,
        CASE WHEN role = 'customer' AND plain IN ('id', 'customerid', 'customer_id') THEN 0.08
             WHEN role = 'campaign' AND plain LIKE 'acceptedcmp%' THEN 0.22 WHEN role = 'monetary' AND plain LIKE 'mnt%' THEN 0.22
             WHEN role = 'frequency' AND plain LIKE 'num%purchase%' THEN 0.22 ELSE 0 END AS prior
      FROM pairs),
    candidates AS (
      SELECT rank, position, role, "column", CAST(round_even(least(greatest(named + dtype + pattern + prior, 0), 1), 3) AS DOUBLE) AS confidence,
        concat_ws(', ', named_text, CASE WHEN dtype <> 0 THEN 'compatible dtype' END, CASE WHEN pattern <> 0 THEN 'value pattern' END,
                  CASE WHEN prior <> 0 THEN 'domain prior' END) AS reason
      FROM evidence WHERE named + dtype + pattern + prior >= 0.3),
    matched AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY confidence DESC, position) AS n FROM candidates)
      WHERE n = 1 AND confidence >= 0.45)"""


def candidates_sql(ctes: str, source: str, columns: dict[str, str]) -> str:
    return f"""{ctes}{candidate_ctes(source, columns)}
    SELECT role, "column", confidence, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS confidence_label, reason
    FROM candidates"""


def domain_ctes(columns: dict[str, str]) -> str:
    """CTE ``domain`` for tables without unmistakable column names and without traffic words."""
    rows = ", ".join(f"({i}, '{d}', {_list(sorted(r))}, {_list(sorted(o))})" for i, (d, r, o) in enumerate(DOMAIN_ROLES) if d != "logistics")
    return f""", held AS (SELECT coalesce(list(role), []) AS roles FROM matched),
    scores AS (SELECT i, d, 0.78 * len(list_intersect(r, roles)) / len(r) + 0.22 * len(list_intersect(o, roles)) / len(o) AS score
               FROM (VALUES {rows}) AS v(i, d, r, o), held),
    best AS (SELECT * FROM scores ORDER BY score DESC, i LIMIT 1),
    domain AS (SELECT roles, CASE WHEN list_contains(roles, 'campaign') AND list_has_any(roles, ['target', 'conversion']) THEN 'marketing'
                 WHEN list_has_all(roles, ['department', 'target']) AND list_has_any(roles, ['employee', 'salary']) THEN 'hr'
                 WHEN score >= 0.55 THEN d ELSE 'generic' END AS domain FROM held, best)"""


def detected_sql(ctes: str, source: str, columns: dict[str, str]) -> str:
    return f"""{ctes}{candidate_ctes(source, columns)}{domain_ctes(columns)}
    SELECT domain, role, "column", confidence, 'auto' AS source FROM matched, domain"""


def warnings_sql(ctes: str, source: str, columns: dict[str, str]) -> str:
    return f"""{ctes}{candidate_ctes(source, columns)}{domain_ctes(columns)}
    SELECT 'No confident revenue/sales column was detected.' AS warning FROM domain
      WHERE domain IN ('ecommerce', 'retail', 'marketing', 'finance') AND NOT list_contains(roles, 'revenue')
    UNION ALL SELECT 'No confident date column was detected.' FROM domain WHERE NOT list_contains(roles, 'date')
    UNION ALL SELECT 'HR-like dataset detected, but no attrition/target column was detected.' FROM domain
      WHERE domain = 'hr' AND NOT list_contains(roles, 'target')
    UNION ALL SELECT 'Marketing-like dataset detected, but no response/conversion column was detected.' FROM domain
      WHERE domain = 'marketing' AND NOT list_has_any(roles, ['target', 'conversion'])"""

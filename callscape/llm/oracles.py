"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from callscape.llm import licenses, linededup, secrets

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{linededup.UPPER}', '{linededup.LOWER}') AS k FROM lines
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {linededup.MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {linededup.MIN_DOCS}
), marked AS (
  SELECT doc_id, pos, line, (keeper IS NOT NULL AND keeper <> doc_id) AS gone FROM keyed LEFT JOIN hot USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _license_scan() -> str:
    def canonical(x: str) -> str:
        # RE2 has no multi-line anchors by default: (?m) is set in the pattern itself.
        x = f"regexp_replace(lower({x}), '{licenses.COPYRIGHT_LINE}', '', 'g')"
        for standard, other in licenses.SPELLINGS:
            if " ".join("".join(c if c.isalnum() else " " for c in other).split()) != other:
                x = f"replace({x}, '{other}', '{standard}')"
        x = f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for standard, other in licenses.SPELLINGS:
            if other.replace(" ", "").isalnum():
                x = f"regexp_replace({x}, '\\b{other}\\b', '{standard}', 'g')"
        return x

    known = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.KNOWN.items())
    return f"""
WITH known(license, body) AS (VALUES {known}),
digests AS (SELECT license, sha256({canonical("body")}) AS digest FROM known),
docs AS (SELECT doc_id, sha256({canonical("coalesce(text, '')")}) AS digest FROM documents)
SELECT doc_id, digest, license FROM docs LEFT JOIN digests USING (digest)
"""


def _secret_scan() -> str:
    per_kind = []
    for i, (kind, (pattern, group, least)) in enumerate(secrets.KINDS.items()):
        lit = pattern.replace("'", "''")
        passes = f"length(value) >= {least}"
        if kind == "mixed":
            passes += " AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')"
        per_kind.append(f"""
  SELECT doc_id, owner, repo, '{kind}' AS kind, {i} AS nth, value, finish - length(whole) AS start, finish FROM (
    SELECT doc_id, owner, repo, whole, value, sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id ORDER BY i) AS finish FROM (
      SELECT doc_id, owner, repo, unnest(wholes) AS whole, unnest(vals) AS value, unnest(gaps[:len(wholes)]) AS gap, generate_subscripts(wholes, 1) AS i FROM (
        SELECT doc_id, owner, repo, regexp_extract_all(body, '{lit}', 0) AS wholes, regexp_extract_all(body, '{lit}', {group}) AS vals, string_split_regex(body, '{lit}') AS gaps FROM docs WHERE regexp_matches(body, '{lit}'))))
  WHERE {passes}""")
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    counts = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secrets.BASE)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body, coalesce(source, '') AS owner, concat_ws('/', coalesce(source, ''), coalesce(lang, '')) AS repo FROM documents),
placed AS ({" UNION ALL ".join(per_kind)}),
stats AS (SELECT value, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repo)) AS n_repos FROM placed GROUP BY value),
judged AS (SELECT *, kind IN ({base}) AS base, n_owners = 1 OR (n_owners <= {secrets.LIVE_OWNERS} AND n_repos <= {secrets.LIVE_REPOS}) AS live, concat(kind, ':', start::BIGINT, ':', finish::BIGINT) AS s FROM placed JOIN stats USING (value)),
spans AS (SELECT * FROM judged WHERE base OR live),
per_doc AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)}, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied, max(n_owners) AS most_owners, max(n_repos) AS most_repos,
  string_agg(s, ',' ORDER BY start, nth) FILTER (base) AS base_spans, string_agg(s, ',' ORDER BY start, nth) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {counts}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(most_owners, 0)::BIGINT AS most_owners, coalesce(most_repos, 0)::BIGINT AS most_repos
FROM docs LEFT JOIN per_doc USING (doc_id)
"""


ORACLES = {
    "op2_line_dedup": LINE_DEDUP,
    "op8_license_scan": _license_scan(),
    "op9_secret_scan": _secret_scan(),
}

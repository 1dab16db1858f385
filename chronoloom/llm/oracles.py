"""DuckDB SQL of the corpus queries that SQL can express: decontamination, WARC, licences, clustering, vector codes and secrets.

The others rest on a 64-bit hash, a trained model, tokenizer ranks or corpus
statistics that DuckDB's functions don't offer; tests hold them against brute force.
"""

from __future__ import annotations

import re

from chronoloom.llm import secrets
from chronoloom.llm.licenses import BASE, TEMPLATES, parsed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"coalesce(regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"


DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS ws FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS id, {_words('text')} AS ws FROM benchmark),
win AS (SELECT DISTINCT id, least(len(ws), 13) AS n, array_to_string(ws[k:k + 12], ' ') AS w FROM (SELECT *, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS k FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT doc_id, id, dwin.n, k FROM dwin JOIN win ON win.n = dwin.n AND win.w = dwin.w),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, html, sha1(encode(html)) AS x, max(page_id) OVER (PARTITION BY html) AS top FROM p),
b AS (SELECT *, list_transform(range(8), lambda g: ('0x' || x[5 * g + 1:5 * g + 5])::BIGINT) AS v FROM s)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31) + 1]), '') AS payload_digest,
  CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM b
"""


def _pattern(template: str) -> str:
    """The template as a regular expression over words with a space before each and one at the end."""
    out = ""
    for kind, *given in parsed(template):
        if kind == "var":
            out += "(?: (?:%s)){%d,%d}" % (given[0].replace(".+", "[^ ]+"), given[2], given[1])
        else:
            body = "".join(f" {re.escape(w)}" for w in given[0])
            out += f"(?:{body})?" if kind == "may" else body
    return out + " "


def _places(phrase: str) -> str:
    own = phrase.split()
    test = " AND ".join(f"ws[k + {i + 1}] = '{w}'" for i, w in enumerate(own))
    return f"list_filter(range(greatest(len(ws) - {len(own) - 1}, 0)), lambda k: {test})"


LICENCES = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS ws FROM documents),
p AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS j, {', '.join(f'{_places(p)} AS b{k}' for k, p in enumerate(BASE))} FROM d),
l AS (SELECT doc_id, len(ws)::BIGINT AS n_words, list_concat({', '.join(f'b{k}' for k in range(len(BASE)))}) AS places,
  list_filter([{', '.join(f"CASE WHEN len(b{k}) > 0 THEN '{label}' END" for k, label in enumerate(BASE.values()))}], lambda x: x IS NOT NULL) AS base,
  list_filter([{', '.join(f"CASE WHEN regexp_matches(j, '{_pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())}], lambda x: x IS NOT NULL) AS more FROM p)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, more))), ',') AS labels,
  CASE WHEN len(more) > 0 THEN 1.0 WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM l
"""


def _whole(scale: int) -> str:
    return f"list_transform(embedding, lambda x: floor({scale} * x::DOUBLE))"


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"
_APART = "list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, y.v) + list_inner_product(y.v, y.v)"


def _means(own: str, by: str) -> str:
    """Componentwise floors of the means of the groups of ``own`` (its vectors are v)."""
    return f"""(SELECT {by}, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY i) AS m FROM (SELECT {by}, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT {by}, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {own}) GROUP BY ALL) GROUP BY {by})"""


def _clusters(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds without bounds, one after the other."""
    out = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_whole(256)} AS v FROM embeddings WHERE len(embedding) = 64 AND {_FINITE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        out.append(f"a{n} AS MATERIALIZED (SELECT x.r, any_value(x.vec_id) AS vec_id, any_value(x.v) AS v, arg_min(y.c, ({_APART}, y.c)) AS c, min({_APART})::BIGINT AS d FROM kept x, c{n} y GROUP BY x.r)")
        if n < rounds:
            out.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m, v) AS v FROM c{n} LEFT JOIN {_means(f'a{n}', 'c')} USING (c))")
    return f"""WITH {", ".join(out)}
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(y.v, lambda e: e::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} y USING (c)"""


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    out = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, {_whole(1024)}) - 1 AS r, vec_id, label, {_whole(1024)} AS w FROM embeddings WHERE {_FINITE})",
        f"parts AS MATERIALIZED (SELECT r, p, w[p * len(w) // {parts} + 1:(p + 1) * len(w) // {parts}] AS v FROM kept, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, r AS e, v FROM parts WHERE r < {entries})",
    ]
    for n in range(rounds + 1):
        out.append(f"a{n} AS MATERIALIZED (SELECT x.r, x.p, any_value(x.v) AS v, arg_min(y.e, ({_APART}, y.e)) AS e, min({_APART})::BIGINT AS d FROM parts x JOIN b{n} y ON x.p = y.p GROUP BY x.r, x.p)")
        if n < rounds:
            out.append(f"b{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, v) AS v FROM b{n} LEFT JOIN {_means(f'a{n}', 'p, e')} USING (p, e))")
    return f"""WITH {", ".join(out)},
t AS (SELECT r, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN t USING (r), h"""


def _secrets() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    good = {"assign": f"length(regexp_extract(x, {quoted('^' + secrets._ASSIGN + '(' + secrets._VALUE + ')$')}, 1)) >= {secrets.LEAST_VALUE}", "opaque": " AND ".join(f"regexp_matches(x, '{c}')" for c in secrets.CLASSES)}

    def places(name: str, pattern: str, test: str = "true") -> str:
        ends = "list_sum(list_transform(b[1:i], lambda y: length(y))) + list_sum(list_transform(m[1:i], lambda y: length(y)))"
        return f"(SELECT r, {name} AS k, z - length(x) AS s, z AS e FROM (SELECT r, m[i] AS x, ({ends})::INT AS z FROM (SELECT r, m, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, {quoted(pattern)}) AS m, string_split_regex(t, {quoted(pattern)}) AS b FROM d))) WHERE {test})"

    parts = " UNION ALL ".join(f"FROM {places(str(n), secrets.PATTERNS[k], good.get(k, 'true'))}" for n, k in enumerate(secrets.KINDS))
    roles = {r: ", ".join(str(n) for n, k in enumerate(secrets.KINDS) if secrets.ROLES[k] == r) for r in ("id", "secret", "endpoint")}
    said = lambda: f"string_agg(({list(secrets.KINDS)})[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS MATERIALIZED ({parts}), ends AS MATERIALIZED {places("-1", secrets.SCOPE_END)},
q AS MATERIALIZED (SELECT *, (SELECT count(*) FROM ends WHERE ends.r = p.r AND ends.s < p.s) AS scope FROM p),
w AS (SELECT a.r, a.k, a.s, a.e, bool_or(b.k IN ({roles["id"]})) AS ids, bool_or(b.k IN ({roles["secret"]})) AS secrets, bool_or(b.k IN (0, 2)) AS strong
  FROM q a JOIN q b ON a.r = b.r AND a.scope = b.scope AND (b.s - a.e BETWEEN 0 AND {secrets.REACH} OR a.s - b.e BETWEEN 0 AND {secrets.REACH}) WHERE a.k >= 3 GROUP BY ALL),
l AS (SELECT r, k, s, e FROM w WHERE CASE WHEN k IN ({roles["id"]}) THEN secrets WHEN k IN ({roles["endpoint"]}) THEN strong OR (secrets AND ids) ELSE ids END),
base AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {said()} AS b FROM p WHERE k < 3 GROUP BY r),
every AS (SELECT r, count(*) FILTER (k >= 3) AS n_linked, {said()} AS spans FROM (FROM l UNION ALL SELECT r, k, s, e FROM p WHERE k < 3) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_linked, 0) AS n_linked, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": DECONTAMINATION, "op4_warc": WARC, "op8_licences": LICENCES, "op11_clustering": _clusters(), "op12_vector_codes": _codes(), "op13_secrets": _secrets()}

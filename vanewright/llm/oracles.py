"""SQL for the operators that SQL can express."""

from __future__ import annotations

import string

from . import secrets, substring, urls

SEPARATED = r"[^\x20\x09-\x0D]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scan() -> str:
    """Each rule's matches and the pieces between them alternate; sums of their lengths give the places."""
    each = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, string_split_regex(t, {quoted(pattern)}) AS p, regexp_extract_all(t, {quoted(pattern)}, 0) AS h, regexp_extract_all(t, {quoted(pattern)}, {1 if value else 0}) AS g, {whole} AS w, {value} AS v FROM d"
        for k, (_, pattern, _, whole, value) in enumerate(secrets.RULES)
    )
    names = ", ".join(quoted(r[0]) for r in secrets.RULES)
    listed = "string_agg([{names}][k + 1] || ':' || st || ':' || en, ',' ORDER BY st, k, en)".replace("{names}", names)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({each}), u AS (SELECT doc_id, k, p, h, g, w, v, unnest(range(1, len(h) + 1)) AS i FROM m WHERE len(h) > 0),
s AS (SELECT doc_id, k, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS st, length(h[i]) AS l FROM u WHERE length(h[i]) >= w AND length(g[i]) >= v),
e AS (SELECT doc_id, k, st, st + l AS en FROM s), b AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {listed} FILTER (k < 3) AS base, {listed} AS spans FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN b USING (doc_id)"""


def url_filter() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rules = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    name = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in rules) + " END"
    spread = f"least(greatest(CASE WHEN var_pop(bad / n) > 0 THEN avg(bad / n) * (1 - avg(bad / n)) / var_pop(bad / n) - 1 ELSE {urls.MOST_STRENGTH} END, {urls.LEAST_STRENGTH}), {urls.MOST_STRENGTH})"
    listed = ", ".join(map(quoted, urls.SUFFIXES))
    post = "a0 / (a0 + b0) * s + bad AS {a}, (1 - a0 / (a0 + b0)) * s + n - bad AS {b}"
    return f"""WITH r0 AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
r1 AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM r0),
r2 AS (SELECT *, regexp_replace(regexp_replace(host, '{urls.USER}', ''), '{urls.PORT}', '') AS site FROM r1),
r3 AS (SELECT *, string_split(site, '.') AS l, regexp_matches(site, '{urls.NUMBER}') AS ip FROM r2), r4 AS (SELECT *, array_to_string(l[-2:], '.') IN ({listed}) AS two FROM r3),
pg AS (SELECT page_id, host, path, site, CASE WHEN ip THEN site ELSE array_to_string(CASE WHEN two THEN l[-3:] ELSE l[-2:] END, '.') END AS domain, CASE WHEN ip THEN '' WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM r4),
mk AS (SELECT doc_id AS page_id, max((coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0)::INT) AS bad FROM labels GROUP BY 1),
c AS (SELECT site, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM pg JOIN mk USING (page_id) GROUP BY 1, 2, 3),
top AS (SELECT coalesce(sum(bad), 0) + 1 AS a0, coalesce(sum(n), 0) - coalesce(sum(bad), 0) + 1 AS b0 FROM c),
s1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM c GROUP BY 1), p1 AS (SELECT suffix, {post.format(a='a1', b='b1')} FROM s1, (SELECT {spread} AS s FROM s1), top),
s2 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM c GROUP BY 1, 2), g2 AS (SELECT suffix, {spread} AS s FROM s2 GROUP BY 1), p2 AS (SELECT domain, {post.format(a='a2', b='b2')} FROM s2 JOIN g2 USING (suffix) JOIN (SELECT suffix, a1 AS a0, b1 AS b0 FROM p1) USING (suffix)),
s3 AS (SELECT domain, site, sum(n) AS n, sum(bad) AS bad FROM c GROUP BY 1, 2), g3 AS (SELECT domain, {spread} AS s FROM s3 GROUP BY 1), p3 AS (SELECT site, {post.format(a='a3', b='b3')} FROM s3 JOIN g3 USING (domain) JOIN (SELECT domain, a2 AS a0, b2 AS b0 FROM p2) USING (domain)),
j AS (SELECT pg.*, coalesce(a3, a2, a1, a0) AS a, coalesce(b3, b2, b1, b0) AS b FROM pg LEFT JOIN p3 USING (site) LEFT JOIN p2 USING (domain) LEFT JOIN p1 USING (suffix), top),
k AS (SELECT *, a / (a + b) - {urls.Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM j)
SELECT page_id, host, path, {name} AS rule, coalesce({verdict}, CASE WHEN bound > {urls.BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict, round(a / (a + b), 6) AS share_bad, round(bound, 6) AS bound FROM k"""


def substring_dedup() -> str:
    n = substring.WINDOW
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SEPARATED}') AS l FROM documents), p AS (SELECT doc_id, i, md5(array_to_string(l[i:i + {n - 1}], ' ')) AS k FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - {n - 2}, 1))) AS i FROM w)),
f AS (SELECT k, min(doc_id) AS m FROM p GROUP BY 1), r AS (SELECT DISTINCT p.doc_id, i + o AS j FROM p JOIN f USING (k), range({n}) t(o) WHERE p.doc_id > m), u AS (SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS j FROM w),
x AS (SELECT u.doc_id, count(r.j) AS gone, string_agg(word, ' ' ORDER BY u.j) FILTER (r.j IS NULL) AS kept FROM u LEFT JOIN r ON u.doc_id = r.doc_id AND u.j = r.j GROUP BY 1)
SELECT w.doc_id, len(l) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN x USING (doc_id)"""


def centroid_clusters() -> str:
    """Rounds one after the other; a new centroid is the exact floor of sum by count."""
    parts = [
        """kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS j, x AS c FROM (SELECT sha256('3:' || vec_id) AS h, x FROM kept ORDER BY h LIMIT 8))",
    ]
    for r in range(11):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x, min(struct_pack(d := d, j := j)) AS m FROM (SELECT vec_id, x, j, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, c{r}) GROUP BY vec_id, x)")
        if r < 10:
            parts.append(f"s{r} AS (SELECT j, p, sum(v) AS s, count(*) AS n FROM (SELECT m.j AS j, unnest(x) AS v, unnest(range(1, 65)) AS p FROM a{r}) GROUP BY j, p)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j AS j, coalesce(n.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY p) AS c FROM s{r} GROUP BY j) n ON c.j = n.j)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(m.j AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a10 JOIN c10 ON m.j = c10.j"""


def conversation_trie() -> str:
    """Every prefix of every rebuilt conversation; a node's totals are sums over the nodes that have it as a prefix. CRC-32
    of an id, bit by bit."""
    crc = "list_reduce(list_prepend(4294967295, list_transform(range(1, 8 * length(i) + 1), lambda k: CAST((ascii(i[CAST((k - 1) // 8 + 1 AS INTEGER)]) >> ((k - 1) % 8)) & 1 AS BIGINT))), lambda a, b: CASE WHEN (a & 1) <> b THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(k := sha256(strlen(role) || ':' || role || text), b := strlen(text)) ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, xor({crc}, 4294967295) % 9 AS h FROM (SELECT conv_id, own, CAST(conv_id AS VARCHAR) AS i FROM o)),
r AS (SELECT h.conv_id, CASE WHEN h = 0 THEN own ELSE list_concat(coalesce(o2.head, []), own[h + 1:]) END AS turns FROM (SELECT h.*, conv_id - conv_id % 5 AS base FROM h) h LEFT JOIN (SELECT conv_id AS base, own AS family FROM o) f ON f.base = h.base, LATERAL (SELECT f.family[1:h.h] AS head) o2),
p AS (SELECT conv_id, d, len(turns) AS n, array_to_string(list_transform(turns[1:d], lambda x: x.k), ',') AS k, CASE WHEN d > 0 THEN array_to_string(list_transform(turns[1:d - 1], lambda x: x.k), ',') END AS pk, CASE WHEN d > 0 THEN turns[d].b ELSE 0 END AS b FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
m AS (SELECT d, k, any_value(pk) AS pk, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends FROM p GROUP BY d, k),
c AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM m WHERE d > 0 GROUP BY d, pk),
u AS (SELECT m.d, m.k, m.conv_id, m.b, m.n_convs, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN c ON m.d = c.d AND m.k = c.k),
s AS (SELECT q.d, q.k, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.b) AS saved FROM u JOIN p q ON q.conv_id = u.conv_id AND q.d <= u.d GROUP BY q.d, q.k)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, mp.conv_id AS parent_conv_id, m.n_convs, u.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN u ON m.d = u.d AND m.k = u.k JOIN s ON m.d = s.d AND m.k = s.k LEFT JOIN m mp ON mp.d = m.d - 1 AND mp.k = m.pk"""

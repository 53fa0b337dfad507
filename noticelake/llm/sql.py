"""SQL for DuckDB that gives the rows of the operators' queries, where SQL can express them.

op1 (line frequency), op3, op11 and op12 (tokens) have none; tests hold them against plain versions.
"""

from __future__ import annotations

from . import license as license_
from . import pii

WORD = r"[^\x20\x09-\x0D]+"


def template_regex(elements: list[tuple]) -> str:
    """A template as a pattern over words that have a space before and after each."""
    out = ""
    for e in elements:
        if e[0] == "word":
            out += f" {e[1]} "
        elif e[0] == "maybe":
            out += f"(?:{template_regex(e[1])})?"
        else:
            out += f"(?: [^ ]+ ){{{e[1]},{e[2]}}}"
    return out


def op2() -> str:
    plain = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    every = [(True, label, markup) for markup, label in license_.BASE.items()] + [(False, name, markup) for name, markup in license_.read_templates().items()]
    cuts = []
    for base, name, markup in every:
        pattern = template_regex(license_.parsed(name, markup))
        cuts.append(f"SELECT doc_id, {base} AS base, '{name}' AS name, '{license_.license_of(name)}' AS label, string_split(regexp_replace(cells, '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS cut FROM d WHERE regexp_matches(cells, '{pattern}')")
    return f"""WITH w AS (SELECT doc_id, {plain} AS words FROM documents), d AS (SELECT doc_id, len(words) AS n, CASE WHEN len(words) > 0 THEN ' ' || array_to_string(words, '  ') || ' ' ELSE '' END AS cells FROM w),
c AS ({" UNION ALL ".join(cuts)}),
u AS (SELECT doc_id, base, name, label, unnest(cut) AS piece, generate_subscripts(cut, 1) AS i FROM c), k AS (SELECT *, (length(piece) - length(replace(piece, ' ', ''))) // 2 AS k FROM u),
p AS (SELECT *, sum(k) OVER (PARTITION BY doc_id, base, name ORDER BY i) AS high FROM k), s AS (SELECT doc_id, base, label, high - k AS low, high FROM p WHERE i % 2 = 0),
v AS (SELECT doc_id, count(DISTINCT x) AS covered FROM (SELECT doc_id, unnest(range(low::BIGINT, high::BIGINT)) AS x FROM s) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(low) FILTER (base) AS first_word, max(low) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM s GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(covered / n, 0)::DOUBLE AS score
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN v ON d.doc_id = v.doc_id"""


def op4(seed: int = 7, favour: float = 0.25) -> str:
    return f"""WITH h AS (SELECT doc_id, source, text, ('0x' || substr(md5(concat_ws(':', '{seed}', coalesce(doc_id::VARCHAR, 'null'), coalesce(source, 'null'), coalesce(md5(text), 'null'))), 1, 13))::BIGINT AS draw, row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS n FROM documents),
z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, CASE WHEN n = 0 THEN draw ELSE ('0x' || substr(md5(draw || ':' || n), 1, 13))::BIGINT END AS draw FROM h),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM z GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight, row_number() OVER o AS turn,
  coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
  coalesce(sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST)),
l AS (SELECT *, (total - cap_before) / (all_weight - weight_before) AS level FROM c),
t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM l WHERE cap >= weight * level ORDER BY turn LIMIT 1)), cap) AS target FROM l),
x0 AS (SELECT source, length(bin(size)) AS class, sum(size)::BIGINT AS words FROM z GROUP BY ALL),
x1 AS (SELECT x0.*, source_size, target, pow(2.0::DOUBLE, class * {favour}::DOUBLE) AS f, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12) AS certain FROM x0 JOIN t ON x0.source IS NOT DISTINCT FROM t.source),
x2 AS (SELECT *, greatest(target - certain * source_size, 0) AS missing FROM x1),
x3 AS (SELECT *, sum(words * f) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM x2),
x4 AS (SELECT *, CASE WHEN rest > 0 THEN (missing - before) / rest ELSE 0 END AS level FROM x3),
x5 AS (SELECT * EXCLUDE (level), arg_max(level, class) FILTER (level * f <= 1 + 1e-12) OVER (PARTITION BY source) AS level FROM x4), x6 AS (SELECT *, greatest(level * f, 0) AS p0 FROM x5),
x7 AS (SELECT source, class, source_size, target, certain + (p0 >= 1 - 1e-12)::INT AS certain, CASE WHEN p0 >= 1 - 1e-12 THEN 0 ELSE p0 END AS p, missing - coalesce(sum(words) FILTER (p0 >= 1 - 1e-12) OVER (PARTITION BY source), 0)::DOUBLE AS missing FROM x6),
p AS (SELECT z.*, source_size, target, certain, p, missing, (draw::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM z JOIN x7 ON z.source IS NOT DISTINCT FROM x7.source AND length(bin(size)) = x7.class),
q AS (SELECT *, CASE WHEN p > 1e-12 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM p),
k AS (SELECT *, CASE WHEN odds IS NULL THEN 1.0::DOUBLE ELSE odds / (1 + odds) END AS rank FROM q),
a AS (SELECT *, sum(CASE WHEN p > 1e-12 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM k),
i AS (SELECT *, p > 1e-12 AND upto <= missing AS taken_in FROM a),
e AS (SELECT source, min(missing) - coalesce(max(upto) FILTER (taken_in), 0) AS short FROM i GROUP BY source),
x AS (SELECT i.source, arg_min(doc_id, (abs(short - size), rank, doc_id)) AS doc_id FROM i JOIN e ON i.source IS NOT DISTINCT FROM e.source WHERE NOT taken_in AND p > 1e-12 AND abs(short - size) < short GROUP BY i.source)
SELECT i.doc_id, size, source_size, target, ((certain + CASE WHEN taken_in OR x.doc_id IS NOT NULL THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM i LEFT JOIN x ON i.source IS NOT DISTINCT FROM x.source AND i.doc_id = x.doc_id AND NOT i.taken_in"""


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"\b{pii.IBAN}\b",
    "nir": rf"\b{pii.NIR}\b",
    "dni": rf"\b{pii.DNI}\b",
    "ssn": rf"\b{pii.SSN}\b",
    "secret": rf"\b{pii.SECRET}",
    "password": rf"\b{pii.PASSWORD}",
}


def op5(least: float = 0.5) -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, {k} AS kind, '{name}' AS name, string_split(regexp_replace(t, '({rx})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS cut FROM d" for k, (name, rx) in enumerate(PII.items()))
    turned = "list_transform(string_split(substr(solid, 5) || substr(solid, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN (ascii(c) - 55)::VARCHAR ELSE c END)"
    near = r"lower(right(before, {w}) || ' ' || left(after, {w}))".format(w=pii.WINDOW)
    scores = " ".join(f"WHEN {k} THEN CASE WHEN regexp_matches({near}, '\\b(?:{pii.KINDS[n][3]})') THEN {round(100 * min(1.0, pii.KINDS[n][2] + pii.RAISE))} ELSE {round(100 * pii.KINDS[n][2])} END" for k, n in enumerate(PII))
    return f"""WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents), c AS ({parts}),
u AS (SELECT doc_id, kind, name, unnest(cut) AS piece, generate_subscripts(cut, 1) AS i FROM c WHERE len(cut) > 1),
p AS (SELECT *, sum(length(piece)) OVER o AS high, lag(piece) OVER o AS before, lead(piece) OVER o AS after FROM u WINDOW o AS (PARTITION BY doc_id, kind ORDER BY i)),
m AS (SELECT *, high - length(piece) AS low, regexp_replace(piece, '[^0-9]', '', 'g') AS digits, replace(piece, ' ', '') AS solid, CASE kind {scores} END AS score FROM p WHERE i % 2 = 0),
v AS (SELECT doc_id, kind, name, low, high, score FROM m WHERE (kind < 4 OR score >= {round(100 * least)}) AND CASE kind WHEN 0 THEN true
  WHEN 1 THEN list_bool_and(list_transform(string_split(piece, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(x AS HUGEINT), 999) <= 255))
  WHEN 2 THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k: CASE WHEN k % 2 = 1 THEN substr(digits, length(digits) + 1 - k, 1)::INT
    ELSE 2 * substr(digits, length(digits) + 1 - k, 1)::INT - CASE WHEN substr(digits, length(digits) + 1 - k, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  WHEN 3 THEN length(digits) BETWEEN 9 AND 15
  WHEN 4 THEN list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(array_to_string({turned}, ''), ''), lambda c: c::HUGEINT)), lambda x, y: (x * 10 + y) % 97) = 1
  WHEN 5 THEN 97 - substr(piece, 1, 13)::BIGINT % 97 = substr(piece, 14, 2)::BIGINT
  WHEN 6 THEN substr('{pii.DNI_LETTERS}', (substr(piece, 1, 8)::INT % 23 + 1)::INT, 1) = right(piece, 1)
  WHEN 7 THEN left(piece, 3) NOT IN ('000', '666') AND left(piece, 1) <> '9' AND substr(piece, 5, 2) <> '00' AND right(piece, 4) <> '0000'
  WHEN 8 THEN regexp_matches(piece, '[0-9]') AND regexp_matches(piece, '[A-Za-z]') ELSE true END),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone, count(*) AS n_spans, string_agg(score::VARCHAR, ',' ORDER BY low, kind) AS scores,
  string_agg(name || ':' || low::BIGINT || ':' || high::BIGINT, ',' ORDER BY low, kind) FILTER (kind < 4) AS base, string_agg(name || ':' || low::BIGINT || ':' || high::BIGINT, ',' ORDER BY low, kind) AS spans FROM v GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


OP6 = r"""WITH r AS (SELECT page_id, url, html, ('0x' || substr(sha256(coalesce(url, '')), 1, 2))::INT AS kind,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
h AS (SELECT *, strlen(record) AS n, hex(encode(record)) AS x FROM r WHERE kind < 6),
f AS (SELECT *, substr(x, (n // 2) * 2 + 1, 2) AS b FROM h)
SELECT page_id, url, n::BIGINT AS length, sha256(record) AS digest, CASE WHEN kind < 4 THEN sha256(from_hex(substr(x, 1, (n // 2) * 2) || substr(b, 1, 1) || translate(substr(b, 2, 1), '0123456789ABCDEF', '1032547698BADCFE') || substr(x, (n // 2) * 2 + 3))) END AS copy_digest,
CASE WHEN kind < 4 THEN 'corrupt' ELSE 'missing' END AS status FROM f"""

OP7 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
a AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS key FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT key, min(doc_id) AS first FROM a GROUP BY key), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM a JOIN f ON a.key = f.key WHERE a.doc_id > f.first),
o AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS k FROM d), r AS (SELECT o.doc_id, string_agg(word, ' ' ORDER BY o.k) AS kept, count(*) AS n FROM o LEFT JOIN g ON g.doc_id = o.doc_id AND g.k = o.k WHERE g.k IS NULL GROUP BY o.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""

OP8 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(length(regexp_replace(text, '[\\<\[]', 'xx', 'g')) + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 9 ELSE 22 + length(regexp_replace(role, '[\\<\[]', 'xx', 'g')) END)::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""

OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS e FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
t AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT t.x, l.y FROM t JOIN l ON l.x = t.y), c AS (SELECT x, min(y) AS component FROM t GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.x = d.doc_id"""

OP10 = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), lambda x, y: x + y) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20"""


def op13(rounds: int = 6) -> str:
    steps = ""
    for k in range(rounds + 1):
        steps += f""",
a{k} AS MATERIALIZED (SELECT r, p, x, min(d) AS d, min(e) FILTER (d = least) AS e FROM (SELECT *, min(d) OVER (PARTITION BY r, p) AS least
  FROM (SELECT v.r, v.p, v.x, c.e, list_sum(list_transform(list_zip(v.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v JOIN c{k} c ON c.p = v.p)) GROUP BY r, p, x),
s{k} AS (SELECT p, e, j, sum(y) AS s, count(*)::HUGEINT AS n FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{k}) GROUP BY p, e, j),
m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j)::BIGINT[] AS c FROM s{k} GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.e = c.e)"""
    return f"""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096.0::DOUBLE * x)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id, v) - 1 AS r, len(v) AS n FROM u WHERE len(v) = (SELECT len(v) FROM u ORDER BY vec_id, v LIMIT 1)),
v AS MATERIALIZED (SELECT r, p, v[p * n // 8 + 1 : (p + 1) * n // 8] AS x FROM k, range(8) t(p)), c0 AS MATERIALIZED (SELECT p, r AS e, x AS c FROM v WHERE r < 16){steps},
f AS (SELECT r, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM k JOIN f ON f.r = k.r, h"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": op2(),
        "op4_source_mix": op4(),
        "op5_personal_data": op5(),
        "op6_merkle_fixity": OP6,
        "op7_repeated_substrings": OP7,
        "op8_chat_formatting": OP8,
        "op9_jaccard_join": OP9,
        "op10_nearest_vectors": OP10,
        "op13_vector_codes": op13(),
    }

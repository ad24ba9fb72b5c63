"""The queries of this subpackage in SQL, where SQL can say them. Patterns and parameters are those of the operators;
what is done with them is said anew."""

from __future__ import annotations

from .decontam import WINDOW
from .mixing import REPEATS, SEED
from .neighbours import LEAST_COSINE
from .preference import LEARNED, SEED as PAIR_SEED
from .quality import ENOUGH, FEWEST_LINES, KEPT_BITS, REACH, SLACK
from .resampling import BUCKETS, LEAST_WORDS, SEED as DRAW_SEED, SHARE, UNIT
from .secrets import KINDS, REACH as NEAR, ROLE, WEAK

WORD = r"[^\x20\x09-\x0D]+"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality() -> str:
    rates = {
        "symbol_rate": "CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END",
        "dup_line_rate": f"CASE WHEN n_lines >= {FEWEST_LINES} THEN 1000 * n_dup_lines // n_lines ELSE 0 END",
        "repeat_rate": "CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END",
        "word_length": "CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END",
    }
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS m, {m} AS v FROM r WHERE NOT base_failed" for m in SLACK)
    bins = f"SELECT lang, source, m, v - v % (2 ** greatest(length(bin(v)) - {KEPT_BITS}, 0))::BIGINT AS b FROM long"

    def quartiles(name: str, keys: str) -> str:
        by = f"PARTITION BY {keys + ', ' if keys else ''}m"
        return f"""{name}_c AS (SELECT {keys + ', ' if keys else ''}m, b, count(*) AS n FROM bins GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER ({by} ORDER BY b) AS upto, sum(n) OVER ({by}) AS docs FROM {name}_c),
{name} AS (SELECT {keys + ', ' if keys else ''}m, max(docs) AS docs, min(b) FILTER (WHERE upto * 4 >= docs) AS q1, min(b) FILTER (WHERE upto * 4 >= docs * 3) AS q3 FROM {name}_r GROUP BY ALL)"""

    slack = "CASE f.m " + " ".join(f"WHEN '{m}' THEN {s}" for m, s in SLACK.items()) + " END"
    pick = lambda q: f"CASE WHEN f.docs >= {ENOUGH} THEN f.{q} WHEN l.docs >= {ENOUGH} THEN l.{q} ELSE e.{q} END"
    inside = " AND ".join(f"count(*) FILTER (WHERE t.m = '{m}' AND r.{m} <= t.high AND ('{m}' <> 'word_length' OR r.{m} >= t.low)) > 0" for m in SLACK)
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, lang, source, t, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
s AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS n FROM s),
h AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS p FROM g WHERE n > 1) GROUP BY k),
b AS (SELECT w.k, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words FROM w LEFT JOIN h ON w.k = h.k),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {', '.join(f'({e})::BIGINT AS {m}' for m, e in rates.items())} FROM b),
long AS ({long}), bins AS ({bins}), {quartiles('fine', 'lang, source')}, {quartiles('langs', 'lang')}, {quartiles('every', '')},
t AS (SELECT f.lang, f.source, f.m, {pick('q3')} + {REACH} * ({pick('q3')} - {pick('q1')}) + {slack} AS high, {pick('q1')} - {REACH} * ({pick('q3')} - {pick('q1')}) - {slack} AS low
  FROM fine f JOIN langs l ON f.lang IS NOT DISTINCT FROM l.lang AND f.m = l.m JOIN every e ON f.m = e.m),
j AS (SELECT r.k, {inside} AS ok FROM r LEFT JOIN t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source GROUP BY r.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept FROM r JOIN j USING (k)"""


def secrets() -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    each = []
    for kind, (pattern, group, least, _) in KINDS.items():
        part = "length(p)" if kind != "blob" else "CASE WHEN regexp_matches(p, '[0-9]') AND regexp_matches(p, '[a-z]') AND regexp_matches(p, '[A-Z]') THEN length(p) ELSE -1 END"
        re_ = _q(pattern)
        each.append(
            f"SELECT k, {rank[kind]} AS kind, n, sum(length(g) + length(coalesce(m, ''))) OVER (PARTITION BY k ORDER BY n) AS stop, length(m) AS size FROM "
            f"(SELECT k, unnest(range(1, len(string_split_regex(t, {re_})) + 1)) AS n, unnest(string_split_regex(t, {re_})) AS g, unnest(list_concat(regexp_extract_all(t, {re_}, 0), [NULL])) AS m, unnest(list_concat(regexp_extract_all(t, {re_}, {group}), [NULL])) AS p FROM d) "
            f"QUALIFY m IS NOT NULL AND {part} >= {least}"
        )
    role = lambda c: f"CASE {c} " + " ".join(f"WHEN {rank[k]} THEN '{r}'" for k, r in ROLE.items()) + " END"
    name = lambda c: f"CASE {c} " + " ".join(f"WHEN {i} THEN '{k}'" for k, i in rank.items()) + " END"
    listed = lambda which: f"coalesce(string_agg({name('kind')} || ':' || a || ':' || z, ',' ORDER BY a, kind) FILTER (WHERE {which}), '')"
    first = min(rank[k] for k in WEAK)
    count = lambda k: f"count(*) FILTER (WHERE kind = {rank[k]}) AS n_{k}"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(each)}),
p AS (SELECT k, kind, stop - size AS a, stop AS z FROM s),
n AS (SELECT c.k, c.kind, c.a, c.z, bool_or((p.z <= c.a OR c.z <= p.a) AND {role('p.kind')} = 'ident') AS ident, bool_or((p.z <= c.a OR c.z <= p.a) AND {role('p.kind')} = 'secret') AS secret, bool_or(p.z > c.a AND c.z > p.a AND p.kind < {first}) AS hidden
  FROM p c JOIN p ON c.k = p.k AND p.a - {NEAR} <= c.z AND c.a <= p.z + {NEAR} WHERE c.kind >= {first} GROUP BY ALL),
r AS (SELECT k, kind, a, z FROM p WHERE kind < {first} UNION ALL SELECT k, kind, a, z FROM n WHERE NOT hidden AND CASE kind WHEN {rank['ident']} THEN secret WHEN {rank['blob']} THEN ident ELSE secret AND ident END)
SELECT doc_id, {count('assign')}, {count('access')}, {count('hex')}, sha256({listed(f'kind < {first}')}) AS base_sha256, {listed('kind IS NOT NULL')} AS spans FROM d LEFT JOIN r USING (k) GROUP BY d.k, doc_id"""


def mixing() -> str:
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
v AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
c AS (SELECT *, {REPEATS} * n AS cap, row_number() OVER (ORDER BY {REPEATS} * n / w, source NULLS LAST) AS i FROM v),
f AS (SELECT *, (SELECT sum(n) FROM s) - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tw FROM c),
x AS (SELECT min(i) AS i FROM f WHERE rest::DOUBLE * w / tw <= cap),
t AS (SELECT f.source, f.n, CASE WHEN x.i IS NULL OR f.i < x.i THEN f.cap::DOUBLE ELSE (SELECT rest FROM f g WHERE g.i = x.i)::DOUBLE * f.w / (SELECT tw FROM f g WHERE g.i = x.i) END AS target FROM f, x),
q AS (SELECT *, least(round(target)::BIGINT, {REPEATS} * n) AS q FROM t),
a AS (SELECT d.*, n, target, CASE WHEN n > 0 THEN q // n ELSE 0 END AS whole, CASE WHEN n > 0 THEN q % n ELSE 0 END AS rest FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
p AS MATERIALIZED (SELECT source, o, size, sum(size)::BIGINT AS words, max(rest) AS rest, row_number() OVER (PARTITION BY source ORDER BY o, size) AS i FROM a WHERE size > 0 AND rest > 0 GROUP BY source, o, size),
walk AS (SELECT source, i, o, size, words, words <= rest AS fits, rest - CASE WHEN words <= rest THEN words ELSE 0 END AS gap FROM p WHERE i = 1
  UNION ALL SELECT p.source, p.i, p.o, p.size, p.words, p.words <= w.gap, w.gap - CASE WHEN p.words <= w.gap THEN p.words ELSE 0 END FROM walk w JOIN p ON p.source IS NOT DISTINCT FROM w.source AND p.i = w.i + 1),
g AS (SELECT source, min(gap) AS gap FROM walk GROUP BY source),
e AS (SELECT w.source, min((abs(words - g.gap), o, size)) AS best FROM walk w JOIN g ON w.source IS NOT DISTINCT FROM g.source WHERE NOT fits AND abs(words - g.gap) < g.gap GROUP BY w.source),
r AS (SELECT source, o, size FROM walk WHERE fits UNION ALL SELECT source, best[2], best[3] FROM e)
SELECT doc_id, a.size, n AS source_size, target, (a.size * (whole + CASE WHEN r.o IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken FROM a LEFT JOIN r ON a.source IS NOT DISTINCT FROM r.source AND a.o = r.o AND a.size = r.size"""


def contamination() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    cut = "array_to_string(w[i:i + n - 1], ' ')"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark),
q AS (SELECT DISTINCT item, n, {cut} AS s FROM (SELECT item, w, least({WINDOW}, len(w)) AS n, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT k, i, n, {cut} AS s FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
h AS (SELECT k, i, n, item FROM p JOIN q USING (n, s)),
m AS (SELECT k, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY k),
x AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT k, i, n FROM h)) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN m USING (k) LEFT JOIN x USING (k)"""


def warc() -> str:
    digit = "(('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31"
    return f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({digit}) + 1)::BIGINT, 1)), '') AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def preference() -> str:
    safe = lambda c: f"replace(coalesce({c}, ''), '<|', '< |')"
    turn = lambda t: f"('<|' || {safe(t + '.role')} || '|>' || chr(10) || {safe(t + '.text')} || '<|end|>' || chr(10))"
    told = lambda x: f"array_to_string(list_transform({x}, lambda t: {turn('t')}), '')"
    head = lambda t: f"(length({safe(t + '.role')}) + 5)"
    before = lambda x: f"coalesce(list_sum(list_transform({x}[1:j - 1], lambda u: length({turn('u')}))), 0)::BIGINT"

    def mask(x: str) -> str:
        one = f"({before(x)} + {head(f'{x}[j]')}) || ':' || ({before(x)} + length({turn(f'{x}[j]')}))"
        return f"array_to_string(list_transform(list_filter(range(1, len({x}) + 1), lambda j: {x}[j].role = 'assistant'), lambda j: {one}), ',')"

    side = lambda n: f"coalesce(list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (WHERE conv_id & 1 = {n}), [])"
    return f"""WITH p AS (SELECT (conv_id - (conv_id & 1)) // 2 AS pair, min(conv_id) FILTER (WHERE conv_id & 1 = 0) AS chosen_id, min(conv_id) FILTER (WHERE conv_id & 1 = 1) AS rejected_id, {side(0)} AS a, {side(1)} AS b FROM conversations GROUP BY 1),
z AS (SELECT chosen_id AS id, rejected_id AS other, a AS t, b AS o FROM p WHERE chosen_id IS NOT NULL UNION ALL SELECT rejected_id, chosen_id, b, a FROM p WHERE rejected_id IS NOT NULL),
y AS (SELECT *, list_filter(range(2, len(t) + 1), lambda i: t[i].role = '{LEARNED}') AS places, list_filter(o, lambda x: x.role = '{LEARNED}') AS replies FROM z),
x AS (SELECT *, CASE WHEN len(places) > 0 THEN places[('0x' || substr(md5('{PAIR_SEED}|' || id), 1, 8))::BIGINT % len(places) + 1] ELSE 2 END AS cut FROM y),
n AS (SELECT id AS pair_id, id AS chosen_id, other AS rejected_id, t AS a, t[1:cut - 1] || replies[-1:] AS b FROM x),
k AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda j: a[j].role IS DISTINCT FROM b[j].role OR a[j].text IS DISTINCT FROM b[j].text)) - 1, least(len(a), len(b))) AS n FROM n),
s AS (SELECT pair_id, chosen_id, rejected_id, a[1:n] AS p, a[n + 1:] AS c, b[n + 1:] AS r, len(a) = 0 AS no_c, len(b) = 0 AS no_r FROM k)
SELECT pair_id, chosen_id, rejected_id, len(p)::BIGINT AS prompt_turns, len(c)::BIGINT AS chosen_turns, len(r)::BIGINT AS rejected_turns, sha256({told('p')}) AS prompt_sha256, CASE WHEN NOT no_c THEN sha256({told('c')}) END AS chosen_sha256, CASE WHEN NOT no_r THEN sha256({told('r')}) END AS rejected_sha256,
CASE WHEN NOT no_c THEN {mask('c')} END AS chosen_mask, CASE WHEN NOT no_r THEN {mask('r')} END AS rejected_mask FROM s"""


def near_vectors() -> str:
    return f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM g a JOIN g b ON a.label = b.label AND a.k <> b.k WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= {LEAST_COSINE}),
r AS (SELECT a AS k, b FROM l UNION SELECT r.k, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT r.k, min(g.vec_id) AS c FROM r JOIN g ON g.k = r.b GROUP BY r.k), n AS (SELECT a AS k, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, c) AS component_id, vec_id IS NOT DISTINCT FROM least(vec_id, c) AS kept FROM v LEFT JOIN n USING (k) LEFT JOIN c USING (k)"""


def resampled() -> str:
    """The checksum by its definition: a table of 256 remainders, and one step a byte."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = lambda w: f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    step = "xor(e.t[xor(a, b) % 256 + 1], a // 256)"
    byte = "list_transform(range(0, length(hex(encode(f))) // 2), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)"
    return f"""WITH RECURSIVE q AS (SELECT range AS i, range AS c, 0 AS n FROM range(256) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n + 1 FROM q WHERE n < 8),
e AS (SELECT list(c ORDER BY i) AS t FROM q WHERE n = 8),
d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS w FROM documents), o AS (SELECT {words} AS w FROM benchmark),
df AS (SELECT k, f, count(*) AS n FROM (SELECT k, unnest({runs('w')}) AS f FROM d) GROUP BY 1, 2), tf AS (SELECT f, count(*) AS n FROM (SELECT unnest({runs('w')}) AS f FROM o) GROUP BY 1),
h AS (SELECT f, xor(list_reduce({byte}, lambda a, b: {step}, 4294967295), 4294967295) % {BUCKETS} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM tf), e),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM df JOIN h USING (f) GROUP BY 1), t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM tf JOIN h USING (f) GROUP BY 1),
g AS (SELECT range AS bucket, floor({UNIT} * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS}) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS}))))::BIGINT AS gain FROM range({BUCKETS}) LEFT JOIN s ON s.bucket = range LEFT JOIN t ON t.bucket = range),
m AS (SELECT k, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS g FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY 1),
u AS (SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight, ('0x' || substr(sha256('{DRAW_SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS x FROM d LEFT JOIN m USING (k)),
y AS (SELECT *, weight + floor(-{UNIT} * ln(-ln((x + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM u),
z AS (SELECT *, row_number() OVER (PARTITION BY words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY words >= {LEAST_WORDS}) AS able FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {LEAST_WORDS} AND place <= able * {SHARE} // 100 THEN place END AS rank FROM z"""


def every() -> dict[str, str]:
    """By query. The others have no SQL: a network, XXH64 fingerprints, eigenvectors, keyed permutations and files cannot be said in it."""
    return {
        "op1_quality_rules": quality(),
        "op2_secret_scan": secrets(),
        "op6_source_mixing": mixing(),
        "op7_decontamination": contamination(),
        "op9_warc_transactions": warc(),
        "op10_preference_pairs": preference(),
        "op11_embedding_dedup": near_vectors(),
        "op13_importance_resampling": resampled(),
    }

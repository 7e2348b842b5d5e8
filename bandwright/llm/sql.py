"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from bandwright.llm import op2_secrets, op4_lines, op5_mix, op7_quality, op11_trie, op12_repeats, op13_resample


def _secrets() -> str:
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(op2_secrets.RULES):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"""
    SELECT doc_id, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{
             'start': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0),
             'size': length(hits[i]), 'own': length(owns[i])}})) AS s, {rank} AS rank, '{kind}' AS kind, {least} AS least
    FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, {group}) AS owns, string_split_regex(t, {p}) AS gaps FROM d)"""
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
spans AS (SELECT doc_id, rank, kind, CAST(s.start AS BIGINT) AS a, kind || ':' || CAST(CAST(s.start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s.start + s.size AS BIGINT) AS VARCHAR) AS label
          FROM found WHERE s.own >= least),
per AS (SELECT doc_id,
          count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
          coalesce(string_agg(label, ',' ORDER BY a, rank) FILTER (WHERE rank < {op2_secrets.BASE_KINDS}), '') AS base,
          string_agg(label, ',' ORDER BY a, rank) AS spans
        FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)"""


CRC_TABLE = "SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i)"


def _crc32(x: str) -> str:
    """The unsigned CRC-32 of a text's bytes; the table of 256 states is in scope as ``crc``."""
    pairs = f"list_transform(range(1, strlen({x}) + 1), lambda i: CAST('0x' || substr(hex({x}), 2 * i - 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {pairs}), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)"


def _resample() -> str:
    n, word = op13_resample.BUCKETS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH table_of AS MATERIALIZED ({CRC_TABLE}),
words AS MATERIALIZED (SELECT doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
wanted AS MATERIALIZED (SELECT regexp_extract_all({lower}, '{word}') AS w FROM benchmark),
counts AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words) GROUP BY doc_id, f),
targets AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM wanted) GROUP BY f),
known AS MATERIALIZED (SELECT f, {_crc32("f")} % {n} AS bucket FROM (SELECT f FROM counts UNION SELECT f FROM targets), table_of),
s AS (SELECT bucket, sum(n)::BIGINT AS n FROM counts JOIN known USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS n FROM targets JOIN known USING (f) GROUP BY bucket),
gains AS (SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {n})::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {n})::DOUBLE)))::BIGINT AS gain
          FROM (SELECT unnest(range({n})) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
sums AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM counts JOIN known USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) >= {op13_resample.MIN_WORDS} AS enough, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
                  floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
           FROM words LEFT JOIN sums USING (doc_id)),
placed AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY enough ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER (PARTITION BY enough) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= n * {op13_resample.PERCENT} // 100 THEN place END AS rank FROM placed"""


def _trie() -> str:
    return f"""
WITH table_of AS MATERIALIZED ({CRC_TABLE}),
own AS (SELECT conv_id AS c, list({{'e': md5(strlen(role) || ':' || role || text), 'n': length(text)}} ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS t
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations) WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT c, c::VARCHAR AS s, t FROM own),
hashed AS (SELECT heads.c, t, {_crc32("s")} % {op11_trie.HEADS} AS h FROM heads, table_of),
conv AS MATERIALIZED (SELECT a.c, coalesce(b.t[1:a.h], []) || a.t[a.h + 1:] AS t FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % {op11_trie.FAMILY}),
pre AS (SELECT c, t, unnest(range(len(t) + 1)) AS d FROM conv),
keyed AS MATERIALIZED (SELECT c, d, len(t) = d AS ends, coalesce(array_to_string(list_transform(t[1:d], lambda x: x.e), ''), '') AS k, coalesce(t[d].n, 0) AS size FROM pre),
nodes AS MATERIALIZED (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, min(size) AS size, coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends FROM keyed GROUP BY d, k),
kids AS MATERIALIZED (SELECT a.d, a.k, a.conv_id, a.n_convs, a.ends, count(b.k) AS n_children, (a.n_convs - 1) * a.size AS saved
         FROM nodes a LEFT JOIN nodes b ON b.d = a.d + 1 AND substr(b.k, 1, 32 * a.d) = a.k GROUP BY ALL),
subs AS (SELECT up AS d, substr(k, 1, 32 * up) AS k, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT k, n_children, saved, unnest(range(d + 1)) AS up FROM kids) GROUP BY ALL)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM kids x JOIN subs s ON s.d = x.d AND s.k = x.k LEFT JOIN kids p ON p.d = x.d - 1 AND p.k = substr(x.k, 1, 32 * (x.d - 1))"""


def _repeats() -> str:
    """Every window of the UTF-8 bytes as hexadecimal digits."""
    w = op12_repeats.WIDTH
    cut = "CASE WHEN i = 0 THEN 0 ELSE cut.b[i] END"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
windows AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * w}) AS w FROM (SELECT doc_id, h, unnest(range(n - {w - 1})) AS p FROM d WHERE n >= {w})),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
gone AS (SELECT doc_id, p FROM windows JOIN firsts USING (w) WHERE first < doc_id),
runs AS (SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), {-w - 1}) > {w} AS starts FROM gone),
spans AS (SELECT doc_id, min(p) AS a, max(p) + {w} AS b FROM (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM runs) GROUP BY doc_id, k),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM spans GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, n_spans + 1), lambda i: substr(h, 2 * {cut} + 1, 2 * (CASE WHEN i = n_spans THEN n ELSE cut.a[i + 1] END - {cut}))), '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""


def _mod(x: str, n: str | int) -> str:
    return f"((({x}) % {n} + {n}) % {n})"


def _hash(x: str, a: int, b: int, c: int) -> str:
    p = op5_mix.PRIME
    y = _mod(x, p)
    return f"(((({y} * {y}) % {p}) * {a} % {p} + ({y} * {b}) % {p} + {c}) % {p})"


def _permuted(x: str, n: str, source: str, turn: str, inverse: bool = False) -> str:
    key = f"({_hash(f'{source} * 7919 + {turn} * 104729 + r * 1299709', 40692, 52774, 29)} % {n})"
    other = _mod(f"{key} - x", n)
    bit = f"{_hash(f'greatest(x, {other}) + r * 15485863', 45991, 22695, 17)} >= {op5_mix.PRIME // 2}"
    rounds = ", ".join(f"{r}::BIGINT" for r in (reversed(range(op5_mix.ROUNDS)) if inverse else range(op5_mix.ROUNDS)))
    return f"list_reduce([{rounds}], lambda x, r: CASE WHEN {bit} THEN {other} ELSE x END, ({x})::BIGINT)"


def _mix() -> str:
    b, p, k = op5_mix.BLOCK, op5_mix.PRIME, op5_mix.REPEATS
    some = f"((rest + {b - 1}) // {b})"
    return f"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{op5_mix.WORD}')), 0) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [{", ".join(map(str, op5_mix.WEIGHTS))}][rank % {len(op5_mix.WEIGHTS)} + 1] AS weight FROM sums),
levels AS (SELECT *, (sum(source_size) OVER () * {op5_mix.SHARE}::DOUBLE - coalesce(sum(source_size * {k}) OVER (ORDER BY source_size * {k} / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / (sum(weight) OVER (ORDER BY source_size * {k} / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
sources AS (SELECT source, rank, source_size, least((source_size * {k})::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
plan0 AS (SELECT *, (source_size + {b - 1}) // {b} AS n, (source_size - 1) % {b} + 1 AS last, least(CAST(floor(target + 0.5) AS BIGINT), {k} * source_size) AS words FROM sources WHERE source_size > 0),
plan1 AS (SELECT *, words // source_size AS passes, words % source_size AS rest FROM plan0),
plan2 AS (SELECT *, {_permuted("n - 1", "n", "rank", "passes", True)} AS short_at FROM plan1),
plan AS (SELECT *, passes * n + CASE WHEN short_at >= {some} THEN {some} ELSE (rest + {b} - last + {b - 1}) // {b} END AS slots FROM plan2),
seats AS (SELECT *, j // n AS turn, j % n AS q FROM (SELECT *, unnest(range(slots)) AS j FROM plan)),
seated AS (SELECT rank, n, last, passes, rest, short_at, turn, q, {_permuted("q", "n", "rank", "turn")} AS block FROM seats),
slots AS (SELECT rank, block, CASE WHEN turn < passes THEN full_words ELSE least(full_words, rest - (q * {b} - CASE WHEN q > short_at THEN {b} - last ELSE 0 END)) END AS words
          FROM (SELECT *, CASE WHEN block = n - 1 THEN last ELSE {b} END AS full_words FROM seated)),
placed AS (SELECT d.doc_id, d.size, s.rank, s.source_size, s.target, {_hash("coalesce(doc_id, -1)", *op5_mix.ORDER_KEY)} AS k FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
streams AS (SELECT *, row_number() OVER () AS id, CAST(coalesce(sum(size) OVER (PARTITION BY rank ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM placed),
pieces AS (SELECT id, rank, block, greatest(start - block * {b}, 0) AS low, least(start + size - block * {b}, {b}) AS high
           FROM (SELECT *, unnest(range(start // {b}, (start + size - 1) // {b} + 1)) AS block FROM streams WHERE size > 0)),
took AS (SELECT id, CAST(sum(greatest(least(words, high) - low, 0)) AS BIGINT) AS taken FROM pieces JOIN slots USING (rank, block) GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM streams LEFT JOIN took USING (id)"""


def _near_duplicates() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || chr(10) || ws[i + 1]) END) AS g FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM reach r JOIN edges e ON r.y = e.a),
found AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM found LEFT JOIN sizes USING (doc_id)"""


def _lines() -> str:
    least = op4_lines.MIN_CHARS
    return f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS s FROM split),
own AS (SELECT *, doc_id * 1000000 + line AS place FROM lines WHERE length(s) >= {least} AND regexp_matches(s, '[0-9A-Za-z]|[^\\x00-\\x7F]')),
distinct_lines AS (SELECT s, min(place) AS first FROM own GROUP BY s),
cut AS (SELECT s, first, substr(s, 1, i - 1) AS a, substr(s, i + 1) AS b FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM distinct_lines)),
keyed AS (SELECT s, first, md5(a || chr(1) || b) AS changed, md5(a || b) AS gone FROM cut),
near AS (SELECT x.s, y.first FROM keyed x JOIN keyed y ON x.changed = y.changed AND x.s <> y.s
         UNION ALL SELECT x.s, y.first FROM keyed x JOIN distinct_lines y ON x.gone = md5(y.s)
         UNION ALL SELECT y.s, x.first FROM keyed x JOIN distinct_lines y ON x.gone = md5(y.s)),
earliest AS (SELECT s, min(first) AS place FROM (SELECT s, first FROM distinct_lines UNION ALL SELECT s, first FROM near) GROUP BY s),
gone AS (SELECT o.doc_id, o.line, e.place FROM own o JOIN earliest e ON o.s = e.s AND e.place < o.place),
kept AS (SELECT l.doc_id, string_agg(l.s, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL) AS text, count(*) AS n_lines, count(g.line) AS n_dropped,
         string_agg(g.line || ':' || g.place // 1000000 || ':' || g.place % 1000000, ',' ORDER BY l.line) FILTER (WHERE g.line IS NOT NULL) AS dropped
         FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)"""


def _quality() -> str:
    q = op7_quality
    classes = ("[a-z]", "[A-Z]", "[0-9]", "[\\x09-\\x0D\\x1C-\\x1F ]", "[.,;:!?'\"()\\-]", "[#*$%&|<>]", None, "[^\\x00-\\x7F]")
    counted = [f"length(t) - length(regexp_replace(t, '{c.replace(chr(39), chr(39) * 2)}', '', 'g'))" if c else "0" for c in classes]
    mark = "[.,;:!?\"''()]{0,2}"
    words = ", ".join("'" + w + "'" for w in q.WORDS)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def far(bins: str) -> str:
        """Distance of each document from the nearest language for (doc_id, bin, n) rows."""
        return f"""(SELECT doc_id, min(sqrt(greatest(0, least(1, js)))) AS far, any_value(total) AS total FROM (
            SELECT g.doc_id, l.lang, any_value(t.total) AS total, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + r) / 2)) ELSE 0 END + CASE WHEN r > 0 THEN r * log2(r / ((p + r) / 2)) ELSE 0 END) / 2 AS js
            FROM (SELECT doc_id, bin FROM (SELECT DISTINCT doc_id FROM d) CROSS JOIN (SELECT DISTINCT bin FROM {bins})) g
            JOIN (SELECT doc_id, sum(n) AS total FROM {bins} GROUP BY 1) t ON g.doc_id = t.doc_id
            CROSS JOIN (SELECT DISTINCT lang FROM d WHERE lang IS NOT NULL) l
            LEFT JOIN (SELECT doc_id, bin, n AS own FROM {bins}) b ON b.doc_id = g.doc_id AND b.bin = g.bin
            LEFT JOIN (SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS share FROM {bins} JOIN d USING (doc_id) WHERE lang IS NOT NULL GROUP BY lang, bin) x ON x.lang = l.lang AND x.bin = g.bin,
            LATERAL (SELECT coalesce(own, 0) / greatest(t.total, 1)::DOUBLE AS p, coalesce(share, 0)::DOUBLE AS r)
            GROUP BY g.doc_id, l.lang) GROUP BY doc_id)"""

    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, lang, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
base AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, {counted[5]} AS n_symbols FROM w),
dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 7], chr(10))) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
again AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1) GROUP BY doc_id),
shapes AS (SELECT doc_id, length(t) AS n, [{", ".join(counted)}] AS cs FROM d),
chars AS (SELECT doc_id, unnest(range(8)) AS bin, unnest(list_transform(range(1, 9), lambda i: CASE WHEN i = 7 THEN n - list_sum(cs) ELSE cs[i] END)) AS n FROM shapes),
bare AS (SELECT doc_id, regexp_replace(regexp_replace(translate(x, '{upper}', '{lower}'), '^{mark}', ''), '{mark}$', '') AS x FROM (SELECT doc_id, unnest(ws) AS x FROM w)),
commons AS (SELECT doc_id, coalesce(list_position([{words}], x), 0) AS bin, count(*) AS n FROM bare GROUP BY 1, 2),
fc AS {far("chars")},
fw AS {far("commons")},
found AS (SELECT b.*, coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CASE WHEN coalesce(fc.total, 0) < {q.MIN_CHARS_JSD} THEN 0.0 ELSE round(fc.far, 6) END AS char_distance,
    CASE WHEN coalesce(fw.total, 0) < {q.MIN_WORDS_JSD} THEN 0.0 ELSE round(fw.far, 6) END AS word_distance
    FROM base b LEFT JOIN dups USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN fc USING (doc_id) LEFT JOIN fw USING (doc_id))
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
    NOT failed AND char_distance <= {q.MAX_CHAR_DISTANCE} AND word_distance <= {q.MAX_WORD_DISTANCE} AS kept, CAST(char_distance AS DOUBLE) AS char_distance, CAST(word_distance AS DOUBLE) AS word_distance
FROM (SELECT *, n_words < {q.MIN_WORDS} OR n_repeat_words * 100 > n_words * {q.MAX_REPEATED_PERCENT} AS failed FROM found)"""


ORACLES: dict[str, str] = {"op2_secret_scan": _secrets(), "op4_line_dedup": _lines(), "op5_source_mix": _mix(), "op7_quality_rules": _quality(), "op9_minhash_neardup": _near_duplicates(), "op11_prefix_trie": _trie(), "op12_repeated_bytes": _repeats(), "op13_importance_resample": _resample()}

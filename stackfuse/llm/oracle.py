"""SQL (DuckDB) of the llm queries that SQL can express, written from their contracts over whole tables.

Edit distances and networks are beyond it: the tests hold those
queries against brute force, the tokenizer library and held-out accuracy.
"""

from __future__ import annotations

import importlib.util

from . import common as C
from . import chunks, packing, secrets, syncmers

LATE = 2**63 - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _either_case(text: str) -> str:
    """A pattern's letters in either case, A-Z alone (case folding of the engine would take other letters too)."""
    return "".join(f"[{c.upper()}{c}]" if c in LOWER else c for c in text)


def _spans() -> str:
    """Leftmost non-overlapping matches of each kind: a text is cut at its matches, and the places are summed up."""
    parts = []
    for k, rule in enumerate(secrets.RULES):
        pattern, body = rule.pattern, "m"
        if rule.kind == "assign":
            head, brace, rest = pattern.partition(")")
            pattern = _either_case(head) + brace + rest
            check = f"length(regexp_extract(m, {_quoted('^' + pattern)}, 2)) >= {rule.least}"
        elif rule.kind == "pem":
            # the engine has no look-ahead: what must follow a short last line is matched, and left out of the span
            pattern = f"{secrets.PEM_HEAD}{secrets.PEM_WHOLE}|({secrets.PEM_HEAD}{secrets.PEM_FIELDS}{secrets.PEM_LINES}{secrets.PEM_TAIL})(?:[\\x09-\\x0d \\\\\"']|\\z)|{secrets.PEM_HEAD}{secrets.PEM_FIELDS}(?:{secrets.PEM_LINES})?"
            check = "true"
            body = f"coalesce(nullif(regexp_extract(m, {_quoted(pattern)}, 1), ''), m)"
        else:
            check = f"length(m) >= {rule.least}"
        q = _quoted(pattern)
        parts.append(f"""SELECT r, {k} AS k, '{rule.kind}' AS kind, {'true' if rule.base else 'false'} AS base, a, a + length({body}) AS b FROM (
 SELECT r, m, CAST(sum(length(p) + length(m)) OVER (PARTITION BY r ORDER BY i) - length(m) AS BIGINT) AS a FROM (
  SELECT r, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, generate_subscripts(ms, 1) AS i FROM (
   SELECT r, regexp_extract_all(t, {q}) AS ms, string_split_regex(t, {q}) AS ps FROM d WHERE regexp_matches(t, {q})))) WHERE {check}""")
    return "\nUNION ALL\n".join(parts)


SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
s AS ({_spans()}),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (base) AS own, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)"""

NIBBLES = "".join(f"{i:04b}" for i in range(16))
BITS = f"array_to_string(list_transform(range(1, 41), lambda j: substr('{NIBBLES}', 4 * (strpos('0123456789abcdef', substr(h, CAST(j AS INT), 1)) - 1) + 1, 4)), '')"
FIVE = " + ".join(f"{16 >> j} * CAST(substr(bits, CAST(5 * j5 + {j + 1} AS INT), 1) AS INT)" for j in range(5))
ARCHIVES = f"""WITH p AS (SELECT page_id, coalesce(page_id, {LATE}) AS pos, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, pos, strlen(html) AS payload_bytes, sha1(html) AS h, min(pos) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, {BITS} AS bits FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda j5: substr('{UPPER}234567', 1 + {FIVE}, 1)), '') AS payload_digest,
 CASE WHEN pos = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN pos > first THEN first END AS refers_to FROM b"""

REPEATS = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, u AS base, substr(x, CAST(2 * u + 1 AS BIGINT), 2 * (512 + 99)) AS piece FROM (SELECT doc_id, x, unnest(range(0, greatest(0, CAST(length(x) AS BIGINT) // 2 - 99), 512)) AS u FROM t)),
w AS (SELECT doc_id, base + j AS p, md5(substr(piece, CAST(2 * j + 1 AS BIGINT), 200)) AS h FROM (SELECT doc_id, base, piece, unnest(range(0, least(512, CAST(length(piece) AS BIGINT) // 2 - 99))) AS j FROM c)),
f AS (SELECT h, min((doc_id, p)) AS first FROM w GROUP BY h HAVING count(*) > 1),
g AS (SELECT doc_id, p FROM w JOIN f USING (h) WHERE (doc_id, p) > first),
n AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS opens FROM g),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM n) GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS back FROM s),
z AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS stop, string_agg(substr(x, CAST(2 * back + 1 AS BIGINT), CAST(2 * (a - back) AS BIGINT)), '' ORDER BY a) AS head FROM k JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(coalesce(head, '') || substr(x, CAST(2 * coalesce(stop, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM t LEFT JOIN z USING (doc_id)"""



def _cut_out(spans: str, where: str) -> str:
    """CTEs and query that cut intervals (doc_id, a, b) out of the texts t (doc_id, x: bytes in hex)."""
    return f"""n AS (SELECT doc_id, a, b, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM {spans}),
s AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT doc_id, a, b, sum(opens) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM n) GROUP BY doc_id, run HAVING {where}),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS back FROM s),
z AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS stop, string_agg(substr(x, CAST(2 * back + 1 AS BIGINT), CAST(2 * (a - back) AS BIGINT)), '' ORDER BY a) AS head FROM k JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(coalesce(head, '') || substr(x, CAST(2 * coalesce(stop, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM t LEFT JOIN z USING (doc_id)"""


def passages() -> str:
    """Seeds where the gear hash is least in some window; those that repeat grow against the first; long runs go."""
    gram, spread = chunks.GRAM, chunks.SPREAD
    codes = ", ".join(str(int(g)) for g in chunks.GEAR)
    rolled = " + ".join(f"((lag(g, {j}) OVER w << {j}) & 4294967295)" if j else "g" for j in range(gram))
    one = "substr({t}, CAST(2 * ({at}) + 1 AS BIGINT), 2)"
    other = lambda side: f"list_position(list_transform(range(1, {side}_most + 1), lambda j: {{0}} <> {{1}}), true)"
    left = other("left").format(one.format(t="lx", at="left_most - j"), one.format(t="ly", at="left_most - j"))
    right = other("right").format(one.format(t="rx", at="j - 1"), one.format(t="ry", at="j - 1"))
    cut = lambda x, at, n: f"substr({x}, CAST(2 * ({at}) + 1 AS BIGINT), CAST(2 * ({n}) AS BIGINT))"
    return f"""WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
byte AS (SELECT doc_id, unnest(l) AS b, generate_subscripts(l, 1) - 1 AS p FROM (SELECT doc_id, regexp_extract_all(x, '..') AS l FROM t)),
code AS (SELECT doc_id, p, CAST([{codes}][1 + CAST('0x' || b AS INT)] AS BIGINT) AS g FROM byte),
hash AS (SELECT doc_id, p - {gram - 1} AS s, ({rolled}) & 4294967295 AS h FROM code WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
least AS (SELECT doc_id, min(h::UBIGINT * 4294967296 + s::UBIGINT) OVER w AS m, count(*) OVER w AS n FROM hash WHERE s >= 0 WINDOW w AS (PARTITION BY doc_id ORDER BY s ROWS BETWEEN CURRENT ROW AND {spread - 1} FOLLOWING)),
seed AS (SELECT DISTINCT doc_id, CAST(m % 4294967296 AS BIGINT) AS s FROM least WHERE n = {spread}),
named AS (SELECT doc_id, s, {cut('x', 's', gram)} AS key FROM seed JOIN t USING (doc_id)),
first AS (SELECT key, min((doc_id, s)) AS f FROM named GROUP BY key HAVING count(*) > 1),
pair AS (SELECT n.doc_id, n.s, f.f[1] AS d0, f.f[2] AS s0 FROM named n JOIN first f USING (key) WHERE (n.doc_id, n.s) > f.f),
room AS (SELECT pair.*, t.x AS x, u.x AS y, least({spread}, s, s0) AS left_most, least({spread}, length(t.x) // 2 - s - {gram}, length(u.x) // 2 - s0 - {gram}) AS right_most FROM pair JOIN t USING (doc_id) JOIN t u ON u.doc_id = d0),
side AS (SELECT doc_id, s, left_most, right_most, {cut('x', 's - left_most', 'left_most')} AS lx, {cut('y', 's0 - left_most', 'left_most')} AS ly, {cut('x', f's + {gram}', 'right_most')} AS rx, {cut('y', f's0 + {gram}', 'right_most')} AS ry FROM room),
grown AS (SELECT doc_id, s - coalesce(nullif({left}, 0) - 1, left_most) AS a, s + {gram} + coalesce(nullif({right}, 0) - 1, right_most) AS b FROM side),
{_cut_out('grown', f'max(b) - min(a) >= {chunks.LEAST}')}"""


SIMILAR = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, CAST(len(w) AS BIGINT)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM d),
k AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k FROM s),
node AS (SELECT k, min(doc_id) AS node, any_value(n) AS n FROM k WHERE n > 0 GROUP BY k),
e AS (SELECT node, n, unnest(s) AS g FROM k JOIN node USING (k, n) WHERE doc_id = node),
pair AS (SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
 GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT node, node AS other FROM node UNION SELECT r.node, l.b FROM reach r JOIN link l ON r.other = l.a),
least_of AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM k LEFT JOIN node USING (k) LEFT JOIN least_of ON least_of.node = node.node"""

# ---- fingerprints: arithmetic modulo 2^64 in 128-bit numbers

WORD = "18446744073709551615::UHUGEINT"  # a mask, as remainders of 128-bit numbers are slow


def _times(a: str, b: int) -> str:
    return f"((({a}) * {b % 2**64}::UHUGEINT) & {WORD})"


def _mixed(a: str) -> str:
    """The finaliser of 64-bit hashes."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        a = f"({_times(f'xor({a}, ({a}) >> 33)', factor)})"
    return f"xor({a}, ({a}) >> 33)"


def _gram(k: int) -> str:
    """The polynomial of the k codes from a place on."""
    terms = [_times(f"lead(c, {j}) OVER w" if j else "c", pow(C.BASE, k - 1 - j, 2**64)) for j in range(k)]
    return f"({' + '.join(terms)}) & {WORD}"


def _anchored(name: str, where: str, k: int, s: int) -> str:
    """Closed syncmers of the texts that a condition names: id, place, hash."""
    return f"""{name}_gram AS (SELECT id, p, n, {_gram(s)} AS sg, {_gram(k)} AS kg FROM codes WHERE {where} WINDOW w AS (PARTITION BY id ORDER BY p)),
{name}_hash AS (SELECT id, p, n, {_mixed('sg')} AS sg, ({_mixed('kg')}) // 4294967296 AS h FROM {name}_gram WHERE p + {s} <= n),
{name}_least AS (SELECT id, p, n, h, sg, lead(sg, {k - s}) OVER w AS far, min(sg) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN CURRENT ROW AND {k - s} FOLLOWING) AS least FROM {name}_hash WINDOW w AS (PARTITION BY id ORDER BY p)),
{name} AS (SELECT id, p, CAST(h AS BIGINT) AS h FROM {name}_least WHERE p + {k} <= n AND (least = sg OR least = far))"""


def _likeness(b: str) -> str:
    """Of lists of hashes and places (ah, ap) and others: the longest chain in both, against the least hashes of both."""
    place = f"{b}p[list_position({b}h, ah[i])]"
    chain = f"list_transform(list_filter(range(1, CAST(len(ah) AS BIGINT) + 1), lambda i: ah[i] <= top_{b} AND list_position({b}h, ah[i]) > 0), lambda i: [{place}])"
    put = "acc[1:len(list_filter(acc, lambda y: y < q[1]))] || q || acc[len(list_filter(acc, lambda y: y < q[1])) + 2:]"
    return f"CASE WHEN af = {b}f THEN 1.0::DOUBLE WHEN len(ah) = 0 OR len({b}h) = 0 THEN 0.0::DOUBLE ELSE len(list_reduce({chain}, lambda acc, q: {put}, CAST([] AS BIGINT[]))) / CAST(len_{b} AS DOUBLE) END"


FINGERPRINTS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY coalesce(doc_id, -9223372036854775808) DESC, coalesce(text, '') DESC) AS r FROM documents),
nx AS (SELECT d.doc_id, d.r, d.t, u.t AS u, u.r AS ur FROM d JOIN d u ON u.r = CASE WHEN d.r = (SELECT max(r) FROM d) THEN 1 ELSE d.r + 1 END),
x AS (SELECT 2 * r AS id, t FROM d UNION ALL SELECT 2 * r + 1, left(t, length(t) - length(t) // 3) || left(u, length(t) // 3) FROM nx),
chars AS (SELECT id, n, unnest(l) AS ch, generate_subscripts(l, 1) - 1 AS p FROM (SELECT id, length(t) AS n, regexp_extract_all(t, '(?s).') AS l FROM x WHERE t <> '')),
raw AS (SELECT id, n, p, (unicode(ch)::UHUGEINT + {0x9E3779B97F4A7C15}::UHUGEINT) & {WORD} AS c FROM chars),
codes AS (SELECT id, n, p, {_mixed('c')} AS c FROM raw),
{_anchored('longs', f'n >= {3 * syncmers.K}', syncmers.K, syncmers.S)},
{_anchored('shorts', f'n < {3 * syncmers.K}', *syncmers.SHORT)},
firsts AS (SELECT id, h, min(p) AS p FROM (SELECT * FROM longs UNION ALL SELECT * FROM shorts) GROUP BY id, h),
best AS (SELECT id, h, p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h) AS k FROM firsts) WHERE k <= {syncmers.SIZE}),
alone AS (SELECT id, CAST('0x' || substr(sha256(t), 1, 8) AS BIGINT) AS h, CAST(0 AS BIGINT) AS p FROM x WHERE t <> '' AND id NOT IN (SELECT id FROM best)),
f AS (SELECT x.id, coalesce(list(h ORDER BY p) FILTER (h IS NOT NULL), []) AS h, coalesce(list(p ORDER BY p) FILTER (h IS NOT NULL), []) AS p, coalesce(string_agg(printf('%08x@%x', h, p), ',' ORDER BY p), '') AS f
 FROM x LEFT JOIN (SELECT id, h, p FROM best UNION ALL SELECT id, h, p FROM alone) z ON x.id = z.id GROUP BY x.id),
j AS (SELECT nx.doc_id, length(nx.t) AS n_chars, sha256(e.t) AS edited_sha256, a.h AS ah, a.p AS ap, a.f AS af, b.h AS bh, b.p AS bp, b.f AS bf, c.h AS ch, c.p AS cp, c.f AS cf,
 list_sort(list_distinct(a.h || b.h))[1:{syncmers.SIZE}] AS lb, list_sort(list_distinct(a.h || c.h))[1:{syncmers.SIZE}] AS lc
 FROM nx JOIN x e ON e.id = 2 * nx.r + 1 JOIN f a ON a.id = 2 * nx.r JOIN f b ON b.id = 2 * nx.r + 1 JOIN f c ON c.id = 2 * nx.ur),
k AS (SELECT *, lb[len(lb)] AS top_b, len(lb) AS len_b, lc[len(lc)] AS top_c, len(lc) AS len_c FROM j)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, edited_sha256, af AS fingerprint, bf AS edited_fingerprint, {_likeness('b')} AS near_edited, {_likeness('c')} AS near_next, CAST(len(ah) AS INT) AS n_anchors FROM k"""

# ---- token counts: pre-tokens by a pattern, pieces by merging the pair of least rank until none is left

BLANK = "\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
PRETOKEN = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{BLANK}\\p{{L}}\\p{{N}}]+|[{BLANK}]+"
#: Put before the last of several blanks that a word follows, as the engine has no look-ahead.
SPLIT = "chr(1) || '|split|' || chr(2)"


def _shown() -> str:
    """The characters that stand for bytes in the vocabulary, with the bytes in hex."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    pairs = [(chr(b), b) for b in plain] + [(chr(256 + i), b) for i, b in enumerate(rest)]
    return "MAP {" + ", ".join(f"{_quoted(c)}: '{b:02X}'" for c, b in pairs) + "}"


def _pieces(path: str) -> str:
    """CTEs: d (the texts, numbered by r), word (their pre-tokens in order: part, seg, k), pieces (of each distinct one, k pieces)."""
    hexed = "array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: shown[c]), '')"
    pairs = "list_transform(range(1, CAST(len(q) AS BIGINT)), lambda i: '<' || q[i] || '><' || q[i + 1] || '>')"
    return f"""merges AS (SELECT rank, '<' || a || '><' || b || '>' AS pat, '<' || a || b || '>' AS whole FROM (
 SELECT rank, {hexed.format(x="json_extract_string(m, '$[0]')")} AS a, {hexed.format(x="json_extract_string(m, '$[1]')")} AS b FROM (
  SELECT unnest(l) AS m, generate_subscripts(l, 1) AS rank, {_shown()} AS shown FROM (SELECT CAST(json_extract(content, '$.model.merges') AS JSON[]) AS l FROM read_text({_quoted(path)}))))),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
part AS (SELECT r, unnest(l) AS t, generate_subscripts(l, 1) AS part FROM (SELECT r, string_split(t, '<|endoftext|>') AS l FROM d)),
seg AS (SELECT r, part, unnest(l) AS t, generate_subscripts(l, 1) AS seg FROM (
 SELECT r, part, string_split(regexp_replace(t, '([{BLANK}])([{BLANK}][^{BLANK}])', '\\1' || {SPLIT} || '\\2', 'g'), {SPLIT}) AS l FROM part)),
word AS (SELECT r, part, seg, unnest(l) AS w, generate_subscripts(l, 1) AS k FROM (SELECT r, part, seg, regexp_extract_all(t, {_quoted(PRETOKEN)}) AS l FROM seg)),
b AS (SELECT w, regexp_replace(hex(encode(w)), '(..)', '<\\1>', 'g') AS s, 0 AS i FROM (SELECT DISTINCT w FROM word)
 UNION ALL
 SELECT w, replace(s, pat, whole) AS s, i + 1 FROM (SELECT w, s, i, arg_min(z.pat, rank) AS pat, arg_min(whole, rank) AS whole FROM (
  SELECT w, s, i, unnest({pairs}) AS pat FROM (SELECT w, s, i, regexp_extract_all(s, '<([0-9A-F]+)>', 1) AS q FROM b)) z JOIN merges ON merges.pat = z.pat GROUP BY w, s, i)),
pieces AS (SELECT w, length(arg_max(s, i)) - length(replace(arg_max(s, i), '<', '')) AS k FROM b GROUP BY w)"""


def token_counts(path: str, limit: int = 512) -> str:
    """For a byte-level vocabulary with the one added token <|endoftext|>."""
    return f"""WITH RECURSIVE {_pieces(path)},
freq AS (SELECT r, w, count(*) AS n FROM word GROUP BY r, w),
total AS (SELECT r, sum(n * k) AS tokens, sum(n) AS pre, count(*) AS distinct_ FROM freq JOIN pieces USING (w) GROUP BY r),
e AS (SELECT doc_id, strlen(t) AS n_bytes, len(string_split(t, '<|endoftext|>')) - 1 + coalesce(tokens, 0) AS n, pre, distinct_ FROM d LEFT JOIN total USING (r))
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n AS BIGINT) AS n_tokens, n > {limit} AS over_limit, CAST(coalesce(pre, 0) AS BIGINT) AS n_pretokens, CAST(coalesce(distinct_, 0) AS BIGINT) AS n_distinct FROM e"""


def packed(path: str, k: int = 16, longest: int = 4096, budget: int = 65_536) -> str:
    """Sequences by going through a text's pre-tokens (none of which has more than longest tokens), bounds by dynamic programming
    over the lengths that occur (of equally good ones, those with the least lower bounds)."""
    return f"""WITH RECURSIVE {_pieces(path)},
every AS (SELECT r, part, seg, word.k AS k, length(w) AS chars, pieces.k AS n FROM word JOIN pieces USING (w) UNION ALL SELECT r, part, 0, 0, 13, 1 FROM part WHERE part > 1),
run AS (SELECT r, row_number() OVER o AS i, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS tokens, sum(chars) OVER (o ROWS UNBOUNDED PRECEDING) AS chars FROM every WINDOW o AS (PARTITION BY r ORDER BY part, seg, k)),
cut AS (SELECT r, 0 AS piece, CAST(0 AS BIGINT) AS i, CAST(0 AS HUGEINT) AS tokens, CAST(0 AS HUGEINT) AS chars FROM d
 UNION ALL
 SELECT r, piece + 1, max(run.i), max(run.tokens), max(run.chars) FROM cut JOIN run USING (r) WHERE run.i > cut.i AND run.tokens <= cut.tokens + {longest} GROUP BY r, piece),
ends AS (SELECT r, piece, chars AS start, lead(tokens) OVER o - tokens AS length FROM cut WINDOW o AS (PARTITION BY r ORDER BY piece)),
seq AS (SELECT doc_id, piece, CAST(start AS BIGINT) AS start, CAST(coalesce(length, 0) AS INT) AS length FROM ends JOIN d USING (r) WHERE length IS NOT NULL OR piece = 0),
hist AS (SELECT length AS x, count(*) AS n FROM seq GROUP BY length),
h AS (SELECT row_number() OVER (ORDER BY x) AS j, x, CAST(sum(n) OVER (ORDER BY x) AS BIGINT) AS total, CAST(sum(n * x) OVER (ORDER BY x) AS BIGINT) AS weight FROM hist UNION ALL SELECT 0, 0, 0, 0),
best AS (SELECT 1 AS round, j, total * x - weight AS waste, CASE WHEN j > 0 THEN [x] ELSE CAST([] AS INT[]) END AS bounds FROM h
 UNION ALL
 SELECT round + 1, j, min(cost), arg_min(bounds, {{'cost': cost, 'i': i}}) FROM (
  SELECT round, b.j, b.waste + CASE WHEN a.j = 0 AND b.j = 0 THEN 0 ELSE 0 END AS unused, a.j AS i, CASE WHEN b.j = 0 THEN 0 ELSE a.waste + (b.total - a.total) * b.x - (b.weight - a.weight) END AS cost, CASE WHEN b.j = 0 THEN a.bounds ELSE a.bounds || [b.x] END AS bounds
  FROM (SELECT round, h.j, waste, bounds, total, weight FROM best JOIN h USING (j)) a JOIN (SELECT j, total, weight, x, 0 AS waste FROM h) b ON a.j < b.j OR a.j = 0 AND b.j = 0) WHERE round < {k} GROUP BY round, j),
bounds AS (SELECT unnest(bounds) AS hi FROM best WHERE j = (SELECT max(j) FROM h) AND round = (SELECT max(round) FROM best)),
bucket AS (SELECT CAST(row_number() OVER (ORDER BY hi) - 1 AS INT) AS bucket, coalesce(lag(hi) OVER (ORDER BY hi), -1) AS lo, hi FROM (SELECT DISTINCT hi FROM bounds)),
size AS (SELECT bucket, hi, {budget} // greatest(1, hi) AS holds, CAST(greatest(1, round_even(greatest(count(*) / {packing.CELL}, sum(length) / {packing.FULL * budget}), 0)) AS BIGINT) AS cells FROM seq JOIN bucket ON length > lo AND length <= hi GROUP BY bucket, hi),
placed AS (SELECT seq.*, bucket, hi, holds, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || piece || ':' || length), 1, 8))::BIGINT % cells AS INT) AS cell FROM seq JOIN bucket ON length > lo AND length <= bucket.hi JOIN size USING (bucket, hi)),
spot AS (SELECT *, row_number() OVER (PARTITION BY bucket, cell ORDER BY length, doc_id NULLS FIRST, piece) - 1 AS at_ FROM placed)
SELECT doc_id, CAST(piece AS INT) AS piece, start, length, bucket, CAST(hi AS INT) AS bucket_len, cell, CAST(at_ // holds AS BIGINT) AS batch, CAST(at_ % holds AS INT) AS slot FROM spot"""


ORACLE_SQL = {"op1_syncmers": FINGERPRINTS, "op3_chunk_dedup": passages(), "op4_secret_scan": SECRETS, "op8_suffix_dedup": REPEATS, "op9_warc": ARCHIVES, "op10_minhash": SIMILAR}
if importlib.util.find_spec("public_tokenizers"):
    import public_tokenizers

    ORACLE_SQL["op2_token_counts"] = token_counts(public_tokenizers.path("byte_bpe_50k.json"))
    ORACLE_SQL["op5_packing"] = packed(public_tokenizers.path("byte_bpe_50k.json"))

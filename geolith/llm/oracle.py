"""SQL, for another engine, of the operators that SQL can express."""

from __future__ import annotations

from geolith.llm import license_scan, quality_rules, url_filter

WORDS = r"[^\x20\x09-\x0D]+"


def quality_rules_sql() -> str:
    q = quality_rules
    d, scale = q.DIM, q.SCALE
    xs = ", ".join(f"x{i}" for i in range(d))
    base = rf"""w AS (SELECT doc_id, lang, source, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '{WORDS}') ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) i FROM w)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM h) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) n, count(*) - count(DISTINCT line) dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM w) WHERE regexp_matches(line, '{WORDS}') GROUP BY doc_id),
b AS (SELECT doc_id, lang, source, len(ws)::BIGINT n_words, length(array_to_string(ws, ''))::BIGINT word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT n_symbols,
  coalesce(l.n, 0) n_lines, coalesce(l.dup, 0) n_dup_lines, coalesce(r.n, 0) n_repeat_words FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 'l' || coalesce('=' || lang, '') lg, coalesce('=' || source, '') sg,
  floor(ln(1.0::DOUBLE + n_words) * {scale} + 0.5)::BIGINT x0, floor(ln((1.0::DOUBLE + word_chars) / greatest(n_words, 1)) * {scale} + 0.5)::BIGINT x1,
  floor(ln(1.0::DOUBLE + 100.0::DOUBLE * n_symbols / greatest(word_chars, 1)) * {scale} + 0.5)::BIGINT x2, floor(sqrt(n_dup_lines / greatest(n_lines, 1)) * {scale} + 0.5)::BIGINT x3,
  floor(sqrt(n_repeat_words / greatest(n_words, 1)) * {scale} + 0.5)::BIGINT x4 FROM b),
z AS (SELECT lg, sg, count(*) n FROM s WHERE NOT base_failed GROUP BY ALL),
z2 AS (SELECT *, sum(n) OVER (PARTITION BY lg, n >= {q.LEAST}) of_lang FROM z),
z3 AS (SELECT *, sum(n) OVER (PARTITION BY n < {q.LEAST} AND of_lang < {q.LEAST}) of_all FROM z2),
gr AS (SELECT lg, sg, CASE WHEN n >= {q.LEAST} THEN lg || chr(1) || sg WHEN of_lang >= {q.LEAST} THEN lg || chr(2) WHEN of_all >= {q.LEAST} THEN chr(3) END grp FROM z3),
t AS (SELECT s.*, grp FROM s LEFT JOIN gr USING (lg, sg)),
u AS (SELECT grp, {xs} FROM t WHERE NOT base_failed AND grp IS NOT NULL)"""
    mids = ", ".join(f"median(x{i}) m{i}" for i in range(d))
    devs = ", ".join(f"first(m{i}) m{i}, median(abs(x{i} - m{i})) d{i}" for i in range(d))
    start = ", ".join([f"m{i}" for i in range(d)] + [f"sqrt(pow(1.4826::DOUBLE * d{i}, 2) + {(q.FLOOR[i] * scale) ** 2!r}::DOUBLE) l{i}{i}" if i == j else f"0.0::DOUBLE l{i}{j}" for i in range(d) for j in range(i + 1)])
    out = f"WITH {base}, md AS (SELECT grp, {mids} FROM u GROUP BY grp), ds AS (SELECT grp, {devs} FROM u JOIN md USING (grp) GROUP BY grp), e0 AS (SELECT grp, {start} FROM ds)"

    def distance(source: str, name: str, keep: str) -> str:
        """One nested query for each coordinate, so that each quotient is worked out once."""
        sql = source
        for i in range(d):
            minus = "".join(f" - l{i}{j} * z{j}" for j in range(i))
            sql = f"(SELECT *, (x{i} - m{i}{minus}) / l{i}{i} z{i} FROM {sql})"
        return f"{name} AS (SELECT {keep}, {' + '.join(f'z{i} * z{i}' for i in range(d))} d2 FROM {sql})"

    for k in range(1, q.STEPS + 1):
        out += ", " + distance(f"(SELECT * FROM u JOIN e{k - 1} USING (grp))", f"n{k}", f"grp, {xs}")
        out += f", b{k} AS (SELECT *, least(floor(sqrt(d2) * 64), {1 << 20})::BIGINT bin FROM n{k})"
        out += f", c{k} AS (SELECT grp, min(bin) edge FROM (SELECT grp, bin, sum(count(*)) OVER (PARTITION BY grp ORDER BY bin) upto, sum(count(*)) OVER (PARTITION BY grp) a FROM b{k} GROUP BY grp, bin) WHERE upto >= {q.SHARE}::DOUBLE * a GROUP BY grp)"
        sums = ", ".join([f"sum(x{i})::BIGINT s{i}" for i in range(d)] + [f"sum(x{i} * x{j})::BIGINT s{i}{j}" for i in range(d) for j in range(i + 1)])
        sql = f"(SELECT *, {', '.join(f's{i} / n m{i}' for i in range(d))} FROM (SELECT grp, count(*) n, {sums} FROM b{k} JOIN c{k} USING (grp) WHERE bin <= edge GROUP BY grp))"
        for i in range(d):
            for j in range(i + 1):
                c = f"(s{i}{j} / n - m{i} * m{j}) * {q.CONSISTENCY}::DOUBLE" + (f" + {(q.FLOOR[i] * scale) ** 2!r}::DOUBLE" if i == j else "") + "".join(f" - l{i}{m} * l{j}{m}" for m in range(j))
                sql = f"(SELECT *, {f'sqrt(greatest({c}, 1.0::DOUBLE))' if i == j else f'({c}) / l{j}{j}'} l{i}{j} FROM {sql})"
        out += f", e{k} AS (SELECT grp, {', '.join([f'm{i}' for i in range(d)] + [f'l{i}{j}' for i in range(d) for j in range(i + 1)])} FROM {sql})"
    out += ", " + distance(f"(SELECT * FROM t LEFT JOIN e{q.STEPS} USING (grp))", "o", "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed")
    return out + f" SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2 <= {q.CUTOFF}::DOUBLE, true) AS kept FROM o"


def url_filter_sql() -> str:
    u = url_filter
    rules = sorted(u.RULES, key=lambda r: (-len(r[0] + r[1]), r))
    cases = lambda k: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[k]}'" for h, p, v in rules) + " END"

    def level(name: str, source: str, key: str, parent: str, prior: str) -> str:
        return f"""{name}r AS (SELECT s.*, p.mean m FROM {source} s JOIN {prior} p USING ({parent})),
{name}m AS (SELECT sum(n * (b / n - m) * (b / n - m)) spread, sum(m * (1 - m)) chance, sum(n * m * (1 - m)) most FROM {name}r),
{name}s AS (SELECT coalesce(least(greatest(1 / greatest((spread - chance) / greatest(most - chance, 1e-9), 1e-9) - 1, {u.WEAKEST}::DOUBLE), {u.STRONGEST}::DOUBLE), {u.WEAKEST}::DOUBLE) s FROM {name}m),
{name} AS (SELECT {key}, m * s + b alpha, (1 - m) * s + n - b beta, (m * s + b) / (m * s + b + ((1 - m) * s + n - b)) mean FROM {name}r, {name}s)"""

    return rf"""WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') raw, rest FROM a),
p0 AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') path FROM h),
p AS (SELECT *, {cases(0)} AS rule, {cases(1)} AS by_rule FROM p0),
hs AS (SELECT host, list_extract(string_split(host, '.'), -1) suffix, array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), len(string_split(host, '.'))), '.') AS domain,
  count(by_rule)::DOUBLE n, count(*) FILTER (by_rule = 'block')::DOUBLE b FROM p GROUP BY host),
sn AS (SELECT * FROM hs WHERE n > 0), dm AS (SELECT domain, suffix, sum(n) n, sum(b) b FROM sn GROUP BY ALL), sx AS (SELECT suffix, 0 AS root, sum(n) n, sum(b) b FROM dm GROUP BY ALL),
rt AS (SELECT root, (sum(b) + 0.5) / (sum(n) + 1) mean, sum(b) + 0.5::DOUBLE alpha, sum(n) - sum(b) + 0.5::DOUBLE beta FROM sx GROUP BY root),
{level("os", "sx", "suffix", "root", "rt")}, {level("od", "dm", "domain", "suffix", "os")}, {level("oh", "sn", "host", "domain", "od")},
q AS (SELECT hs.host, coalesce(oh.alpha, od.alpha, os.alpha, rt.alpha, 0.5) a, coalesce(oh.beta, od.beta, os.beta, rt.beta, 0.5) b FROM hs LEFT JOIN oh USING (host) LEFT JOIN od ON hs.domain = od.domain LEFT JOIN os ON hs.suffix = os.suffix LEFT JOIN rt ON true)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN a / (a + b) - {u.BOUND}::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= {u.THRESHOLD}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict FROM p JOIN q USING (host)"""


def license_scan_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    grams = [(k, name, license_scan.bigrams(t)) for k, (name, t) in enumerate(license_scan.TEMPLATES.items())]
    t = license_scan.THRESHOLD
    templates = ", ".join(f"({k}, {quoted(n)}, [{', '.join(map(quoted, g))}])" for k, n, g in grams)
    return rf"""WITH t AS (SELECT k, license, g FROM (VALUES {templates}) v(k, license, g)),
x AS (SELECT doc_id, coalesce(text, '') text FROM documents),
p AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, text p FROM x UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM x UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))) FROM x)),
n AS (SELECT doc_id, string_split(trim(regexp_replace(lower(p), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') w FROM p),
i AS (SELECT doc_id, w, unnest(range(1, len(w))) i FROM n WHERE len(w) >= 2),
b AS (SELECT DISTINCT doc_id, list_sort(list_distinct(list(w[i] || ' ' || w[i + 1]))) s FROM i GROUP BY doc_id, w),
m AS (SELECT doc_id, s, k, license, 2.0::DOUBLE * len(list_intersect(s, g)) / (len(s) + len(g)) dice FROM b, t
  WHERE len(s) BETWEEN len(g) * {t} / (2 - {t}) - 1e-9 AND len(g) * (2 - {t}) / {t} + 1e-9),
f AS (SELECT * FROM m WHERE dice >= {t}::DOUBLE),
r AS (SELECT doc_id, license, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, k) o, (SELECT count(DISTINCT s) FROM f y WHERE y.doc_id = f.doc_id) n_matches FROM f)
SELECT x.doc_id, license, dice, coalesce(n_matches, 0)::BIGINT n_matches FROM x LEFT JOIN (SELECT * FROM r WHERE o = 1) USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {"op1_quality_rules": quality_rules_sql(), "op5_url_filter": url_filter_sql(), "op8_license_scan": license_scan_sql()}

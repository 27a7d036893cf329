"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from stintwise.llm import mixing, quality_rules, secrets


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality() -> str:
    checks = []
    for r in quality_rules.THRESHOLDS:
        value = f"coalesce({r.measure}::double / nullif({r.per}, 0), 0)"
        checks += [f"{value} >= {r.low}"] if r.low is not None else []
        checks += [f"{value} <= {r.high}"] if r.high is not None else []
    stop = ", ".join(quoted(w) for w in quality_rules.STOP_WORDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT row_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM s),
g AS (SELECT row_id, pos, list_transform([0, 1, 2, 3, 4], lambda k: lead_words[k + 1]) AS gram FROM (
        SELECT row_id, pos, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS lead_words
        FROM w WINDOW o AS (PARTITION BY row_id ORDER BY pos)) WHERE lead_words[5] IS NOT NULL),
twice AS (SELECT row_id, pos FROM (SELECT row_id, pos, count(*) OVER (PARTITION BY row_id, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT row_id, count(DISTINCT pos + k) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY row_id),
m AS (SELECT s.*, len(words)::bigint AS n_words, sqrt(len(words)) AS n_words_sqrt, length(array_to_string(words, ''))::bigint AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, len(lines)::bigint AS n_lines,
        (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
        1 + len(list_filter(words, lambda x: lower(x) IN ({stop})))::bigint AS n_stop_words_1,
        len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
        len(list_filter(words, lambda x: regexp_matches(x, '\p{{Lu}}{{2}}') AND NOT regexp_matches(x, '\p{{Ll}}'))) AS n_upper_words,
        len(list_distinct(words)) AS n_distinct_words, coalesce(rep.n, 0)::bigint AS n_repeat_words
      FROM s LEFT JOIN rep USING (row_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(checks)} AS kept FROM b
"""


def secret_spans() -> str:
    """Matches and the parts between them alternate, so their lengths add up to positions."""
    arms = []
    for i, r in enumerate(secrets.RULES):
        p = quoted(r.pattern)
        arms.append(
            f"SELECT row_id, {i} AS ord, '{r.kind}' AS kind, generate_subscripts(hits, 1) AS n, hits, gaps, unnest(sizes) AS size FROM "
            f"(SELECT row_id, list_transform(regexp_extract_all(text, {p}), lambda x: length(x)) AS hits, "
            f"list_transform(string_split_regex(text, {p}), lambda x: length(x)) AS gaps, "
            f"list_transform(regexp_extract_all(text, {p}, {r.group}), lambda x: length(x)) AS sizes FROM d) WHERE len(hits) > 0"
        )
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(secrets.RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({" UNION ALL ".join(arms)}),
spans AS (SELECT row_id, ord, kind, (list_sum(gaps[1:n]) + coalesce(list_sum(hits[1:n - 1]), 0))::bigint AS a, hits[n] AS len
  FROM raw WHERE size >= CASE ord {least} END),
per AS (SELECT row_id, string_agg(kind || ':' || a || ':' || (a + len), ',' ORDER BY a, ord) AS spans,
  string_agg(kind || ':' || a || ':' || (a + len), ',' ORDER BY a, ord) FILTER (ord < {len(secrets.BASE)}) AS base,
  {", ".join(f"count(*) FILTER (ord = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.BASE))} FROM spans GROUP BY row_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::bigint AS n_{r.kind}" for r in secrets.BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (row_id)
"""


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::int AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


REPEATS = r"""
WITH s AS (SELECT row_number() OVER () AS row_id, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT row_id, doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM s WHERE len(words) >= 50),
h AS (SELECT row_id, doc_id, pos, sha256(array_to_string(words[pos:pos + 49], ' ')) AS h FROM w),
gone AS (SELECT row_id, pos FROM (SELECT row_id, doc_id, pos, min(doc_id) OVER (PARTITION BY h) AS first FROM h) WHERE first < doc_id),
c AS (SELECT row_id, list(DISTINCT pos + k ORDER BY pos + k) AS covered FROM gone, (SELECT unnest(range(50)) AS k) GROUP BY row_id),
x AS (SELECT row_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM s),
cov AS (SELECT row_id, unnest(covered) AS i FROM c),
k AS (SELECT x.row_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN cov ON x.row_id = cov.row_id AND x.i = cov.i GROUP BY x.row_id)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(len(covered), 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM s LEFT JOIN c USING (row_id) LEFT JOIN k USING (row_id)
"""


# CRC-32 of the bytes of an ASCII or UTF-8 text: the table of the 256 byte steps, then byte by byte.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::bigint) ELSE c >> 1 END, i)) AS t)"""


def crc32_of(text: str) -> str:
    step = f"xor(c >> 8, t[xor(c & 255, ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint) + 1])"
    return f"xor(list_reduce(range(octet_length(encode({text}))), lambda c, i: {step}, 4294967295::bigint), 4294967295::bigint)"


def importance() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS row_id, doc_id, {found} AS words FROM documents),
w AS (SELECT row_id, unnest(words) AS word FROM d),
q AS (SELECT unnest({found}) AS word FROM benchmark),
v AS (SELECT word, {crc32_of('word')} % 10000 AS bucket FROM (SELECT word FROM w UNION SELECT word FROM q), crc),
s AS (SELECT bucket, count(*)::double AS s FROM w JOIN v USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*)::double AS t FROM q JOIN v USING (word) GROUP BY 1),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::bigint AS gain FROM s LEFT JOIN t USING (bucket), n),
m AS (SELECT row_id, floor(sum(gain)::double / count(*))::bigint AS weight FROM w JOIN v USING (word) JOIN g USING (bucket) GROUP BY 1),
h AS (SELECT row_id, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
  ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint AS h FROM d LEFT JOIN m USING (row_id)),
k AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint AS score FROM h),
r AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS able FROM k WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= floor(10 * able / 100.0) THEN rank END AS rank FROM k LEFT JOIN r USING (row_id)
"""


def mixed(spec: mixing.MixSpec = mixing.MixSpec()) -> str:
    weights = ", ".join(map(str, spec.weights))
    bits = lambda text: f"('0x' || substr(sha256({text}), 1, 15))::bigint"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce('0' || source, '1') AS src,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size FROM documents),
z AS (SELECT src, sum(size)::bigint AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [{weights}][(row_number() OVER (ORDER BY src) - 1) % {len(spec.weights)} + 1]::double AS weight, {spec.ceiling}::double * source_size AS cap,
    (sum(source_size) OVER ())::double * {spec.percent} / 100 AS total FROM z),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
a AS (SELECT src, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
o AS (SELECT src, source_size, floor(target / nullif(source_size, 0))::bigint AS whole, round(target)::bigint - floor(target / nullif(source_size, 0))::bigint * source_size AS rest FROM a),
p AS (SELECT *, {bits(f"'{spec.seed}:' || coalesce(doc_id::varchar, '')")} AS key FROM d WHERE size > 0),
b AS (SELECT *, (sum(size) OVER (PARTITION BY src ORDER BY key, size, row_id) - size)::bigint AS before FROM p),
c AS (SELECT src, before // {spec.block_words} AS block, sum(size)::bigint AS words, min(before) AS start FROM b GROUP BY 1, 2),
e AS (SELECT c.*, o.rest, {bits(f"'{spec.seed}:' || c.src || ':' || o.whole || ':' || c.block")} AS turn FROM c JOIN o USING (src)),
f AS (SELECT *, rest - (sum(words) OVER (PARTITION BY src ORDER BY turn, block) - words) AS room FROM e),
x AS (SELECT b.row_id, greatest(0, least(b.size, least(f.room, f.words) - (b.before - f.start)))::bigint AS part
    FROM b JOIN f ON b.src = f.src AND b.before // {spec.block_words} = f.block)
SELECT d.doc_id, d.size, a.source_size, a.target, (CASE WHEN d.size > 0 THEN o.whole * d.size ELSE 0 END + coalesce(x.part, 0))::bigint AS taken
FROM d JOIN a USING (src) JOIN o USING (src) LEFT JOIN x ON d.row_id = x.row_id
"""


def merkle() -> str:
    """The trees level by level as lists; a leaf's siblings are found by its number."""
    part = lambda c: f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"
    leaf = lambda n: "sha256(" + " || ".join(part(n if c == "n_chars" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    up = "list_transform(range(0, len(d), 2), lambda i: sha256(d[i + 1] || coalesce(d[i + 2], '')))"
    climb = lambda name, base: f"{name}(tree, lvl, d) AS ({base} UNION ALL SELECT tree, lvl + 1, {up} FROM {name} WHERE len(d) > 1)"
    # One step of a proof: the node's side and its sibling, by its place among its level's.
    step = "CASE (pos >> lvl) % 2 WHEN 1 THEN 'R' ELSE 'L' END || coalesce(d[xor(pos >> lvl, 1) + 1], '')"
    fold = "list_reduce(way, lambda v, s: sha256(CASE s[1] WHEN 'R' THEN s[2:] || v ELSE v || s[2:] END), coalesce(changed, leaf))"
    return f"""
WITH RECURSIVE {CRC_TABLE},
b AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {leaf("n_chars")} AS leaf,
    CASE WHEN {crc32_of("coalesce(doc_id::varchar, '')")} % 7 = 0 AND doc_id IS NOT NULL AND n_chars IS NOT NULL THEN {leaf("(n_chars + 1)")} END AS changed FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM b),
{climb("low", "SELECT tree, 0::bigint, list(leaf ORDER BY pos) FROM l GROUP BY tree")},
subs AS (SELECT tree, d[1] AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM low WHERE len(d) = 1),
{climb("high", "SELECT '', 0::bigint, list(subroot ORDER BY pos) FROM subs")},
steps AS (SELECT tree, pos, lvl, {step} AS s FROM l JOIN low USING (tree) WHERE len(d) > 1),
tops AS (SELECT subs.tree, list({step} ORDER BY lvl) AS way FROM subs, (SELECT lvl, d FROM high WHERE len(d) > 1) GROUP BY 1),
ways AS (SELECT tree, pos, list(s ORDER BY lvl) AS way FROM steps GROUP BY 1, 2),
j AS (SELECT l.*, subroot, (SELECT d[1] FROM high WHERE len(d) = 1) AS root, list_concat(coalesce(ways.way, []), coalesce(tops.way, [])) AS way
    FROM l JOIN subs USING (tree) LEFT JOIN ways ON l.tree = ways.tree AND l.pos = ways.pos LEFT JOIN tops ON l.tree = tops.tree),
f AS (SELECT *, sha256(array_to_string(list_transform(way, lambda s: s[2:]), '')) AS proof_sha256, {fold} AS folded_root FROM j)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f
"""


def by_query() -> dict[str, str]:
    return {
        "op7_quality_rules": quality(),
        "op10_secret_scans": secret_spans(),
        "op8_exact_topk": TOP_K,
        "op9_super_kmers": REPEATS,
        "op11_importance": importance(),
        "op12_splitting_tree": mixed(),
        "op13_time_forward": merkle(),
    }

"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import chat, licenses, merkle, quality, ranked

EXACT = r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
           doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
    FROM t
"""

_bucket = lambda v: f"CASE WHEN {v} < 64 THEN {v} ELSE ({v} >> (length(bin({v})) - 6)) << (length(bin({v})) - 6) END"
_ratio = lambda k, off=0: (
    f"CASE WHEN {quality.RATIOS[k][2]} > 0 THEN (greatest({quality.RATIOS[k][0]} - {off}, 0) * {quality.RATIOS[k][1]}) // {quality.RATIOS[k][2]} ELSE 0 END"
)
_name = "CASE level WHEN 2 THEN lang END"
_punctuation = "".join(rf"\x{c:02x}" for c in quality._PUNCTUATION)

_square = lambda t: f"(least({t}.total, {quality.MOST})::BIGINT * least({t}.total, {quality.MOST})::BIGINT)"

QUALITY = rf"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS x FROM documents),
    w AS (SELECT row, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM d),
    g AS (SELECT row, w, generate_subscripts(w, 1) AS i FROM w),
    win AS (SELECT row, i, hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS t, count(*) OVER (PARTITION BY row, w[i], w[i + 1], w[i + 2]) AS n
            FROM g WHERE i + 2 <= len(w)),
    rep AS (SELECT row, count(DISTINCT i + j) AS n FROM win, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY row),
    l AS (SELECT row, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM d),
    f AS (
        SELECT row, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
            length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
            len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines,
            length(x) - length(regexp_replace(x, '[A-Za-z]', '', 'g')) AS n_letters,
            length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) AS n_upper,
            length(x) - length(regexp_replace(x, '[{_punctuation}]', '', 'g')) AS n_punctuation
        FROM d JOIN w USING (row) JOIN l USING (row) LEFT JOIN rep USING (row)),
    r AS (SELECT lang, source, unnest([{", ".join(f"{{'ratio': '{k}', 'v': {_ratio(k)}}}" for k in quality.RATIOS)}]) AS r FROM f
        WHERE n_words >= {quality.MIN_WORDS} AND 100 * n_repeat_words <= {quality.MAX_REPEAT} * n_words),
    b AS (SELECT lang, source, r.ratio AS ratio, {_bucket("r.v")} AS bucket FROM r),
    s AS (
        SELECT level, CASE WHEN level > 0 THEN lang END AS lang, CASE WHEN level > 1 THEN source END AS source, ratio, bucket, count(*) AS n
        FROM b, (SELECT unnest([0, 1, 2]) AS level) GROUP BY ALL),
    u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bucket) AS upto,
                 sum(n) OVER (PARTITION BY level, lang, source, ratio) AS total FROM s),
    q AS (SELECT level, lang, source, ratio, max(total) AS total,
                 min(bucket) FILTER (upto * 100 >= total * {100 - quality.UPPER}) AS lower, min(bucket) FILTER (upto * 100 >= total * 50) AS middle,
                 min(bucket) FILTER (upto * 100 >= total * {quality.UPPER}) AS upper FROM u GROUP BY level, lang, source, ratio),
    c AS (SELECT level, lang, source, ratio, total, upper + {quality.REACH} * greatest(upper - middle, upper // 32, 1) AS high,
                 greatest(lower - {quality.REACH} * greatest(middle - lower, upper // 32, 1), 0) AS least FROM q),
    t AS (
        SELECT o.lang, o.source, o.ratio, {", ".join(f"({_square('o')} * o.{x} + {quality.PRIOR**2} * (({_square('p')} * p.{x} + {quality.PRIOR**2} * a.{x}) // ({_square('p')} + {quality.PRIOR**2}))) // ({_square('o')} + {quality.PRIOR**2}) AS {x}" for x in ("high", "least"))}
        FROM c o JOIN c p ON p.level = 1 AND p.lang IS NOT DISTINCT FROM o.lang AND p.ratio = o.ratio
        JOIN c a ON a.level = 0 AND a.ratio = o.ratio WHERE o.level = 2),
    wide AS (
        SELECT lang, source, {", ".join(f"max(high) FILTER (ratio = '{k}') AS high_{k}" for k in quality.RATIOS)},
            max(least) FILTER (ratio = 'word_length') AS low_word_length FROM t GROUP BY lang, source)
    SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letters, n_upper, n_punctuation,
        n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS base_failed,
        coalesce(NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words)
            AND {" AND ".join(f"({_ratio(k, quality.TOLERANCE.get(k, 0))}) <= high_{k}" for k in quality.RATIOS)}
            AND ({_ratio("word_length")}) >= low_word_length, false) AS kept
    FROM f LEFT JOIN wide ON wide.lang IS NOT DISTINCT FROM f.lang AND wide.source IS NOT DISTINCT FROM f.source
"""

_turn = lambda t: f"'{chat.OPEN}' || coalesce({t}.role, '') || chr(10) || coalesce({t}.text, '') || '<|im_end|>' || chr(10)"
_render = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda t: {_turn('t')}), ''), '')"
_mask = lambda x: (
    f"coalesce(array_to_string(list_transform({x}, lambda t: (length('{chat.OPEN}') + length(coalesce(t.role, '')) + 1)::VARCHAR || '-,'"
    f" || (length(coalesce(t.text, '')) + 11)::VARCHAR || CASE WHEN coalesce(t.role, '') = '{chat.TRAINED}' THEN '+' ELSE '-' END), ','), '')"
)

CHAT = f"""
    WITH g AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    l AS (SELECT *, list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = '{chat.TRAINED}')) AS last FROM g),
    p AS (SELECT a.conv_id AS pair_id, a.t[1:a.last] AS c, list_concat(a.t[1:a.last - 1], CASE WHEN b.last IS NULL THEN [] ELSE [b.t[b.last]] END) AS r
        FROM l a LEFT JOIN l b ON b.conv_id = xor(a.conv_id, 1) WHERE a.last IS NOT NULL),
    k AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, least(len(c), len(r))) AS k FROM p)
    SELECT pair_id, k::INTEGER AS prompt_turns, len(c)::INTEGER AS chosen_turns, len(r)::INTEGER AS rejected_turns,
        {_render("c[1:k]")} AS prompt, {_render("c[k + 1:]")} AS chosen, {_render("r[k + 1:]")} AS rejected,
        {_mask("c[k + 1:]")} AS chosen_mask, {_mask("r[k + 1:]")} AS rejected_mask
    FROM k
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


LICENSES = rf"""
    WITH tpl AS (SELECT i AS template, license, regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+') AS w
        FROM (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(licenses.TEMPLATES))}) v(i, license, x)),
    ts AS (SELECT DISTINCT template, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, generate_subscripts(w, 1) AS i FROM tpl) WHERE i + 4 <= len(w)),
    tn AS (SELECT template, any_value(license) AS license, count(*) AS n,
        any_value(CASE WHEN len(w) = 5 THEN 1 ELSE 1 << length(bin(len(w) - 5)) END) AS scale FROM ts JOIN tpl USING (template) GROUP BY template),
    d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
    s AS (SELECT doc_id, i - 1 AS i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, generate_subscripts(w, 1) AS i FROM d) WHERE i + 4 <= len(w)),
    h AS (SELECT doc_id, template, i, s, scale, license, n, unnest([i // scale, i // scale - 1]) AS k FROM s JOIN ts USING (s) JOIN tn USING (template)),
    m AS (SELECT doc_id, template, k, any_value(license) AS license, any_value(n) AS n, count(DISTINCT s) AS found, min(i) AS i FROM h WHERE k >= 0 GROUP BY ALL)
    SELECT doc_id, template, any_value(license) AS license, max(found / n) AS contained, min(i)::INTEGER AS first_word
    FROM m WHERE found * 10 >= n * 8 GROUP BY doc_id, template
"""

_part = lambda x: f"coalesce(strlen(({x})::VARCHAR)::VARCHAR || ':' || ({x})::VARCHAR, '-')"
_leaf = lambda n_chars: "sha256(" + " || ".join(_part(n_chars if c == "n_chars" else c) for c in merkle.FIELDS) + ")"
#: CRC-32 bit by bit: DuckDB has no function for it.
_crc = """
    list_reduce(list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i::INTEGER + 1, 1))::UBIGINT),
        lambda c, b: list_reduce(range(8)::UBIGINT[], lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)), xor(c, b)), 4294967295::UBIGINT)
"""
#: One level of every tree: a list of digests per group; "path" collects each position's sibling with its side.
_levels = lambda start: f"""
    SELECT 0 AS level, g, l FROM {start}
    UNION ALL
    SELECT level + 1, g, list_transform(range(0, len(l), 2), lambda i: sha256(l[i + 1] || coalesce(l[i + 2], ''))) FROM {{0}} WHERE len(l) > 1
"""  # noqa: E731
_step = "CASE WHEN (({p} >> v.level) & 1) = 1 THEN 'L' ELSE 'R' END || coalesce(l[xor(({p} >> v.level), 1) + 1], '')"
_fold = "list_reduce(steps, lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END), {0})"

MERKLE = f"""
    WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
            CASE WHEN coalesce((xor({_crc}, 4294967295::UBIGINT)) % {merkle.TAMPER} = 0, false) THEN {_leaf("n_chars::HUGEINT + 1")} ELSE {_leaf("n_chars")} END AS shown FROM documents),
    p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
    low AS (SELECT g, list(leaf ORDER BY pos) AS l FROM p GROUP BY g),
    up AS ({_levels("low").format("up")}),
    sub AS (SELECT g, l[1] AS subroot FROM up WHERE len(l) = 1),
    high AS (SELECT 0 AS g, list(subroot ORDER BY g) AS l FROM sub),
    top AS ({_levels("high").format("top")}),
    a AS (SELECT p.g, pos, list({_step.format(p="pos")} ORDER BY v.level) AS steps FROM p JOIN up v ON v.g = p.g AND len(v.l) > 1 GROUP BY ALL),
    b AS (SELECT sub.g, list({_step.format(p="sub.g")} ORDER BY v.level) AS steps FROM sub JOIN top v ON len(v.l) > 1 GROUP BY ALL),
    f AS (SELECT p.*, subroot, (SELECT l[1] FROM top WHERE len(l) = 1) AS root, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
        FROM p JOIN sub USING (g) LEFT JOIN a ON a.g = p.g AND a.pos = p.pos LEFT JOIN b ON b.g = p.g)
    SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda s: s[2:]), ''), '')) AS proof_sha256,
        {_fold.format("shown")} AS folded_root, {_fold.format("shown")} = root AS verified
    FROM f
"""

_TERMS = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')"
)
RANKED = f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents),
    k AS (SELECT row, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
    s AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM k),
    tf AS (SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(w) AS t FROM d) GROUP BY ALL),
    df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
    i AS (SELECT DISTINCT ask, item_id, t FROM (SELECT ask, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS ask, item_id, {_TERMS} AS w FROM benchmark))),
    p AS (SELECT ask, item_id, k.row, k.doc_id,
            floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - {ranked.LENGTH_WEIGHT} + ({ranked.LENGTH_WEIGHT} * n * n_docs) // n_terms))) AS x
        FROM i JOIN df USING (t) JOIN tf USING (t) JOIN k ON k.row = tf.row, s),
    r AS (SELECT ask, item_id, doc_id, sum(x)::BIGINT AS score FROM p GROUP BY ask, item_id, row, doc_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM r WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {ranked.TOP}
"""

ORACLE = {
    "op3_preference_chat": CHAT, "op5_license_scan": LICENSES, "op7_exact_dedup": EXACT, "op8_quality": QUALITY,
    "op11_merkle_manifest": MERKLE, "op12_ranked_search": RANKED,
}

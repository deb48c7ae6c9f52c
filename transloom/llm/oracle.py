"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

import re
import string

from transloom.llm import quality

_WS = r"[\x20\x09-\x0D]"
_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lower(x: str) -> str:
    return f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{_WS}+'), lambda w: w <> '')"


def _shingles(w: str, n: int) -> str:
    return (f"CASE WHEN len({w}) >= {n} THEN list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' ')) "
            f"WHEN len({w}) > 0 THEN [array_to_string({w}, ' ')] ELSE [] END")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    """Code points as DuckDB's patterns spell them."""
    return re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pattern)


DECONTAMINATION = f"""
WITH item_words AS (SELECT {_words(_lower("coalesce(text, '')"))} AS w, item_id FROM benchmark),
items AS (SELECT w, min(item_id) AS item_id FROM item_words WHERE len(w) > 0 GROUP BY w),
item_shingles AS (SELECT DISTINCT item_id, unnest({_shingles('w', 5)}) AS s FROM items),
sized AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id),
doc_words AS (SELECT doc_id, {_words(_lower("coalesce(text, '')"))} AS w FROM documents),
short AS (SELECT DISTINCT len(w) AS m FROM items WHERE len(w) < 5),
doc_shingles AS (SELECT doc_id, unnest({_shingles('w', 5)}) AS s FROM doc_words
  UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) FROM doc_words, short),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc_shingles JOIN item_shingles USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM shared JOIN sized USING (item_id) WHERE 10 * n_shared >= 8 * n_shingles"""

URL_FILTERS = f"""
WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests),
parts AS (SELECT page_id, {_lower('raw')} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
dotted AS (SELECT *, '.' || host AS h FROM parts),
ruled AS (SELECT page_id, host, path, CASE
    WHEN h LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN h LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN h LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN h LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN h LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM dotted)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM split),
keyed AS (SELECT *, {_lower(f'trim(line, {_TRIM})')} AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, i, line, top IS NULL OR top = doc_id AS stays FROM keyed LEFT JOIN frequent USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

QUALITY = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
worded AS (SELECT doc_id, t, {_words('t')} AS w, string_split(t, chr(10)) AS ls FROM texts),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM worded WHERE len(w) >= 8)),
again AS (SELECT doc_id, s FROM windows GROUP BY doc_id, s HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words
             FROM windows JOIN again USING (doc_id, s), range(8) AS r(j) GROUP BY doc_id),
lines AS (SELECT doc_id, i, line, {_words('line')} AS w FROM (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM worded)),
counted AS (SELECT *, regexp_matches(line, {_quoted(quality.SENTENCE_END)}) OR regexp_matches(line, {_quoted(_re2(quality.OTHER_END))}) AS ends, len(w) AS n, len(list_filter(w, lambda x: x IN ({', '.join(map(_quoted, quality.SEPARATORS))}))) AS n_sep,
                   len(list_filter(w, lambda x: regexp_matches(x, {_quoted(quality.DECORATED)}))) AS n_deco,
                   len(regexp_extract_all(line, '\\p{{L}}')) AS n_letters, len(regexp_extract_all(line, '\\p{{Lu}}')) AS n_upper FROM lines),
named AS (SELECT *, CASE WHEN n = 0 THEN '' WHEN n_sep >= 2 AND 4 * n_sep >= n THEN 'navigation'
      WHEN regexp_matches(line, '(?i)' || {_quoted(quality.BOILERPLATE)}) THEN 'boilerplate' WHEN n < {quality.FEW_WORDS} THEN ''
      WHEN 2 * n_deco > n THEN 'symbols' WHEN n_letters >= 20 AND 10 * n_upper > 7 * n_letters THEN 'shouting'
      WHEN NOT ends AND NOT regexp_matches(line, {_quoted(quality.LIST_ITEM)}) THEN 'punctuation' ELSE '' END AS fault0 FROM counted),
wrapped AS (SELECT *, trim(line, {_TRIM}) AS bare FROM named),
joined AS (SELECT *, length(bare) BETWEEN 1 AND {quality.MAX_WRAP} AND fault0 IN ('', 'punctuation') AS wraps FROM wrapped),
blocks AS (SELECT *, count(*) FILTER (WHERE NOT wraps) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM joined),
wide AS (SELECT *, max(length(bare)) OVER same AS width, lead(bare) OVER (same ORDER BY i) AS following FROM blocks WHERE wraps
         WINDOW same AS (PARTITION BY doc_id, block)),
goes_on AS (SELECT *, coalesce(width >= {quality.MIN_WRAP} AND 4 * (length(bare) + 1 + length({_words('following')}[1])) > 3 * width, false) AS on_
            FROM wide),
paragraphs AS (SELECT *, count(*) FILTER (WHERE NOT on_) OVER (PARTITION BY doc_id, block ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS para
               FROM goes_on),
excused AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER para AS size, bool_or(ends) OVER para AS ended FROM paragraphs
              WINDOW para AS (PARTITION BY doc_id, block, para)) p WHERE size > 1 AND ended),
faulty AS (SELECT named.*, fault0 <> '' AND excused.i IS NULL AS fault FROM named LEFT JOIN excused USING (doc_id, i)),
per_line AS (SELECT doc_id, count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS n_dup_lines,
                    sum(n) FILTER (WHERE NOT fault) AS n_good FROM faulty GROUP BY doc_id),
report AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                  coalesce(n_good, 0) AS n_good
           FROM worded JOIN per_line USING (doc_id) LEFT JOIN repeated USING (doc_id)),
judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
                  CASE WHEN n_words > 0 THEN 1 - n_good / n_words ELSE 0.0 END::DOUBLE AS lost_share FROM report)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_share,
       NOT base_failed AND lost_share <= {quality.MAX_LOST} AS kept FROM judged"""


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"


def _crc32(x: str) -> str:
    """CRC-32 of an ASCII string: each byte, then eight steps of a bit."""
    steps = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, k: xor(r >> 1, (r & 1) * 3988292384))"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({x}, ''), lambda ch: ascii(ch)::BIGINT)), "
            f"lambda c, b: {steps}), 4294967295)")


def _levels(name: str, levels: int) -> str:
    """``name0`` (tree, pos, d, n) level by level, and the runs of each level."""
    out = []
    for i in range(levels):
        out.append(f"{name}{i + 1} AS (SELECT tree, pos // 3 AS pos, CASE WHEN any_value(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END "
                   f"AS d, (any_value(n) + 2) // 3 AS n FROM {name}{i} GROUP BY tree, pos // 3)")
        out.append(f"{name}_runs{i} AS (SELECT tree AS t, pos // 3 AS run, list(d ORDER BY pos) AS ds, any_value(n) AS n FROM {name}{i} GROUP BY tree, pos // 3)")
    return ",\n".join(out)


def _paths(name: str, tree: str, levels: int, of: str) -> str:
    """Rows of ``of``0 (.., pos, proof, folded) up the tree."""
    left, right = "array_to_string(ds[1:pos % 3], '')", "array_to_string(ds[pos % 3 + 2:], '')"
    return ",\n".join(
        f"{of}{i + 1} AS (SELECT {of}{i}.* REPLACE (pos // 3 AS pos, proof || {left} || {right} AS proof, "
        f"CASE WHEN n = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded) "
        f"FROM {of}{i} JOIN {name}_runs{i} ON t = {tree} AND run = pos // 3)" for i in range(levels))


#: Levels that are written out: groups of up to 3^14 rows, up to 3^8 groups.
_ROWS, _GROUPS = 14, 8
_HASHED = "sha256(concat(" + ", ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + "))"
MERKLE = f"""
WITH leaves AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {_HASHED.format(text="text")} AS d,
    CASE WHEN {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 2 = 0 THEN {_HASHED.format(text="replace(text, chr(10), '')")}
         ELSE {_HASHED.format(text="text")} END AS o FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
l0 AS (SELECT tree, pos, d, n FROM placed),
{_levels("l", _ROWS)},
p0 AS (SELECT doc_id, tree, d AS leaf, pos, '' AS proof, o AS folded FROM placed),
{_paths("l", "tree", _ROWS, "p")},
g0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, d, count(*) OVER () AS n, tree AS grp FROM l{_ROWS}),
{_levels("g", _GROUPS)},
q0 AS (SELECT doc_id, leaf, p{_ROWS}.tree, g0.d AS subroot, g0.pos, proof, folded FROM p{_ROWS} JOIN g0 ON grp = p{_ROWS}.tree),
{_paths("g", "''", _GROUPS, "q")}
SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.d AS verified
FROM q{_GROUPS} CROSS JOIN (SELECT d FROM g{_GROUPS}) r"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": DECONTAMINATION, "op6_url_filters": URL_FILTERS, "op7_line_dedup": LINE_DEDUP,
            "op8_quality_rules": QUALITY, "op12_merkle_manifest": MERKLE}

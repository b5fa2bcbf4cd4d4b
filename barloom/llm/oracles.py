"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

_DUE = """CASE kind
  WHEN 0 THEN CASE WHEN share * 1.0::DOUBLE < 1.0::DOUBLE
    THEN 0.0::DOUBLE + 2.0::DOUBLE * (share * 1.0::DOUBLE - 0.0::DOUBLE)
         / (1.5::DOUBLE + sqrt(2.25::DOUBLE + -2.0::DOUBLE * (share * 1.0::DOUBLE - 0.0::DOUBLE)))
    ELSE 1.0::DOUBLE END
  WHEN 1 THEN CASE WHEN share < 1.0::DOUBLE
    THEN 2.0::DOUBLE * share / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 0.0::DOUBLE * share))
    ELSE 1.0::DOUBLE END
  ELSE CASE
    WHEN share * 0.875::DOUBLE < 0.25::DOUBLE
    THEN 2.0::DOUBLE * (share * 0.875::DOUBLE)
         / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 0.0::DOUBLE * (share * 0.875::DOUBLE)))
    WHEN share * 0.875::DOUBLE < 0.875::DOUBLE
    THEN 0.5::DOUBLE + 2.0::DOUBLE * (share * 0.875::DOUBLE - 0.25::DOUBLE)
         / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 6.0::DOUBLE * (share * 0.875::DOUBLE - 0.25::DOUBLE)))
    ELSE 1.0::DOUBLE END
  END"""

OP2 = f"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size
  FROM documents
), sized AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind,
    ([5.0, 2.0, 1.0]::DOUBLE[])[kind + 1] AS weight, 2.0::DOUBLE * source_size AS most
  FROM sized
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(most) OVER filling, 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER filling, 0)) AS level
  FROM weighed
  WINDOW filling AS (ORDER BY most / weight, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, kind, least(most, weight * max(level) OVER ()) AS target FROM levels
), lined AS (
  SELECT r.*, g.source_size, g.kind, g.target, floor(g.target + 0.5)::BIGINT AS goal,
    (sum(r.size) OVER (PARTITION BY r.source ORDER BY md5(r.doc_id::VARCHAR), r.doc_id
                       ROWS UNBOUNDED PRECEDING) - r.size)::BIGINT AS start
  FROM rows r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source
), cut AS (
  SELECT *, greatest(0, least(size, goal - start)) AS first_words,
    greatest(0, least(size, goal - start - source_size)) AS second_words,
    least(start::DOUBLE / target, 1.0) AS share
  FROM lined
)
SELECT doc_id, source, size, source_size, target, (first_words + second_words)::BIGINT AS taken,
  CASE WHEN first_words > 0 THEN {_DUE} END AS position
FROM cut
"""

OP4 = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda l: regexp_matches(l, '{WORD}')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM texts)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + d)::BIGINT AS n
  FROM repeated, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id
), measured AS (
  SELECT t.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(body, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(body) - length(translate(body, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines,
    (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g')))::BIGINT AS n_capitals
  FROM texts t LEFT JOIN covered c ON t.doc_id = c.doc_id
), failing AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_capitals > word_chars THEN 32 ELSE 0 END)::BIGINT AS failed
  FROM measured
)
SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM failing
"""

ABLATION = (
    OP4[: OP4.rindex("SELECT *, failed & 3")].rstrip()
    + """, rules(rule, bit) AS (
  VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8),
    ('word_length', 16), ('capitals', 32)
), policies(policy, used) AS (VALUES ('base', 3), ('2', 63))
SELECT policy, rule, count(*) FILTER (WHERE failed & bit <> 0)::BIGINT AS failing,
  count(*) FILTER (WHERE failed & used = bit)::BIGINT AS only_by_it
FROM failing, policies JOIN rules ON used & bit <> 0
GROUP BY policy, rule
"""
)

_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nr
  FROM documents
), keyed AS (
  SELECT *, {_KEY} AS line_key FROM lines
), frequent AS (
  SELECT line_key FROM keyed WHERE line_key <> ''
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, f.line_key IS NOT NULL AS gone
  FROM keyed k LEFT JOIN frequent f ON k.line_key = f.line_key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10 = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
    sha1(coalesce(html, '')) AS sha
  FROM pages
), digits AS (
  SELECT *, list_transform(range(0, 8),
    lambda g: ('0x' || substr(sha, (5 * g + 1)::INT, 5))::BIGINT) AS groups
  FROM hashed
), named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(groups, lambda v:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15)::INT + 1, 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31)::INT + 1, 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31)::INT + 1, 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31)::INT + 1, 1)), '') AS payload_digest
  FROM digits
), latest AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM named
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM latest
"""

OP11 = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), fated AS (
  SELECT *, xor(list_reduce(
      list_prepend(4294967295::BIGINT,
        list_transform(range(1, length(name) + 1), lambda i: ord(substr(name, i::INT, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
        lambda v, j: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS fate
  FROM named
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fated WHERE fate <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS nr,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    substr(role, 1, 1) AS initial
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nr) > 1 THEN 'duplicate'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY nr) AS before
  FROM numbered
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (WHERE fault = 'blank')::BIGINT AS blank,
    count(*) FILTER (WHERE fault = 'duplicate')::BIGINT AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated')::BIGINT AS truncated,
    count(*) FILTER (WHERE nr > 1 AND before || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal,
    count(*) AS n_rows
  FROM faulty GROUP BY conv_id
), inserted(state, arrives, cost, letters, lines) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']),
    (1, 1, 0, '', []), (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']),
    (2, 2, 0, '', []), (2, 3, 5, 'I', ['assistant:']),
    (3, 3, 0, '', []), (3, 2, 5, 'I', ['user:'])
), edits(letter) AS (VALUES ('D'), ('K'), ('R')
), walked AS (
  SELECT conv_id, 0::BIGINT AS nr, 0 AS state,
    {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS best
  FROM counted
  UNION ALL
  SELECT conv_id, nr, state, min(way) AS best FROM (
    SELECT w.conv_id, f.nr,
      CASE letter WHEN 'D' THEN i.arrives
        WHEN 'K' THEN CASE WHEN i.arrives = 0 AND initial = 's' THEN 1
          WHEN i.arrives <> 2 AND initial = 'u' THEN 2 WHEN i.arrives = 2 AND initial = 'a' THEN 3 END
        ELSE CASE WHEN i.arrives = 2 THEN 3 ELSE 2 END END AS state,
      {'cost': (best.cost + i.cost + CASE letter WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END
          + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END)::BIGINT,
       'audit': best.audit || letters || letter,
       'lines': best.lines || i.lines || CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
          ELSE [CASE WHEN i.arrives = 2 THEN 'assistant:' ELSE 'user:' END || text] END} AS way
    FROM walked w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.nr = w.nr + 1
      JOIN inserted i ON i.state = w.state
      JOIN edits ON letter = 'D' OR fault NOT IN ('blank', 'duplicate')
  ) ways WHERE state IS NOT NULL GROUP BY conv_id, nr, state
), ended AS (
  SELECT w.conv_id, min({'cost': (best.cost + i.cost)::BIGINT, 'audit': best.audit || letters,
    'lines': best.lines || i.lines}) AS best
  FROM walked w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n_rows = w.nr
    JOIN inserted i ON i.state = w.state AND (i.arrives = 3 OR w.state = 0 AND i.arrives = 0)
  GROUP BY w.conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
  LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""

OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?
-
]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS words FROM pieces
), found AS (
  SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM lists, (VALUES (1), (2), (3)) sizes(size))
), counts AS MATERIALIZED (
  SELECT lang, size, phrase, count(*)::BIGINT AS f, string_split(phrase, ' ') AS words,
    lang || chr(9) || phrase AS name
  FROM found GROUP BY lang, size, phrase
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT * FROM counts WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.size, c.f AS a, k, p.f AS l, q.f AS r,
    ((1000000::HUGEINT * c.f * c.f) // (p.f::HUGEINT * q.f))::BIGINT AS score
  FROM (SELECT *, lang || chr(9) || array_to_string(words[1:k], ' ') AS left_name,
          lang || chr(9) || array_to_string(words[k + 1:], ' ') AS right_name
        FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)) c
    JOIN counts p ON p.name = left_name JOIN counts q ON q.name = right_name
), loosest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(words[1:2], ' ') AS phrase, f FROM candidates WHERE size = 3
    UNION ALL
    SELECT lang, array_to_string(words[2:3], ' ') AS phrase, f FROM candidates WHERE size = 3)
  GROUP BY lang, phrase
), kept AS (
  SELECT s.* FROM loosest s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
  WHERE s.size = 3 OR g.f IS NULL OR 100 * g.f < 50 * s.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op2_mix_curriculum": OP2,
    "op4_quality_ledger": OP4,
    "op9_line_dedup": OP9,
    "op10_warc_index_first": OP10,
    "op11_dialogue_repair": OP11,
    "op12_phrase_stripes": OP12,
    "quality_ablation": ABLATION,
}

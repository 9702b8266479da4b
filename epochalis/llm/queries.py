"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .chat import op6_chat_formatting
from .decontamination import op8_decontamination
from .embeddings import op2_embedding_near_dedup
from .exact import op13_exact_dedup
from .infill import op11_fill_in_middle
from .licenses import op4_license_scan
from .lm import op10_lm_scoring
from .packing import op1_packing
from .secrets import op3_secret_scan
from .simhash import op7_simhash_near_dedup
from .structure import op12_conversation_repair
from .suffixes import op5_suffix_dedup
from .toxicity import op9_toxicity

QUERIES = {
    "op1_packing": op1_packing,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_license_scan": op4_license_scan,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_exact_dedup": op13_exact_dedup,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_MARKED = r"'<(\\*)\|', '<\\\1|', 'g'"

#: DuckDB SQL for the queries that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": """WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  ok AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
  reach(id, r) AS (SELECT vec_id, vec_id FROM e UNION SELECT id, b FROM reach JOIN links ON r = a), top AS (SELECT id, min(r) AS c FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
  SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM e JOIN top ON vec_id = id LEFT JOIN n ON vec_id = a""",
    "op6_chat_formatting": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(k, r)),
  f AS (SELECT *, concat('<|im_start|>', regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), {_MARKED}), chr(10), regexp_replace(text, {_MARKED}), '<|im_end|>', chr(10)) AS f FROM c)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, f)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, f) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(length(f))::BIGINT AS formatted_chars FROM f GROUP BY 1""",
    "op8_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
  bw AS (SELECT DISTINCT item, least(10, len(w)) AS l, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) u(i) WHERE len(w) > 0),
  dw AS (SELECT doc_id, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS g FROM d, (SELECT DISTINCT l FROM bw), unnest(range(1, greatest(len(w) - l + 2, 1))) u(i)),
  hit AS (SELECT doc_id, l, i, g FROM dw SEMI JOIN bw USING (l, g)), n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS k FROM hit) GROUP BY 1),
  its AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit JOIN bw USING (l, g) GROUP BY 1)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op11_fill_in_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('42:', doc_id)) AS h FROM documents),
  u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS r FROM d),
  c AS (SELECT *, len(w) AS n, least(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS a, greatest(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
  p AS (SELECT *, coalesce(array_to_string(w[:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid, coalesce(array_to_string(w[b + 1:], ''), '') AS suf FROM c)
  SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op12_conversation_repair": r"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
  raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
  hit AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(k, ''), lambda s: ascii(s)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS h FROM raw, crc),
  hurt AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE h <> 0),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS was FROM hurt),
  r AS (SELECT *, left(role, 1) AS c, said = '' AS blank, said <> '' AND again AS dup, said <> '' AND NOT again AND right(said, 1) NOT IN ('.', '!', '?') AS cut FROM placed),
  sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
    count(*) FILTER (WHERE was IS NOT NULL AND concat(was, c) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY 1),
  jump(p, q, ins, cost, put) AS (VALUES ('', '', '', 0, []), ('', 'u', 'I', 3, ['user:']), ('', 'a', 'II', 6, ['user:', 'assistant:']), ('s', 's', '', 0, []), ('s', 'u', 'I', 3, ['user:']), ('s', 'a', 'II', 6, ['user:', 'assistant:']),
    ('u', 'u', '', 0, []), ('u', 'a', 'I', 3, ['assistant:']), ('a', 'a', '', 0, []), ('a', 'u', 'I', 3, ['user:'])),
  edit AS (SELECT conv_id, i, q, 'D' AS e, q AS q2, 4 AS cost, []::VARCHAR[] AS put FROM r, (VALUES (''), ('s'), ('u'), ('a')) x(q)
    UNION ALL SELECT conv_id, i, q, 'K', c, 3 * cut::INT, [concat(role, ':', text)] FROM r, (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')) x(q, c2) WHERE c = c2 AND NOT blank AND NOT dup
    UNION ALL SELECT conv_id, i, q, 'R', q2, 3 + 3 * cut::INT, [concat(q3, ':', text)] FROM r, (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('a', 'u', 'user'), ('u', 'a', 'assistant')) x(q, q2, q3) WHERE NOT blank AND NOT dup),
  step(conv_id, i, q, best) AS (SELECT conv_id, 0::BIGINT, '', {'cost': 0, 'audit': '', 'said': []::VARCHAR[]} FROM sums
    UNION ALL SELECT s.conv_id, s.i + 1, e.q2, min({'cost': (s.best).cost + j.cost + e.cost, 'audit': concat((s.best).audit, j.ins, e.e), 'said': list_concat((s.best).said, list_concat(j.put, e.put))})
      FROM step s JOIN jump j ON s.q = j.p JOIN edit e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.i = s.i + 1 AND e.q = j.q GROUP BY s.conv_id, s.i, e.q2),
  final AS (SELECT s.conv_id, min({'cost': (s.best).cost + j.cost, 'audit': concat((s.best).audit, j.ins), 'said': list_concat((s.best).said, j.put)}) AS best FROM step s JOIN sums ON s.conv_id IS NOT DISTINCT FROM sums.conv_id AND s.i = sums.n JOIN jump j ON s.q = j.p AND j.q IN ('', 'a') GROUP BY 1)
  SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce((best).cost, 0)::BIGINT AS cost, coalesce((best).audit, '') AS audit, sha256(coalesce(array_to_string((best).said, chr(10)), '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums ON o.conv_id IS NOT DISTINCT FROM sums.conv_id LEFT JOIN final ON o.conv_id IS NOT DISTINCT FROM final.conv_id""",
    "op13_exact_dedup": r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
  SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)""",
}

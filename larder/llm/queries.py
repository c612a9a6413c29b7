"""The registered queries of this package, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import conversations, exact_dedup, langid, neighbours, ngram_join, packing, paragraph_dedup, pieces, spelling, suffix_dedup, token_counts, toxicity, warc
from larder.llm.common import read

#: SQL for crc32: the table `crc_table(t)`, and the checksum of a list of bytes `b` where `t` is in reach.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
)"""
CRC = "xor(list_reduce([4294967295::BIGINT] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


def public_tokenizer(name: str) -> str:
    """Where the environment keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(read(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraph_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeated_bytes(read(spark, sf_dir, "documents"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))  # a removed span may cut a character
    return rows.select("doc_id", text.alias("text"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP6_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), l AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingles FROM w
), s AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM l),
linked AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, linked.y FROM reach JOIN linked ON reach.other = linked.x
)
SELECT l.doc_id, len(l.shingles) AS n_shingles, min(reach.other) AS component_id FROM l JOIN reach USING (doc_id) GROUP BY ALL
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(read(spark, sf_dir, "documents")))


OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
  GROUP BY ALL
), bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END)) AS b
  FROM runs WHERE length(run) >= 6
), hashed AS (SELECT run, n, {CRC} AS h FROM bytes, crc_table),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6
), shorter AS (
  SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word
), best AS (
  SELECT x.word, x.n, near.other, o.n AS other_n, count(*) OVER (PARTITION BY x.word) AS n_near
  FROM near JOIN words x ON x.word = near.word JOIN words o ON o.word = near.other
  QUALIFY row_number() OVER (PARTITION BY x.word ORDER BY o.n DESC, near.other) = 1
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word
), follow(word, root) AS (
  SELECT word, word FROM words UNION ALL SELECT follow.word, forms.form FROM follow JOIN forms ON forms.word = follow.root WHERE form IS NOT NULL
)
SELECT forms.word, form, root, forms.n, n_near, form_n
FROM forms JOIN (SELECT f.word, f.root FROM follow f JOIN forms l ON l.word = f.root AND l.form IS NULL) r ON r.word = forms.word
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damage_and_repair(read(spark, sf_dir, "conversations"))


OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT) AS b
  FROM conversations
), coded AS (SELECT conv_id, turn, role, text, {CRC} % 20 AS code FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS time
  FROM coded WHERE code <> 0
), sorted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged
), placed AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS role_before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM sorted
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (role_before IS NOT NULL AND left(role_before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM placed GROUP BY conv_id
), ways(state, k, here, added) AS (VALUES
  (0, 0, 0, []::VARCHAR[]), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']),
  (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
  (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']),
  (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])
), walk(conv_id, pos, state, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, 0, 0::BIGINT, '', []::VARCHAR[] FROM counted
  UNION ALL
  SELECT conv_id, pos, after, cost, audit, lines FROM (
    SELECT conv_id, pos, after, cost + 3 * k + price AS cost, audit || repeat('I', k) || letter AS audit,
      lines || added || CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
        ELSE [CASE after WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END AS lines
    FROM (
      SELECT w.conv_id, p.pos, w.cost, w.audit, w.lines, v.k, v.added, p.role, p.text, l.letter,
        CASE WHEN l.letter = 'D' THEN v.here WHEN p.fault IN ('blank', 'duplicate') THEN NULL
          WHEN l.letter = 'R' THEN CASE WHEN v.here = 2 THEN 3 ELSE 2 END
          WHEN left(p.role, 1) = 's' AND v.here = 0 THEN 1 WHEN left(p.role, 1) = 'u' AND v.here <> 2 THEN 2
          WHEN left(p.role, 1) = 'a' AND v.here = 2 THEN 3 END AS after,
        CASE l.letter WHEN 'D' THEN 4 ELSE CASE l.letter WHEN 'R' THEN 3 ELSE 0 END + CASE p.fault WHEN 'truncated' THEN 3 ELSE 0 END END AS price
      FROM walk w JOIN placed p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.pos = w.pos + 1 JOIN ways v ON v.state = w.state
        CROSS JOIN (VALUES ('D'), ('K'), ('R')) l(letter)
    ) WHERE after IS NOT NULL
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, pos, after ORDER BY cost, audit) = 1
), ended AS (
  SELECT w.conv_id, w.cost + 3 * v.k AS cost, w.audit || repeat('I', v.k) AS audit, array_to_string(w.lines || v.added, chr(10)) AS repaired
  FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.pos JOIN ways v ON v.state = w.state AND v.here IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 3 * v.k, w.audit || repeat('I', v.k)) = 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
  LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g USING (norm)
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_pieces": op3_pieces,
    "op4_paragraph_dedup": op4_paragraph_dedup,
    "op5_neighbours": op5_neighbours,
    "op6_warc": op6_warc,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_language_id": op10_language_id,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_counts": op13_token_counts,
}
ORACLES = {
    "op6_warc": OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_ngram_join": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_conversation_repair": OP12_SQL,
}

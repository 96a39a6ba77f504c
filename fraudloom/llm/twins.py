"""SQL twins of the operators that SQL can express."""

#: CRC-32 by half bytes: the table follows from the polynomial, the low half of each byte comes first
_CRC = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(4)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(16) r(i))),
halves AS (
  SELECT s, list_transform(range(length(h)), lambda k: instr('0123456789abcdef', c[xor(k, 1) + 1]) - 1) AS x
  FROM (SELECT s, h, string_split(h, '') AS c FROM (SELECT s, lower(hex(encode(s))) AS h FROM strings))),
crcs AS (
  SELECT s, xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda c, k: xor(c >> 4, t[(xor(c, k) & 15) + 1])), 4294967295) AS crc
  FROM halves, crc_table)"""

SHARDS = f"""WITH RECURSIVE owners AS (
  SELECT i::INTEGER AS virtual_slot, 1 AS shards, 0 AS shard, i AS place FROM range(4096) r(i)
  UNION ALL
  SELECT virtual_slot, shards + 1, CASE WHEN moved THEN shards ELSE shard END,
    CASE WHEN moved THEN row_number() OVER (PARTITION BY moved ORDER BY shard, place) - 1 ELSE place END
  FROM (SELECT *, place >= 4096 // (shards + 1) + CASE WHEN shard < 4096 % (shards + 1) THEN 1 ELSE 0 END AS moved
        FROM owners WHERE shards < 17)),
strings AS (SELECT DISTINCT coalesce(text, '') AS s FROM documents),
{_CRC},
rows_ AS (
  SELECT doc_id, (octet_length(encode(s)) + 1)::BIGINT AS size, crc AS text_crc32,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text ' || crc)), 1, 3))::INTEGER AS virtual_slot
  FROM documents JOIN crcs ON s = coalesce(text, ''))
SELECT doc_id, size, text_crc32, 'key' AS law, a.shard,
  row_number() OVER (PARTITION BY a.shard ORDER BY a.place, doc_id NULLS LAST, size, text_crc32) - 1 AS slot,
  b.shard AS grown_shard, virtual_slot, (sum(size) OVER (PARTITION BY virtual_slot))::BIGINT AS slot_bytes
FROM rows_ JOIN (FROM owners WHERE shards = 16) a USING (virtual_slot) JOIN (FROM owners WHERE shards = 17) b USING (virtual_slot)"""

RESAMPLE = f"""WITH texts AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
worded AS (
  SELECT side, r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM texts),
featured AS (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s
  FROM worded),
strings AS (SELECT DISTINCT s FROM featured),
{_CRC},
bucketed AS (SELECT side, r, crc % 10000 AS b FROM featured JOIN crcs USING (s)),
per_bucket AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM bucketed GROUP BY b),
sides AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM per_bucket),
gained AS (
  SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM per_bucket, sides),
weighed AS (
  SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM bucketed JOIN gained USING (b) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT doc_id, r, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296)))::BIGINT AS score
  FROM worded LEFT JOIN weighed USING (r) WHERE side = 0),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)"""

"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeline.llm import decontaminate, licenses, lines, manifest, packing, pieces, quality, secrets, sharding, simhash, spelling, tokens, warc
from strikeline.llm.common import ship, table
from strikeline.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Where the vocabulary file of a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(fn: Callable[[SparkSession, str], DataFrame]):  # noqa: ANN202
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_packing")
def op1(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    x = packing.pack(table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"))
    return x.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group")


DIGEST = "".join(f" || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {5 * (3 - k)}) & 31 AS INTEGER) + 1, 1)" for k in range(4)).removeprefix(" || ")
OP2_SQL = f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
s AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i: {DIGEST.replace("v >>", "CAST('0x' || substr(hex, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT) >>")}), '') AS payload_digest FROM s),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM m
"""


@query("op2_warc", OP2_SQL)
def op2(spark: SparkSession, d: str) -> DataFrame:
    """Every page's record, written to archives, read back and put in global capture order."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, d, "pages"), folder)
    x = warc.merge_runs(warc.read_archives(spark, folder))
    return x.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Words are [^\x20\x09-\x0D]+; a line fails by the rules of quality.line_fails, in their order.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents),
l AS (SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw, lower(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS bare
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
j AS (SELECT r, line, len(lw) AS n,
        length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) > 0.25 * len(lw)
        OR (len(lw) >= 4 AND 2 * len(list_filter(lw, lambda x: suffix(x, '!'))) > len(lw))
        OR (len(lw) < 12 AND (
          (len(lw) < 4 AND NOT regexp_matches(bare, '[.!?:;,"'')\]…”»。！？]$'))
          OR len(list_filter(lw, lambda x: NOT list_contains({menu}, lower(trim(x, '.,:;!?|>/'))))) = 0
          OR len(regexp_extract_all(line, '[\x20\x09-\x0D](?:>|»|/|·|›)[\x20\x09-\x0D]')) * 3 >= len(lw)
          OR regexp_matches(bare, '{notices}'))) AS fails
      FROM l WHERE len(lw) > 0),
a AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fails) AS n_lines_removed, coalesce(sum(n) FILTER (fails), 0) AS n_words_removed FROM j GROUP BY r),
u AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
v AS (SELECT * FROM (SELECT r, i, x || ' ' || lead(x, 1) OVER q || ' ' || lead(x, 2) OVER q || ' ' || lead(x, 3) OVER q || ' ' || lead(x, 4) OVER q AS five FROM u WINDOW q AS (PARTITION BY r ORDER BY i)) WHERE five IS NOT NULL),
p AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (
        SELECT v.r, unnest(range(i, i + 5)) AS k FROM v JOIN (SELECT r, five FROM v GROUP BY 1, 2 HAVING count(*) > 1) USING (r, five)) GROUP BY r),
c AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(n_words_removed, 0) AS n_words_removed
      FROM d LEFT JOIN a USING (r) LEFT JOIN p USING (r))
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words_removed <= CAST(0.3 AS DOUBLE) * n_words AS kept, n_lines, n_lines_removed, CAST(n_words_removed AS BIGINT) AS n_words_removed
FROM c
""".replace("{menu}", str([*sorted(quality.MENU), ""])).replace("{notices}", quality.NOTICES.pattern.decode())


@query("op3_quality", OP3_SQL)
def op3(spark: SparkSession, d: str) -> DataFrame:
    """Counts and verdict of every document."""
    x = quality.score_lines(table(spark, d, "documents").select("doc_id", "text"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "n_words_removed")


@query("op4_simhash")
def op4(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint and component of every document; 4-word shingles, 4 bits."""
    x = simhash.near_duplicates(table(spark, d, "documents"), shingle=4, distance=4)
    return x.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_tokens")
def op5(spark: SparkSession, d: str) -> DataFrame:
    """Token count of every document."""
    x = tokens.count_tokens(table(spark, d, "documents"), vocabulary("piece_bpe_32k.model"))
    return x.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query("op6_lines")
def op6(spark: SparkSession, d: str) -> DataFrame:
    """Every line of the documents with the first line of its class, and whether it stays."""
    return lines.line_classes(table(spark, d, "documents")).drop("text_id")


@query("op7_secrets")
def op7(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate for a secret in the documents, with the forest's verdict; values as checksums."""
    x = secrets.scan(table(spark, d, "documents"))
    return x.select("doc_id", "word_no", "kind", F.sha2("value", 256).alias("value_sha256"), "value_length", "score", "is_secret")


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BASE = ", ".join(f"('{p}', '{label}')" for p, label in licenses.BASE.items())
_TEMPLATES = ", ".join(f"({k}, '{label}', '{t}', {phrases})" for k, (label, t, phrases) in enumerate(licenses.TEMPLATES))
OP8_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_W} AS w FROM documents),
b AS (SELECT string_split(p, ' ') AS q, label FROM (VALUES {_BASE}) x(p, label)),
t AS (SELECT k, label, string_split(words, ' ') AS tw, phrases FROM (VALUES {_TEMPLATES}) x(k, label, words, phrases)),
tp AS (SELECT k, unnest(tw) AS x, unnest(range(len(tw))) AS place FROM t),
s AS MATERIALIZED (SELECT r, doc_id, x, i - 1 AS i FROM (SELECT r, doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d)
  WHERE x IN (SELECT x FROM tp UNION SELECT unnest(q) FROM b)),
f AS (SELECT x, count(DISTINCT r) AS df FROM s WHERE x IN (SELECT x FROM tp) GROUP BY 1),
rare AS (SELECT x FROM f),
hit AS (SELECT s.r, s.i, b.label FROM s JOIN b ON s.x = b.q[1] JOIN d USING (r) WHERE d.w[s.i + 1:s.i + len(b.q)] = b.q),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS bl FROM hit GROUP BY 1),
top AS (SELECT DISTINCT s.r, s.x FROM s JOIN rare USING (x)),
o AS (SELECT s.r, tp.k, s.i - tp.place AS start, count(*) AS n FROM s JOIN top USING (r, x) JOIN tp USING (x) GROUP BY ALL),
reach AS (SELECT k, count(*) AS reach FROM tp JOIN rare USING (x) GROUP BY 1),
c AS (SELECT o.r, t.label, n, reach, phrases, ' ' || array_to_string(d.w[greatest(start, 0) + 1:start + len(tw)], ' ') || ' ' AS covered
  FROM o JOIN reach USING (k) JOIN t USING (k) JOIN d USING (r) WHERE n >= greatest(1.0, CAST(0.6 AS DOUBLE) * reach) AND start + len(tw) > 0),
own AS (SELECT r, list(DISTINCT label) AS ol, max(least(1.0, n / reach)) AS share FROM c WHERE len(list_filter(phrases, lambda p: NOT contains(covered, ' ' || p || ' '))) = 0 GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(coalesce(bl, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ol, [])))), ',') AS labels, CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN own USING (r)
"""


@query("op8_licenses", OP8_SQL)
def op8(spark: SparkSession, d: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return licenses.scan(table(spark, d, "documents"))


@query("op9_decontamination")
def op9(spark: SparkSession, d: str) -> DataFrame:
    """Every place of a benchmark item in a document."""
    return decontaminate.find_passages(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op10_sharding")
def op10(spark: SparkSession, d: str) -> DataFrame:
    """All documents in eight contiguous shards of nearly equal bytes."""
    x = sharding.shard(table(spark, d, "documents"), 8)
    return x.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

# Near words share what is left without the letter of one place, or one is what is left of the other.
_SLIP = """CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END"""
_STEPS = "flatten(list_transform(range(octet_length(b)), lambda i: [CAST('0x' || substr(hex(b), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
OP11_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
u AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM t GROUP BY ALL),
b AS (SELECT run, k, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS b FROM u),
h AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, {_STEPS}), lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1)))) AS h FROM b),
w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT {_SLIP} AS word, k FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
r AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT x.word AS a, y.word AS b FROM r x JOIN r y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT rest, r.word FROM r JOIN w ON w.word = rest UNION SELECT r.word, rest FROM r JOIN w ON w.word = rest),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-y.n, b)) AS top, max(y.n) AS top_n FROM near JOIN w y ON y.word = b GROUP BY a),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 2 * n THEN top END AS form, CASE WHEN top_n >= 2 * n THEN top_n END AS form_n FROM w LEFT JOIN best USING (word)),
c AS (SELECT word, word AS last FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n FROM f JOIN c USING (word) JOIN f e ON e.word = c.last WHERE e.form IS NULL
"""


@query("op11_spelling", OP11_SQL)
def op11(spark: SparkSession, d: str) -> DataFrame:
    """Words of all documents, one distinct run of a document in 97 with a letter lost, with their forms and roots."""
    return spelling.spelling_variants(table(spark, d, "documents"), slips=97).select("word", "form", "root", "n", "n_near", "form_n")


# A leaf is H of its fields; trees of the groups, then of their roots; paths, and folds from the changed leaf along them.
_H = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_H.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_BYTES = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c), 0, 0, 0, 0, 0, 0, 0]))"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295, {_BYTES}), lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1))))"
OP12_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, coalesce({_CRC} % 7 = 0, false) AS hit,
    {_LEAF.format(n="(n_chars + 1)")} AS other FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS m FROM d),
up AS (SELECT lang, 0 AS lvl, pos, leaf AS h, m FROM p
  UNION ALL SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (m + 1) // 2 FROM up WHERE m > 1 GROUP BY lang, lvl, pos // 2, m),
g AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS gpos, count(*) OVER () AS m FROM up WHERE m = 1),
top AS (SELECT 0 AS lvl, gpos AS pos, subroot AS h, m FROM g
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (m + 1) // 2 FROM top WHERE m > 1 GROUP BY lvl, pos // 2, m),
path AS MATERIALIZED (
  SELECT r, l.lvl, (p.pos >> l.lvl) & 1 AS bit, up.h FROM p JOIN (SELECT DISTINCT lang, lvl FROM up WHERE m > 1) l ON l.lang IS NOT DISTINCT FROM p.lang
    LEFT JOIN up ON up.lang IS NOT DISTINCT FROM p.lang AND up.lvl = l.lvl AND up.pos = xor(p.pos >> l.lvl, 1)
  UNION ALL SELECT r, 1000 + l.lvl, (g.gpos >> l.lvl) & 1, top.h FROM p JOIN g ON g.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT DISTINCT lvl FROM top WHERE m > 1) l
    LEFT JOIN top ON top.lvl = l.lvl AND top.pos = xor(g.gpos >> l.lvl, 1)),
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl) AS k FROM path),
f AS (SELECT r, 0 AS k, CASE WHEN hit AND other IS NOT NULL THEN other ELSE leaf END AS h FROM p
  UNION ALL SELECT f.r, f.k + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.bit = 0 THEN f.h || s.h ELSE s.h || f.h END) FROM f JOIN s ON s.r = f.r AND s.k = f.k + 1),
last AS (SELECT r, arg_max(h, k) AS folded FROM f GROUP BY r),
proof AS (SELECT r, sha256(coalesce(string_agg(h, '' ORDER BY lvl), '')) AS proof FROM path GROUP BY r)
SELECT doc_id, leaf, g.subroot, t.h AS root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = t.h AS verified
FROM p JOIN g ON g.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT h FROM top WHERE m = 1) t JOIN last USING (r) LEFT JOIN proof USING (r)
"""


@query("op12_manifest", OP12_SQL)
def op12(spark: SparkSession, d: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that its leaf gives where a seventh of them is tampered with."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = [F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars")) if c == "n_chars" else F.col(c) for c in fields]
    x = manifest.manifest(table(spark, d, "documents"), fields, changed=changed)
    x = manifest.with_folds(x, F.coalesce("changed", "leaf"))
    hexed = {c: F.lower(F.hex(n)) for c, n in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof_sha256", "proof"), ("folded_root", "folded"))}
    return x.select("doc_id", *[e.alias(c) for c, e in hexed.items()], (F.col("folded") == F.col("root")).alias("verified"))


@query("op13_sentencepiece")
def op13(spark: SparkSession, d: str) -> DataFrame:
    """Piece ids of every document and the text they decode to, as digests."""
    model = vocabulary("piece_bpe_32k.model")
    ids = pieces.encode_texts(table(spark, d, "documents").select("doc_id", "text"), model).select("doc_id", "ids")
    back = pieces.decode_ids(ids, model)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

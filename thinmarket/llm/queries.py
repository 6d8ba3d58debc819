"""The operators applied to the provided tables: thin steps that map columns in and results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinmarket.llm import archive, audit, bpe, codes, decontaminate, hosts, lines, neighbours, placement, quality, render, replies, secrets
from thinmarket.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scraped articles."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("article_id"), F.col("text").alias("body"), F.col("lang").alias("language"), "source"
    )


MEASURED_SQL = r"""
  WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
  grams AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
  twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM grams) WHERE k > 1),
  cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM twice) GROUP BY 1),
  ln AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
  lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM ln GROUP BY 1),
  m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
               CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines,
               CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
               CAST(len(list_filter(words, lambda x: NOT regexp_matches(x, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS BIGINT) AS n_bare_words
        FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN lines USING (doc_id)),
  ledger AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 25 * n_words)::INT
               + 8 * (100 * n_dup_lines > 40 * n_lines)::INT + 16 * (100 * n_bare_words > 30 * n_words)::INT
               + 32 * (word_chars < 2 * n_words OR word_chars > 12 * n_words)::INT AS BIGINT) AS fail_bits FROM m)
"""


@register("op1_quality_rules", MEASURED_SQL + """
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept,
         n_lines, n_bare_words, fail_bits, fail_bits & 15 = 0 AS kept_v1, o.rule AS only_rule, o.n_only AS only_rule_rows, o.n_failed AS only_rule_failed
  FROM ledger LEFT JOIN (SELECT rule, bit, (SELECT count(*) FILTER (WHERE fail_bits & bit <> 0) FROM ledger) AS n_failed, (SELECT count(*) FILTER (WHERE fail_bits = bit) FROM ledger) AS n_only
    FROM (VALUES ('too_short', 1), ('repeats_itself', 2), ('symbol_heavy', 4), ('repeated_lines', 8), ('few_letters', 16), ('word_length', 32)) r(rule, bit)) o ON o.bit = ledger.fail_bits""")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the verdict of two policies and, if one rule alone rejects it, the ablation's counts of that rule."""
    ensure_checkpoint_dir(spark)
    ledger = quality.rule_ledger(articles(spark, sf_dir)).withColumn("only_rule", quality.only_rule("v2")).checkpoint()
    counts = quality.ablation(ledger, "v2").select(F.col("rule").alias("only_rule"), F.col("n_only").alias("only_rule_rows"), F.col("n_failed").alias("only_rule_failed"))
    # At most one row a rule.
    return ledger.join(F.broadcast(counts), "only_rule", "left").select(
        F.col("article_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.kept("base")).alias("base_failed"), quality.kept("v2").alias("kept"), "n_lines", "n_bare_words", "fail_bits",
        quality.kept("v1").alias("kept_v1"), "only_rule", "only_rule_rows", "only_rule_failed",
    )


@register("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(articles(spark, sf_dir))
    return out.select(F.col("article_id").alias("doc_id"), F.col("body").alias("text"), "n_removed_lines")


@register("op5_decontamination", r"""
  WITH low AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  itm AS (SELECT item_id, w, least(len(w), 10) AS size FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
  win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM itm)),
  sizes AS (SELECT DISTINCT size FROM win),
  runs AS (SELECT id, size, i, array_to_string(w[i:i + size - 1], ' ') AS t FROM (SELECT id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM low, sizes WHERE len(w) >= size)),
  hits AS (SELECT id, i, r.size, item_id FROM runs r JOIN win USING (size, t)),
  cover AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
  named AS (SELECT id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY 1)
  SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
         sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM low LEFT JOIN cover USING (id) LEFT JOIN named USING (id)""")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark_passages(articles(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("article_id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@register("op2_ngram_jaccard_join")
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(articles(spark, sf_dir)).withColumnRenamed("article_id", "doc_id")


@register("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_articles(articles(spark, sf_dir), tokenizer_path()).withColumnRenamed("article_id", "doc_id")


@register("op6_secret_scans")
def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(articles(spark, sf_dir))
    return found.select(
        F.col("article_id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(F.array_join("base_spans", ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"), "n_live", "n_examples",
    )


PAGE_RULES = [
    hosts.Rule("allow", "org", "/"), hosts.Rule("block", "example.org", "/es/"), hosts.Rule("block", "example.org", "/en/1"),
    hosts.Rule("allow", "com", "/fr/"), hosts.Rule("block", "com", "/de/"),
]


@register("op7_url_filters")
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), PAGE_RULES)


@register("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = placement.shard_manifest(articles(spark, sf_dir), placement.even_tree(8))
    return told.select(F.col("article_id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


@register("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@register("op8_warc", """
  WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
  f AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1),
  parts AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // k) % 32 AS INT) + 1, 1), '' ORDER BY j, k DESC) AS d
            FROM (SELECT h, j, CAST('0x' || substr(h, CAST(5 * j + 1 AS INT), 5) AS BIGINT) AS v FROM f, range(8) r(j)), (VALUES (32768), (1024), (32), (1)) s(k) GROUP BY 1)
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, d AS payload_digest,
         CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
  FROM p JOIN f USING (h) JOIN parts USING (h)""")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@register("op11_vector_codes", """
  WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS (SELECT vec_id, label, q, v[q * 16 + 1:q * 16 + 16] AS v FROM k, range(4) r(q)),
  e0 AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS e, v FROM p QUALIFY e < 256),
""" + ",\n".join(f"""
  a{i} AS (SELECT vec_id, any_value(p.label) AS label, p.q, arg_min(e, d * 256 + e) AS e, min(d) AS d, any_value(p.v) AS v
           FROM (SELECT p.vec_id, p.label, p.q, p.v, c.e, list_sum(list_transform(range(1, 17), lambda j: (p.v[j] - c.v[j]) * (p.v[j] - c.v[j]))) AS d FROM p JOIN e{i} c USING (q)) p GROUP BY vec_id, p.q)""" + (f""",
  s{i} AS (SELECT q, e, j, CAST(floor(sum(v[j]) / count(*)) AS BIGINT) AS x FROM (SELECT q, e, v, unnest(range(1, 17)) AS j FROM a{i}) GROUP BY q, e, j),
  n{i} AS (SELECT q, e, list(x ORDER BY j) AS v FROM s{i} GROUP BY q, e),
  e{i + 1} AS (SELECT q, e, coalesce(n.v, o.v) AS v FROM e{i} o LEFT JOIN n{i} n USING (q, e))""" if i < 4 else "") for i in range(5)) + """,
  h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY q, e)) AS codebooks_sha256 FROM e4),
  c AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(lpad(hex(e), 2, '0')), '' ORDER BY q) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id)
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h""")
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("card_id"), F.col("embedding").alias("window"), "label")
    found, books = codes.compress_windows(windows)
    listed = F.array_sort(F.collect_list(F.struct("part", "entry", "components")))
    text = F.array_join(F.flatten(F.transform(listed, lambda b: b["components"])), ",")
    digest = books.agg(F.sha2(text.cast("binary"), 256).alias("d")).first().d
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    told = codes.with_group_error(found.withColumn("code", code), "label")
    return told.select(F.col("card_id").alias("vec_id"), "code", "error", F.col("group_error").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))


@register("op12_reply_trees", r"""
  WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
             UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
  f AS (SELECT conv_id, turn, role, text,
               '<s>' || role || chr(10) || CASE WHEN role = 'assistant' THEN '' ELSE '[INST] ' END || regexp_replace(text, '(\\*(?:</?s>|\[/?INST\]))', '\\\1', 'g')
               || CASE WHEN role = 'assistant' THEN '' ELSE ' [/INST]' END || chr(10) || '</s>' AS piece FROM t)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
  FROM f GROUP BY conv_id""")
def op12_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("run_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("content"))
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "run_id long, turn long, role string, content string")
    told = replies.format_replies(replies.linear_replies(turns.unionByName(extra)))
    return replies.conversation_digests(told).withColumnRenamed("run_id", "conv_id")


@register("op13_filter_audit", r"""
  WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
  m AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
               (len(w) < 50)::INT AS a, (100 * len(list_distinct(w)) < 65 * len(w))::INT AS b, (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::INT AS c,
               regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS e
        FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
  cells AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
  f AS (SELECT i, substr('ABCDE', CAST(i AS INT) + 1, 1) AS x FROM range(5) r(i)),
  o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.i, q.i, r.i, s.i, t.i] AS fs FROM f p, f q, f r, f s, f t
        WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
  steps AS (SELECT filter_order, k AS step, fs[k] AS x, CAST(1 << fs[k] AS BIGINT) AS bit, CAST(coalesce(list_sum(list_transform(fs[1:k - 1], lambda z: 1 << z)), 0) AS BIGINT) AS before FROM o, range(1, 6) r(k)),
  out AS (SELECT part, filter_order, step, x, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
                 sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                 sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
          FROM cells, steps GROUP BY 1, 2, 3, 4)
  SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
         CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM out""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "article_id")
    return audit.audit_filters(articles(spark, sf_dir), labels).withColumnRenamed("source", "part")

"""The operators as queries over the driver tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwise.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ledgerwise.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwise.llm.pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwise.llm.language_id import fit, predict

    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwise.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwise.llm.quality import judge

    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwise.functions.storage import cut_lineage
    from ledgerwise.llm.preference import conversations, format_pairs, pairs_by_first_turn, pairs_with_foreign_reply

    convs = cut_lineage(conversations(_table(spark, sf_dir, "conversations")))
    pairs = pairs_by_first_turn(convs).withColumn("kind", F.lit("shared first turn")).unionByName(
        pairs_with_foreign_reply(convs).withColumn("kind", F.lit("foreign reply")))
    return format_pairs(pairs)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwise.llm.url_filter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ledgerwise.llm.bpe import Tokenizer, read_ranks

    tok = Tokenizer(spark, read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    rows = tok.pack(tok.decode(tok.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ledgerwise.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwise.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwise.llm.merkle import fold, leaf_hash, prove, siblings

    def leaf(text):
        return leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = prove(_table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("source"), leaf(F.col("text")), {"present": leaf(text)})
    rows = rows.withColumn("folded_root", fold(F.col("present"), F.col("steps")))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerwise.llm.lm_scoring import score_texts

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_texts(_table(spark, sf_dir, "documents"), held_out)


QUERIES = {f.__name__: f for f in (
    op1_near_dedup, op2_token_packing, op3_pii, op4_language_id, op5_decontamination, op6_quality_rules,
    op7_preference_format, op8_url_filter, op9_byte_bpe, op10_token_counts, op11_whitening, op12_merkle_manifest, op13_lm_scoring)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URLS = f"""WITH rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}) AS t(v, h, p)),
    cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
    parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}'), '') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
    fit AS (SELECT *, (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
      ORDER BY length(h) DESC, length(p) DESC LIMIT 1) AS rule FROM parts)
    SELECT page_id, host, path, rule, coalesce((SELECT v FROM rules WHERE h || p = rule), 'allow') AS verdict FROM fit"""

_FIELD = "coalesce(strlen(({0})::VARCHAR) || ':' || ({0})::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: CRC-32 bit by bit: a character's code is mixed in, -1 stands for one of its eight shifts.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
    WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""
_MANIFEST = f"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS k, doc_id, source, {_LEAF.format(text="text")} AS leaf,
      CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text="text")} END AS present FROM documents),
    trees AS (SELECT source, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT source FROM documents)),
    placed AS (SELECT k, doc_id, leaf, present, tree, trees, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n
      FROM docs d JOIN trees t ON t.source IS NOT DISTINCT FROM d.source),
    low AS (SELECT tree, 0 AS level, idx, leaf AS h, n FROM placed UNION ALL
      SELECT tree, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY tree, level, idx // 3, n),
    high AS (SELECT 0 AS level, tree AS idx, h, (SELECT any_value(trees) FROM trees) AS n FROM low WHERE n = 1 UNION ALL
      SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY level, idx // 3, n),
    nodes AS (SELECT tree, level, idx, h, n FROM low UNION ALL SELECT -1, level, idx, h, n FROM high),
    sides AS (SELECT *, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM nodes WHERE n > 1
      WINDOW w AS (PARTITION BY tree, level, idx // 3 ORDER BY idx)),
    walk AS (SELECT k, tree AS own, tree, 0 AS level, idx, n, present AS h, '' AS proof FROM placed UNION ALL
      SELECT k, own, CASE WHEN w.n = 1 THEN -1 ELSE w.tree END, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN w.n = 1 THEN own ELSE w.idx // 3 END,
        CASE WHEN w.n = 1 THEN (SELECT any_value(trees) FROM trees) ELSE (w.n + 2) // 3 END, CASE WHEN w.n = 1 THEN w.h ELSE sha256(s.l || w.h || s.r) END, proof || coalesce(s.l || s.r, '')
      FROM walk w LEFT JOIN sides s ON s.tree = w.tree AND s.level = w.level AND s.idx = w.idx WHERE w.n > 1 OR w.tree >= 0)
    SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, walk.h AS folded_root, walk.h = root.h AS verified
    FROM walk JOIN placed USING (k) JOIN low sub ON sub.tree = placed.tree AND sub.n = 1, (SELECT h FROM high WHERE n = 1) root WHERE walk.tree = -1 AND walk.n = 1"""



def _quality_sql() -> str:
    """Counts, exact tails, cutoffs and verdicts; the shares' expressions and cutoffs are the operator's parameters."""
    from ledgerwise.llm.quality import ALPHA, CUTOFFS, DELTA, SYMBOLS

    share = {name: expr.replace("try_divide(", "(").replace(",", "::DOUBLE / nullif(").replace(")", ", 0))") for name, (expr, _) in CUTOFFS.items()}
    p = ALPHA / len(CUTOFFS)
    tests = ", ".join(f"count(*) FILTER ({share[name]} > {c}) AS {name}_{c}" for name, (_, cuts) in CUTOFFS.items() for c in cuts)

    def tail(k: str) -> str:
        term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln({1 - p}))"
        return f"CASE WHEN {k} >= n * {p} THEN 1.0 ELSE list_sum(list_transform(range({k} + 1), lambda i: {term.replace('lgamma(n + 1)', 'lgamma(n + 1.0)')})) END"

    def strictest(name: str, cuts: list[int]) -> str:
        passed = [f"{tail(f'{name}_{c}')} <= level" for c in cuts]
        rows = [f"WHEN {' AND '.join(f'({x})' for x in passed[:k])} THEN {cuts[k - 1]}" for k in range(len(cuts), 0, -1)]
        return f"CASE {' '.join(rows)} END AS cutoff_{name}"

    space = r"[\x20\x09-\x0D]"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t,
      list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
    windows AS (SELECT k, pos, array_to_string(w[pos:pos + 4], ' ') AS s FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS pos FROM d)),
    again AS (SELECT k, pos FROM windows QUALIFY count(*) OVER (PARTITION BY k, s) > 1),
    covered AS (SELECT k, count(DISTINCT pos + j) AS n FROM again, (SELECT unnest(range(5)) AS j) GROUP BY 1),
    c AS (SELECT d.k, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
      len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words FROM d LEFT JOIN covered ON covered.k = d.k),
    judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
    sums AS (SELECT lang, count(*) AS n, {tests} FROM judged WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY 1 HAVING max(quality) = 1) GROUP BY 1),
    cuts AS (SELECT lang, {", ".join(strictest(name, cuts) for name, (_, cuts) in CUTOFFS.items())}
      FROM (SELECT *, {DELTA} / greatest(1, count(*) OVER () * {len(CUTOFFS)}) AS level FROM sums))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed
      AND NOT ({" OR ".join(f"coalesce({share[name]} > cutoff_{name}, false)" for name in CUTOFFS)}) AS kept, n_lines,
      {", ".join(f"cutoff_{name}" for name in CUTOFFS)} FROM judged j LEFT JOIN cuts ON cuts.lang IS NOT DISTINCT FROM j.lang"""


ORACLE: dict[str, str] = {"op6_quality_rules": _quality_sql(), "op8_url_filter": _URLS, "op12_merkle_manifest": _MANIFEST}

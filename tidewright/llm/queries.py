"""The registered queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import chat_format, exact_dedup, mixing, ngram_join, packing, quality, substring_index, suffix_dedup, topk_search, url_filter

WORD_TOKENIZER = "word_bpe_49k.json"

#: (host, path, action)
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
PROBE_TEXT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)


def op2_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_targets(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, action)")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.remove_seen_windows(table(spark, sf_dir, "documents"), with_kept=False)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{PROBE_TEXT}'), (-1L, 1L, 'assistant', '{PROBE_TEXT}') AS probe(conv_id, turn, role, text)")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = chat_format.read_back(chat_format.format_chats(chats))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_suffix_array_dedup, op2_entropy_mixing, op3_exact_dedup, op4_url_filter, op5_ngram_jaccard_join, op6_quality_classifier, op7_best_fit_packing, op8_substring_dedup, op9_topk_search, op10_chat_format, pipeline]
    return {f.__name__: f for f in named}


_WORDS = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# Texts as hexadecimal bytes, cut into chunks first so that no slice has to be sought in a long text.
_OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
chunks AS (SELECT doc_id, n, c, substr(h, 2 * c + 1, 1398) AS h FROM (SELECT *, unnest(range(0, n, 500)) AS c FROM d)),
places AS (SELECT doc_id, c + i AS p, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN c + i + 200 <= n THEN md5(substr(h, 2 * i + 1, 400)) END AS w
  FROM (SELECT *, unnest(range(0, least(500, n - c))) AS i FROM chunks)),
twice AS (SELECT w FROM places WHERE w IS NOT NULL GROUP BY w HAVING count(*) > 1),
marked AS (SELECT p.*, t.w IS NOT NULL AS rep FROM places p LEFT JOIN twice t ON p.w = t.w),
covered AS (SELECT doc_id, p, byte, bool_or(rep) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM marked),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS edge FROM covered),
cut AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (edge) AS n_spans, coalesce(string_agg(byte, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM edges GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, sha256(unhex(coalesce(c.kept, ''))) AS kept_sha256
FROM d LEFT JOIN cut c ON c.doc_id = d.doc_id"""


_OP3_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def _op4_sql() -> str:
    values = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
    return f"""
WITH rules(rh, rp, action) AS (VALUES {values}),
rest AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT row, page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
  SELECT p.row, rh || rp AS rule, action, row_number() OVER (PARTITION BY p.row ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM parts p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON p.row = f.row AND f.k = 1"""


def _op5_sql(words: int = 3, percent: int = 90) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORDS}') AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + {words - 1}), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {words - 1}, least(len(ws), 1)) + 1)) AS i FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= {percent} * (x.n + y.n - m)),
reach(node, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
least_root AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id FROM w LEFT JOIN sizes s ON s.doc_id = w.doc_id JOIN least_root r ON r.node = w.doc_id"""


def _op8_sql(window: int = substring_index.WINDOW) -> str:
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
tokens AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
starts AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(list_slice(ws, i, i + {window - 1}), ' ')) < doc_id AS old
  FROM tokens WHERE i + {window - 1} <= len(ws)),
covered AS (
  SELECT t.doc_id, t.i, t.ws[t.i] AS word,
    coalesce(max(coalesce(s.old, false)) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW), false) AS gone
  FROM tokens t LEFT JOIN starts s ON s.doc_id = t.doc_id AND s.i = t.i),
cut AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM covered GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(c.n_removed, 0) AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM w LEFT JOIN cut c ON c.doc_id = w.doc_id"""


_OP9_SQL = """
WITH parts AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
usable AS (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL EXCEPT SELECT vec_id FROM parts WHERE x IS NULL OR NOT isfinite(x)),
v AS (SELECT vec_id, i, CAST(floor(1024 * x) AS BIGINT) AS c FROM parts SEMI JOIN usable USING (vec_id)),
scores AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(sum(q.c * d.c) AS BIGINT) AS score
  FROM v q JOIN v d ON q.i = d.i AND q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""


def _op10_sql(template: chat_format.ChatTemplate | None = None) -> str:
    t = template or chat_format.ChatTemplate()
    firsts, rests = t._parts()
    marks = len(t.open) + len(t.sep) + len(t.close) + 1
    grown = lambda c: f"length({c}) + len(regexp_extract_all({c}, '[{firsts}]\\\\*(?:{rests})'))"
    loss = ", ".join(f"'{r}'" for r in t.loss_roles)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE_TEXT}'), (-1, 1, 'assistant', '{PROBE_TEXT}')),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role IN ({loss})), '') AS loss,
    sum({marks} + {grown("role")} + {grown("text")}) AS n
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM g"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array_dedup": _OP1_SQL,
        "op3_exact_dedup": _OP3_SQL,
        "op4_url_filter": _op4_sql(),
        "op5_ngram_jaccard_join": _op5_sql(),
        "op8_substring_dedup": _op8_sql(),
        "op9_topk_search": _OP9_SQL,
        "op10_chat_format": _op10_sql(),
    }

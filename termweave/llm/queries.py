"""Registered queries of the operators in this folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import bpe, chat, fim, license, lines, minhash, ordinal, packing, pii, simhash, spelling, topk, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


RULES = [
    urls.Rule("com", "/", "allow"),
    urls.Rule("example.com", "/en/", "block"),
    urls.Rule("www.example.com", "/en/", "allow"),
    urls.Rule("net", "/es/", "block"),
    urls.Rule("net", "/fr/", "block"),
]
#: Words in URLs that the method blocks where no rule speaks.
BLOCKED_WORDS = ["spam", "casino", "porn", "xxx", "viagra", "torrent", "malware", "phishing"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(
    "op2_url_filter",
    f"""
    WITH cut AS (
        SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
               coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages
    ),
    rules(rule_host, rule_path, action) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.action}')" for r in RULES)}),
    fits AS (
        SELECT page_id, host, path, rule_host || rule_path AS rule, action,
               row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC NULLS LAST, rule_host || rule_path) AS place
        FROM cut LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    )
    SELECT page_id, host, path, rule,
           coalesce(action, CASE WHEN regexp_matches(lower(host || path), '(^|[^a-z0-9])({"|".join(BLOCKED_WORDS)})($|[^a-z0-9])') THEN 'block' ELSE 'allow' END) AS verdict
    FROM fits WHERE place = 1""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, RULES, [urls.word_rule(w) for w in BLOCKED_WORDS]).select("page_id", "host", "path", "rule", "verdict")


@query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def written(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind: str):
        return F.size(F.filter("plain", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(counted, pii.KINDS)
    return found.select("doc_id", *counts, F.sha2(written("plain"), 256).alias("base_sha256"), written("spans").alias("spans"))


@query("op4_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    read = bpe.decode(coded, path)
    return read.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _license_sql() -> str:
    listed = [(p, label, b, license.PHRASE_GRAM) for group, b in ((license.BASE_PHRASES, True), (license.MORE_PHRASES, False)) for p, label in group]
    listed += [(p, label, False, license.PASSAGE_GRAM) for p, label in license.PASSAGES]
    values = ", ".join(f"({i}, '{p}', '{label}', {str(b).lower()}, {k})" for i, (p, label, b, k) in enumerate(listed))
    return f"""
    WITH words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
        FROM documents
    ),
    templates(template, phrase, label, base, k) AS (VALUES {values}),
    grams AS (
        SELECT template, label, base, k, len(string_split(phrase, ' ')) AS n, place, array_to_string(string_split(phrase, ' ')[place + 1:place + k], ' ') AS gram
        FROM (SELECT *, unnest(range(0, len(string_split(phrase, ' ')) - k + 1)) AS place FROM templates)
    ),
    rolled AS (
        SELECT doc_id, pos, k, array_to_string(w[pos + 1:pos + k], ' ') AS gram
        FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS pos FROM words, (VALUES ({license.PHRASE_GRAM}), ({license.PASSAGE_GRAM})) AS size(k))
    ),
    lines AS (
        SELECT doc_id, template, label, base, k, n, pos - place AS diagonal, list(DISTINCT place) AS places, count(DISTINCT place) AS votes
        FROM rolled JOIN grams USING (k, gram) GROUP BY ALL
    ),
    phrases AS (SELECT doc_id, label, base, diagonal AS start, 1.0::DOUBLE AS score FROM lines WHERE k = {license.PHRASE_GRAM} AND votes = n - k + 1),
    marked AS (
        SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {license.SLACK}, false) AS fresh FROM lines WHERE k = {license.PASSAGE_GRAM}
    ),
    grouped AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS part FROM marked),
    passages AS (
        SELECT doc_id, label, base, NULL::BIGINT AS start, least(1.0::DOUBLE, (len(list_distinct(flatten(list(places)))) + any_value(k) - 1)::DOUBLE / any_value(n)) AS score
        FROM grouped GROUP BY doc_id, template, label, base, part
    ),
    found AS (SELECT * FROM phrases UNION ALL SELECT * FROM passages WHERE score >= {license.LEAST_COVERED}),
    summed AS (
        SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
               array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) AS score
        FROM found GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
    FROM words LEFT JOIN summed USING (doc_id)"""


@query("op5_license_scan", _license_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = lines.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


@query(
    "op7_chat",
    f"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}')
    ),
    sized AS (SELECT *, length(replace(replace(role, '\\', '\\\\'), '<|', '<\\|')) + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS n FROM rows),
    summed AS (
        SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
               coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
               sum(n + {len(chat.START + chat.MIDDLE + chat.END) + 1})::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM summed""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.canonical(chat.rows_to_records(table(spark, sf_dir, "conversations"), "conv_id"))
    record = {"messages": [{"role": "user", "content": CONTROL_TEXT}, {"role": "assistant", "content": CONTROL_TEXT}]}
    extra = chat.canonical(spark.createDataFrame([(-1, record)], "conv_id long, record struct<messages: array<struct<role: string, content: string>>>"))
    both = chat.formatted(rows.select("conv_id", "turns").unionByName(extra.select("conv_id", "turns")))
    read = both.select("conv_id", "formatted", chat.read_back().alias("turns"), chat.masked_text().alias("loss"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def graded_labels(labels: DataFrame) -> DataFrame:
    """Grades from the labels: 0 of low quality, 1 good but toxic, 2 good and not toxic."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))


def quality_rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return ordinal.rate(docs, ordinal.fit(docs, graded_labels(labels), 3))


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rated(docs, table(spark, sf_dir, "labels")).select("doc_id", "expected_grade", F.col("tail").alias("tail_probability"), F.col("selected").alias("kept"))


SEQUENCE = 2048


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.token_pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), SEQUENCE, with_ids=False)
    return packing.pack(pieces.drop("ids"), SEQUENCE)


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@query(
    "op10_topk",
    """
    WITH vectors AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
    )
    SELECT query_id, rank::INT AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    def whole(x):
        return F.when(F.abs(x) < float("inf"), F.floor(256 * x.cast("double")).cast("double"))

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", whole).alias("vector"))
    found = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, key="vec_id")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op11_simhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


@query(
    "op12_fim",
    """
    WITH hashed AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id::VARCHAR) AS h FROM documents
    ),
    numbered AS (SELECT doc_id, t, u, len(u) AS n, [('0x' || h[8 * i + 1:8 * i + 8])::BIGINT FOR i IN range(4)] AS h FROM hashed),
    cut AS (
        SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high, u,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
        FROM numbered
    ),
    parts AS (
        SELECT *, array_to_string(u[1:low], '') AS prefix, array_to_string(u[low + 1:high], '') AS middle, array_to_string(u[high + 1:n], '') AS suffix FROM cut
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM parts""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.pieces(table(spark, sf_dir, "documents"), rates=fim.Rates(transformed=100, suffix_first=50))
    found = fim.digests(fim.in_output_order(cut))
    return found.select(F.col("doc").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query("op13_spelling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.group_variants(table(spark, sf_dir, "documents"), every=199)
    return found.select("word", "form", "root", "n", "n_near", "form_n")

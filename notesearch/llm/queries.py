"""The operators as queries over the synthetic tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, language, mixing, near_dedup, quality, sharding, token_count, vector_search


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_source_mixing(spark, folder):
    plan = mixing.mix(_table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source", "source_size", "target", "taken", "position", F.size("positions").alias("reads"))


def op2_token_counts(spark, folder):
    return token_count.count_tokens(_table(spark, folder, "documents"), tokenizer_path())


def op3_language_id(spark, folder):
    """Pages by markup, address, host and text; documents by source and text.  One row per page and per document."""
    docs = _table(spark, folder, "documents")
    model = language.fit_text_model(docs)
    of_docs = language.identify_documents(docs, model)
    of_pages = language.identify_pages(_table(spark, folder, "pages"), model)
    columns = ["doc_id", "page_id", "lang", "posterior", "n_words", "declared", "host", "accepted"]
    return of_docs.withColumns({"page_id": F.lit(None).cast("long"), "declared": F.lit(None).cast("string")}).select(columns).unionByName(of_pages.withColumn("doc_id", F.lit(None).cast("long")).select(columns))


def op4_chat_formatting(spark, folder):
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(more)
    formatted = chat.format_paths(chat.linear_replies(rows, "conv_id", ["turn"]))
    turns = chat.read_back(F.col("formatted"))
    flat = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    conv = F.when(F.col("tree") != "-", F.substring("tree", 2, 40)).cast("long")
    return formatted.select(
        conv.alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_bpe_encoding(spark, folder):
    return bpe.encode(_table(spark, folder, "documents"), tokenizer_path(), with_ids=False)


def op6_quality_classifier(spark, folder):
    docs = _table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, folder, "labels")))


def op7_exact_dedup(spark, folder):
    return exact_dedup.group_copies(_table(spark, folder, "documents"))


def op8_minhash_near_dedup(spark, folder):
    return near_dedup.near_duplicates(_table(spark, folder, "documents"), percent=85).drop("cls", "digest")


def op9_sharding(spark, folder):
    return sharding.shard_rows(_table(spark, folder, "documents"))


def op10_vector_top_k(spark, folder):
    rows = _table(spark, folder, "embeddings")
    return vector_search.top_k(rows, rows.filter(F.col("vec_id") % 100 == 0))


def queries():
    return {
        "op1_source_mixing": op1_source_mixing,
        "op2_token_counts": op2_token_counts,
        "op3_language_id": op3_language_id,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_bpe_encoding": op5_bpe_encoding,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_minhash_near_dedup": op8_minhash_near_dedup,
        "op9_sharding": op9_sharding,
        "op10_vector_top_k": op10_vector_top_k,
    }


def _moment_sql(part: str, rank: str) -> str:
    """mixing.moment in SQL."""
    number = lambda x: f"CAST({x!r} AS DOUBLE)"
    of_rank = []
    for k, schedule in enumerate(mixing.SCHEDULES):
        cases = ""
        for start, length, a, slope, done in reversed(mixing._segments(schedule)):
            d = f"({part} - {number(done)})"
            x = f"{number(start)} + least(2 * {d} / greatest({number(a)} + sqrt(greatest({number(a * a)} + {number(2 * slope)} * {d}, 0::DOUBLE)), 1e-12::DOUBLE), {number(length)})"
            cases += f" WHEN {part} >= {number(done)} THEN {x}"
        of_rank.append(f"WHEN ({rank} - 1) % {len(mixing.SCHEDULES)} = {k} THEN CASE{cases} END")
    return f"CASE {' '.join(of_rank)} END"


#: The steps of sharding.jump_hash in SQL, as a recursion over all keys.
_JUMP = """
            WITH RECURSIVE ids AS (SELECT DISTINCT doc_id FROM documents),
            walk AS (SELECT doc_id, n, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j, 0 AS step FROM ids, (VALUES (40), (41)) v(n)
                UNION ALL SELECT doc_id, n, j, CAST(least(floor((j + 1) / ((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || chr(10) || step), 1, 8))::BIGINT + 1)::DOUBLE / 4294967296::DOUBLE)), 1099511627776) AS BIGINT), step + 1 FROM walk WHERE j < n),
            shards AS (SELECT doc_id, CAST(max(b) FILTER (n = 40) AS INTEGER) AS shard, CAST(max(b) FILTER (n = 41) AS INTEGER) AS grown_shard FROM walk GROUP BY doc_id),"""


def oracle_sql():
    return {
        "op1_source_mixing": rf"""
            WITH t AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || chr(10) || coalesce(source, '-') || chr(10) || coalesce(text, '-')), 1, 15))::BIGINT AS h FROM documents),
            s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM t GROUP BY source),
            w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS weight, 2 * source_size::DOUBLE AS cap FROM s),
            f AS (SELECT *, cap / weight AS fill, greatest(1.5::DOUBLE * sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)
                / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
            l AS (SELECT level AS final FROM f WHERE fill > level ORDER BY fill, rank LIMIT 1),
            g AS (SELECT source, source_size, rank, least(cap, coalesce(weight * (SELECT final FROM l), cap)) AS target FROM f),
            p AS (SELECT t.*, source_size, rank, target, CAST(coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source),
            k AS (SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - before)) AS once, greatest(0, least(size, CAST(floor(target) AS BIGINT) - before - source_size)) AS again, before::DOUBLE / target AS part FROM p)
            SELECT doc_id, size, source, source_size, target, once + again AS taken, CASE WHEN once > 0 THEN {_moment_sql("part", "rank")} END AS position, CAST((once > 0)::INTEGER + (again > 0)::INTEGER AS INTEGER) AS reads FROM k""",
        "op9_sharding": _JUMP
        + """
            crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) r(i)),
            t AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS digits FROM documents),
            c AS (SELECT doc_id, size, xor(list_reduce(list_transform(range(length(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32 FROM t, crc)
            SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
                row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || chr(10) || text_crc32), 1, 15))::BIGINT, doc_id, size) - 1 AS slot
            FROM c JOIN shards USING (doc_id)""",
        "op7_exact_dedup": r"""
            WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
            g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
        "op10_vector_top_k": r"""
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
        "op4_chat_formatting": r"""
            WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
            t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
            e AS (SELECT *, length(role) + length(text) + length('<s>[INST][/INST]</s>')
                + length(role || text) - length(replace(role || text, chr(92), ''))
                + length(regexp_extract_all(role, '</?s>|\[/?INST\]')) + length(regexp_extract_all(text, '</?s>|\[/?INST\]')) AS chars FROM t),
            g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS flat,
                coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
            SELECT conv_id, n_turns, sha256(flat) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
        "op8_minhash_near_dedup": r"""
            WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
            l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
            e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.d)
            SELECT d AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(m) AS component_id, d = min(m) AS kept FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d""",
    }

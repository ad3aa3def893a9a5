"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import caps, chroma, lines, merkle, mixing, packing, simhash, substring, suffix, tokens, toxicity, warc, whiten
from sieveworks.llm.common import documents, fresh_dir, n_words, saved


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")).drop("ids")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(warc.pages_table(spark, sf_dir), fresh_dir(spark, "warc")).drop("payload")


def op7_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.search(chroma.melodies(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.col("text").cast("binary")).alias("tie"))
    return mixing.mix(saved(sized, "mix-sizes")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    each = white.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = merkle.manifest(docs, changed=merkle.tampered(F.col("text"), F.col("doc_id")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring": op1_substring,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_simhash": op4_simhash,
    "op5_suffix": op5_suffix,
    "op6_warc": op6_warc,
    "op7_caps": op7_caps,
    "op8_toxicity": op8_toxicity,
    "op9_chroma": op9_chroma,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_merkle": op12_merkle,
    "op13_lines": op13_lines,
}

_PLACE = "('0x' || substr(md5({}), 1, 15))::bigint"
#: Words, targets filled up to their caps, and systematic sampling in the order of size and of a hash.
_MIXING_SQL = f"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint AS size,
        {_PLACE.format("concat_ws(':', doc_id::varchar, '7', md5(text))")} AS h FROM documents),
sources AS (
    SELECT *, 2.0::double * source_size AS cap, 2.0::double * source_size / weight AS ratio FROM (
        SELECT source, source_size, ([5.0, 2.0, 1.0]::double[])[((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::int] AS weight
        FROM (SELECT source, sum(size)::bigint AS source_size FROM sized GROUP BY source))),
levels AS (
    SELECT *, (1.5::double * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM sources WINDOW before AS (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
    SELECT source, source_size, least(cap, coalesce(weight * max(CASE WHEN ratio >= level THEN level END) OVER (), cap)) AS target,
        {_PLACE.format("concat_ws(':', 'offset 7', source)")} / {float(1 << 60)!r}::double AS shift FROM levels),
placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.h) AS n
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (SELECT *, least(floor(n * rate + shift) - floor((n - 1) * rate + shift), 2)::bigint AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken"""

#: The bits of a SHA-1, five at a time, as base32.
_BITS = "array_to_string(list_transform(string_split(sha1(payload), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', c) - 3, 4)), '')"
_FIVE = " + ".join(f"{1 << (4 - k)} * substr(bits, i * 5 + {k + 1}, 1)::int" for k in range(5))
_WARC_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS response, {_BITS} AS bits FROM p)
SELECT page_id, url, strlen(payload)::bigint AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest,
    CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id != response THEN response END AS refers_to FROM r"""

#: Lines as a list a document; each is kept unless its key is frequent and another document is the key's keeper.
_LINES_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, lines[i] AS line, i AS pos,
        translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM d, unnest(range(1, len(lines) + 1)) AS u(i)),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::int) >= 3),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM k.keeper AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*)::bigint AS n_lines, count(*) FILTER (WHERE gone)::bigint AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id"""

_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in merkle.FIELDS[:-1]) + " || {})"
_LOWER = "CASE WHEN mod(crc, 3) = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
#: Unsigned CRC-32 of a decimal's bytes, by bit: DuckDB has no such function.
_CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen({0})), lambda i: ascii(substr({0}, i + 1, 1))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _: xor(x // 2, 3988292384 * (x % 2))))"""
_UP = "sha256(string_agg(digest, '' ORDER BY idx))"
_SIDES = """coalesce(string_agg(digest, '') OVER (PARTITION BY k, tree, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(digest, '') OVER (PARTITION BY k, tree, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"""
_STEP = "w.k + 1, w.idx // 8, sha256(s.l || w.acc || s.r), w.proof || s.l || s.r"
#: Both levels of trees upwards, then every leaf's path folded over the digests left and right of it.
_MERKLE_SQL = f"""
WITH RECURSIVE d AS (SELECT *, xor({_CRC.format("doc_id::varchar")}, 4294967295) AS crc FROM documents),
leaves AS (
    SELECT doc_id, {_LEAF.format(_FIELD.format("text"))} AS leaf, {_LEAF.format(_FIELD.format("(" + _LOWER + ")"))} AS later,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {_LEAF.format(_FIELD.format("text"))}) - 1 AS idx,
        count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d),
low AS (
    SELECT 0 AS k, tree, idx, n, leaf AS digest FROM leaves
    UNION ALL SELECT k + 1, tree, idx // 8, (max(n) + 7) // 8, {_UP} FROM low WHERE n > 1 GROUP BY k, tree, idx // 8),
high AS (
    SELECT 0 AS k, 0 AS tree, tree AS idx, count(*) OVER () AS n, digest FROM low WHERE n = 1
    UNION ALL SELECT k + 1, tree, idx // 8, (max(n) + 7) // 8, {_UP} FROM high WHERE n > 1 GROUP BY k, tree, idx // 8),
below AS (SELECT k, tree, idx, n, {_SIDES} FROM low), above AS (SELECT k, tree, idx, n, {_SIDES} FROM high),
walk AS (
    SELECT doc_id, leaf, tree, 0 AS k, idx, later AS acc, '' AS proof FROM leaves
    UNION ALL SELECT w.doc_id, w.leaf, w.tree, {_STEP} FROM walk w JOIN below s ON s.k = w.k AND s.tree = w.tree AND s.idx = w.idx WHERE s.n > 1),
met AS (SELECT w.*, t.digest AS subroot FROM walk w JOIN low t ON t.k = w.k AND t.tree = w.tree AND t.n = 1),
top AS (
    SELECT doc_id, leaf, subroot, 0 AS k, tree AS idx, acc, proof FROM met
    UNION ALL SELECT w.doc_id, w.leaf, w.subroot, {_STEP} FROM top w JOIN above s ON s.k = w.k AND s.idx = w.idx WHERE s.n > 1)
SELECT w.doc_id, w.leaf, w.subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = t.digest AS verified
FROM top w JOIN high t ON t.k = w.k AND t.n = 1"""

ORACLE_SQL: dict[str, str] = {"op6_warc": _WARC_SQL, "op10_mixing": _MIXING_SQL, "op12_merkle": _MERKLE_SQL, "op13_lines": _LINES_SQL}

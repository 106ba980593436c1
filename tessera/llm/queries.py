"""Registered queries of the text operators and their SQL twins (DuckDB).

Each ``opN_<name>`` applies its operator with production parameters to the whole
table and returns the operator's result in the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    conversation_trie,
    decontaminate,
    exact_dedup,
    hard_negatives,
    langid,
    packing,
    quality_knn,
    simhash,
    substring_dedup,
    token_planes,
    toxicity,
    url_reputation,
    warc,
)
from tessera.llm.common import id_crc, table
from tessera.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Separators as a regular expression, for the SQL twins.
SEP_RE = r"[\x20\x09-\x0D]"


def tokenizer_path() -> str:
    """The public byte-level BPE that the contracts name."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


@query("op7_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from rows with a language whose key's CRC mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = id_crc() % 4 == 2
    model = langid.train(docs.where(~held))
    told = langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return told.select("doc_id", "held_out", "lang_pred", "score")


@query("op8_exact_dedup", rf"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         sha256(regexp_replace(coalesce(text, ''), '{SEP_RE}', '', 'g')) AS h
  FROM documents),
r AS (
  SELECT doc_id, h,
         first_value(doc_id) OVER w AS keep_id,
         row_number() OVER w AS nth,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM n WINDOW w AS (PARTITION BY h ORDER BY size DESC, doc_id))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, h AS text_sha256 FROM r""")
def exact_dedup_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = exact_dedup.mark(docs, settle_hash=True)
    return told.select(F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"),
                       "group_size", "kept", F.col("full_hash").alias("text_sha256"))


@query("op3_token_planes")
def token_planes_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in key order with end id 2, read back from the files."""
    docs = table(spark, sf_dir, "documents")
    files = token_planes.write(docs, tokenizer_path(), end_id=2)
    told = token_planes.read(files, token_planes.crc32_of, "ids_crc32 long")
    return told.withColumnRenamed("key", "doc_id")


@query("op10_warc_segments")
def warc_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as segmented archives and read back."""
    pages = table(spark, sf_dir, "pages")
    told = warc.read(warc.write(pages, revisit_bytes=0), with_payload=False)
    return told.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest",
                       "record_type", "refers_to")


@query("op4_simhash")
def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of 3-word SimHash fingerprints at 2 or fewer differing bits."""
    told = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, limit=2)
    return told.select(F.col("key").alias("doc_id"),
                       F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
                       F.col("component").alias("component_id"))


#: The rules of the contract: host, path, verdict.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"),
             ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def _url_sql() -> str:
    by_length = sorted(URL_RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))

    def case(value):
        return "CASE " + " ".join(
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') "
            f"THEN '{value(h, p, v)}'" for h, p, v in by_length) + " END"

    two = ", ".join(f"'{x}'" for x in url_reputation.TWO_LABEL)
    lo, hi = url_reputation.STRENGTH

    def strength(level):
        return f"""(SELECT least(greatest(CASE WHEN rho > 0 THEN (1 - rho) / rho ELSE {hi} END,
                          {lo}), {hi}) FROM (
          SELECT (yy - t * p * p - p * (1 - p) * (k - 1))
                 / nullif(greatest(p * (1 - p) * (t - t2 / t - (k - 1)), 0), 0) AS rho FROM (
            SELECT *, y / t AS p FROM (
              SELECT sum(bad)::DOUBLE AS y, sum(n)::DOUBLE AS t, count(*) AS k,
                     sum(n * n)::DOUBLE AS t2, sum(bad * bad / n) AS yy
              FROM {level} WHERE n > 0) WHERE t > 0)))"""

    def tail(labels):
        return f"array_to_string(list_slice(labels, -{labels}, -1), '.')"

    return rf"""
WITH told AS (
  SELECT doc_id AS page_id, sum(bad)::BIGINT AS bad, count(*) AS n FROM (
    SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1
                        WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END AS bad FROM labels)
  WHERE bad IS NOT NULL GROUP BY doc_id),
p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
hosts0 AS (
  SELECT host, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(bad), 0)::BIGINT AS bad
  FROM p LEFT JOIN told USING (page_id) GROUP BY host),
hosts1 AS (
  SELECT *, string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') AS labels FROM hosts0),
hosts AS (
  SELECT host, n, bad,
    CASE WHEN {tail(2)} IN ({two}) THEN {tail(3)} ELSE {tail(2)} END AS domain,
    CASE WHEN {tail(2)} IN ({two}) THEN {tail(2)} ELSE {tail(1)} END AS suffix FROM hosts1),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad
            FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY ALL),
m AS (SELECT (SELECT (sum(bad) + 1)::DOUBLE / (sum(n) + 2) FROM suffixes) AS p0,
             coalesce({strength('suffixes')}, {hi}) AS ms,
             coalesce({strength('domains')}, {hi}) AS md, coalesce({strength('hosts')}, {hi}) AS mh),
s AS (SELECT suffix, (bad + ms * p0) / (n + ms) AS above FROM suffixes, m),
d AS (SELECT domain, suffix, (bad + md * above) / (n + md) AS above
      FROM domains JOIN s USING (suffix), m),
h AS (SELECT host, (bad + mh * above) / (n + mh) AS mean, n + mh AS size
      FROM hosts JOIN d USING (domain, suffix), m),
j AS (SELECT page_id, host, path,
        greatest(mean - {url_reputation.Z} * sqrt(mean * (1 - mean) / (size + 1)), 0.0) AS lower
      FROM p JOIN h USING (host))
SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule,
  coalesce({case(lambda h, p, v: v)},
           CASE WHEN lower > {url_reputation.BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict
FROM j"""


@query("op5_url_reputation", _url_sql())
def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is bad if its label says low quality or toxic."""
    bad = (F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1)
           .when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0))
    outcomes = table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad"))
    told = url_reputation.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES)
    return told.select(F.col("key").alias("page_id"), "host", "path", "rule", "verdict")


@query("op9_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items it holds."""
    told = decontaminate.mark(table(spark, sf_dir, "documents").select("doc_id", "text"),
                              table(spark, sf_dir, "benchmark"))
    return told.select("doc_id", "contaminated", "items", "longest_run", "cover")


@query("op2_quality_knn")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labels of rows whose key's CRC mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_crc() % 3 == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    known = labels.where(~held).join(docs.where(~held), "doc_id")
    told = quality_knn.score(docs, quality_knn.fit(known))
    return told.select("doc_id", held.alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_retrieval_packing")
def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids, end id 0."""
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of documents, in the columns of the packing contract."""
    told = packing.pack(docs, tokenizer_path(), end_id=0, size=1024,
                        tell=packing.crc32_of, schema="ids_crc32 long")
    return told.withColumnRenamed("key", "doc_id").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op1_substring_dedup", r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM split),
win AS (
  SELECT doc_id, i, md5(string_agg(w, ' ') OVER f) AS h, count(*) OVER f AS n
  FROM word WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
again AS (
  SELECT doc_id, i FROM win WHERE n = 20
  QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again),
kept AS (
  SELECT word.doc_id, count(gone.i) AS n_removed,
         string_agg(w, ' ' ORDER BY word.i) FILTER (WHERE gone.i IS NULL) AS t
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id)
SELECT s.doc_id, len(s.ws) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id""")
def substring_dedup_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 20 words and more."""
    told = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20,
                                          with_text=False)
    return told.select(F.col("key").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query("op13_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike,
         list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER
         AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3""")
def hard_negative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 50; every seventh label is moved on."""
    told = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", told)
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


#: Unsigned CRC-32 of a number's decimal text, byte by byte and bit by bit.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
      lambda t, i: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END)), 4294967295)"""


# The twin's parent is DOUBLE: that is what a nullable whole number of Spark becomes in pandas.
@query("op12_conversation_trie", rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC_SQL} % 4 AS h, conv_id - conv_id % 20 AS base
      FROM (SELECT DISTINCT conv_id FROM t)),
u AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = base AND pos <= h
  UNION ALL
  SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
s AS (
  SELECT conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY part, pos)
                           FILTER (pos IS NOT NULL), []) AS s
  FROM c LEFT JOIN u USING (conv_id) GROUP BY conv_id),
p AS (SELECT conv_id, len(s) AS n, unnest(range(len(s) + 1)) AS depth, s FROM s),
nodes AS (
  SELECT list_slice(s, 1, depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
                         FILTER (n = depth), '')) AS ends_sha256
  FROM p GROUP BY node, depth),
kids AS (SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n_children
         FROM nodes WHERE depth > 0 GROUP BY 1),
told AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN depth > 0 THEN (n_convs - 1) * len(list_filter(
      regexp_split_to_array(node[-1].text, '{SEP_RE}+'), lambda x: x <> '')) ELSE 0 END AS saved
  FROM nodes LEFT JOIN kids USING (node)),
up AS (SELECT list_slice(node, 1, d) AS node, saved, n_children FROM (
         SELECT node, saved, n_children, unnest(range(depth + 1)) AS d FROM told)),
sums AS (SELECT node, sum(saved)::BIGINT AS saved_tokens,
                count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY node)
SELECT told.conv_id, told.depth, parent.conv_id::DOUBLE AS parent_conv_id, told.n_convs, told.n_children,
       n_leaves, saved_tokens, told.ends_sha256
FROM told JOIN sums USING (node)
LEFT JOIN nodes parent ON told.depth > 0 AND parent.depth = told.depth - 1
                      AND parent.node = list_slice(told.node, 1, told.depth - 1)""")
def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation begins with the first turns of the one that opens its score of ids."""
    turns = conversation_trie.positions(table(spark, sf_dir, "conversations"))
    members, rebuilt = shared_openings(turns)
    return conversation_trie.trie(members, rebuilt)


def shared_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, their turns) after the first h turns of conversation c - c % 20 have
    taken the place of c's own first h; h is the CRC-32 of c's decimal text, modulo 4."""
    members = materialize(turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select(
        "conv_id", "n", (id_crc("conv_id") % 4).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % 20).alias("base")), "trie-openings")
    opening = turns.where("pos <= 3").withColumnRenamed("conv_id", "base")
    heads = members.select("conv_id", "base", "h").join(opening, "base").where(
        "pos <= h").select("conv_id", "pos", "a", "b", "words")
    # Own turns move up where the opening is shorter than what it replaces.
    bases = members.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    moved = members.join(bases, "base", "left").select(
        "conv_id", (F.col("h") - F.least("h", F.coalesce("there", F.lit(0)))).alias("up"))
    tails = (turns.where(F.col("pos") > id_crc("conv_id") % 4)
             .join(moved.where("up > 0"), "conv_id", "left")
             .select("conv_id", (F.col("pos") - F.coalesce("up", F.lit(0))).alias("pos"),
                     "a", "b", "words"))
    return members.select("conv_id"), heads.unionByName(tails)


@query("op11_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labels of rows whose key's CRC mod 4 is not 2; toxic from 0.3 on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = id_crc() % 4 == 2
    labels = table(spark, sf_dir, "labels").where(~held).select(
        "doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.where(~held), labels)
    told = toxicity.judge(docs, model).withColumnRenamed("key", "doc_id")
    return told.select("doc_id", held.alias("held_out"), "score",
                       (F.col("score") >= 0.3).cast("int").alias("predicted"),
                       F.size("found").alias("n_found"))

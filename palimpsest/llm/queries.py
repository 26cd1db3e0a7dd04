"""The subpackage's queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, chat, decontamination, embedding_dedup, hard_negatives, html_text, licenses, lm_scoring, ngram_join, quality, sharding, spelling, token_counts
from palimpsest.llm.common import table
from palimpsest.plans.registry import Registry
from palimpsest.session import shared_folder

REGISTRY = Registry()


@REGISTRY.add("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded."""
    import public_tokenizers as tokenizers

    tokenizer = token_counts.Tokenizer(tokenizers.path("piece_bpe_32k.model"))
    cache = f"{shared_folder(spark)}/token-counts/{uuid.uuid4().hex}"
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer, cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@REGISTRY.add("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "spans",
    )


@REGISTRY.add("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    ranks = tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, tokenizers.PATTERN)
    return bpe.decode(ids, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@REGISTRY.add("op4_near_vectors")
def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_near_vectors(table(spark, sf_dir, "embeddings"))


@REGISTRY.add("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


#: Both sides of a conversation that says the strings other templates mark turns with.
CONTROL = "\\### Assistant: </turn> ok"

_ORDER = "order by turn, r, t"
_CHAT_SQL = f"""
with rows as (
    select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
    union all select -7, 0, 'user', '{CONTROL}' union all select -7, 1, 'assistant', '{CONTROL}'
)
select conv_id, count(*) n_turns,
    sha256(string_agg(r || chr(10) || t || chr(10), '' {_ORDER})) turns_sha256,
    cast(sum(case when r = 'assistant' then length(t) else 0 end) as bigint) loss_chars,
    sha256(coalesce(string_agg(case when r = 'assistant' then t end, '' {_ORDER}), '')) loss_sha256,
    cast(sum(15 + length(replace(replace(replace(r, '\\', '\\s'), '<', '\\l'), chr(10), '\\n'))
        + length(replace(replace(t, '\\', '\\s'), '<', '\\l'))) as bigint) formatted_chars
from rows group by conv_id
"""


@REGISTRY.add("op6_chat", _CHAT_SQL)
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("turn"), F.lit(who).alias("role")) for k, who in enumerate(("user", "assistant")))))
    control = spark.range(1).select(said.alias("said")).select(F.lit(-7).cast("long").alias("conv_id"), "said.*", F.lit(CONTROL).alias("text"))
    events = chat.messages_from_rows(rows.unionByName(control))
    back = chat.read_back(chat.render(chat.fold(events)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@REGISTRY.add("op7_ngram_join")
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@REGISTRY.add("op8_licenses")
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("sentences").cast("long").alias("n_sentences"),
        F.array_join(F.transform("sentences", lambda s: s["sentence"]), ",").alias("sentences"),
        F.array_join("licenses", ",").alias("licenses"),
    )


#: Production shards of the corpus.
SHARDS = tuple(f"shard-{k:03}" for k in range(64))

_SHARD_SQL = f"""
select doc_id, slot, 'shard-' || printf('%03d', cast(string_split('{",".join(map(str, sharding.lookup_table(SHARDS)))}', ',')[slot + 1] as integer)) shard
from (select doc_id, cast(cast('0x' || substr(md5(coalesce('k' || doc_id, 'null')), 1, 15) as bigint) % {sharding.SLOTS} as integer) slot from documents)
"""


@REGISTRY.add("op9_sharding", _SHARD_SQL)
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


#: Documents that score lower are rejected.
QUALITY = 0.3


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Fitted on the labelled documents whose crc32 of the id is no multiple of five."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return quality.fit(table(spark, sf_dir, "documents"), labels)


@REGISTRY.add("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality_model(spark, sf_dir)).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY).cast("int").alias("predicted"),
    )


_NEGATIVES_SQL = """
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * cast(x as double))) e
    from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select a.vec_id a, v.vec_id r, a.l = v.l same, cast(list_inner_product(a.e, v.e) as bigint) score
    from v a join v on a.vec_id <> v.vec_id where a.vec_id % 100 = 0
), p as (
    select a, r, score from s where same qualify row_number() over (partition by a order by score desc, r) <= 5
)
select p.a anchor_id, p.r positive_id, cast(row_number() over (partition by p.a, p.r order by s.score desc, s.r) as integer) "rank",
    s.r negative_id, p.score positive_score, s.score negative_score
from p join s on p.a = s.a and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score
qualify "rank" <= 5
"""


@REGISTRY.add("op12_hard_negatives", _NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


@REGISTRY.add("op11_spelling")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents")).where("n >= 2")
    return spelling.group_variants(words)


@REGISTRY.add("op13_lm_scores")
def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    return lm_scoring.score(table(spark, sf_dir, "documents"), training)

"""Queries over pages, conversations and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import chat, slots, warc
from ledgerlight.llm.common import table
from ledgerlight.session import table_path

SHARDS = 8


def op3_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted, then read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(hard)).toDF(*rows.columns)
    return chat.read_back(chat.format_turns(rows.union(more)))


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    out = slots.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a deduplicated archive, and what reading it back gives."""
    records = warc.resolved(warc.page_records(table(spark, sf_dir, "pages")))
    archive = warc.write_archive(records, table_path(spark, "warc"))
    read = warc.followed(warc.read_archive(spark, archive))
    return read.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


QUERIES = {"op3_chat_grammar": op3_chat_grammar, "op4_virtual_slots": op4_virtual_slots, "op8_warc_revisits": op8_warc_revisits}

ORACLES = {
    # code points of a formatted turn: marks, role, line feeds, text and one backslash for each
    # control string in it; roles of the tables hold nothing that is escaped
    "op3_chat_grammar": r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, i, case when i = 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) r(i)
), t as (
  select *, length(regexp_replace(text, '(<|\[)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|unk>|pad>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\2\\\3', 'g')) as body from c
), o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
       coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by k), '')) as loss_sha256,
       sum(body + length(role) + 24)::bigint as formatted_chars, sum(case when body > length(text) then 1 else 0 end)::bigint as n_escaped
from o group by conv_id
""",
    "op8_warc_revisits": """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, sha1(html) as payload_digest, strlen(html) as payload_bytes from p),
g as (select payload_digest, payload_bytes, max(page_id) as keep from h where payload_bytes >= 1000 group by all having count(*) > 1)
select h.page_id, h.payload_bytes, h.payload_digest,
       case when g.keep is not null and h.page_id is distinct from g.keep then 'revisit' else 'response' end as record_type,
       case when g.keep is not null and h.page_id is distinct from g.keep then g.keep end as refers_to
from h left join g using (payload_digest, payload_bytes)
""",
}

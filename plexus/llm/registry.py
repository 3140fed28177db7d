"""The corpus operators as registered queries, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexus.llm import ann, chat, decontaminate, licenses, mixing, quality, secrets, shards, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark, sf_dir):
    return licenses.label(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark, sf_dir):
    return secrets.report(_table(spark, sf_dir, "documents"))


def op3_pruned_graph_search(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    return ann.search(ann.build_index(rows), rows.filter(F.col("vec_id") % 20 == 0), k=20)


def op4_zip_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_perspective_rotation(spark, sf_dir):
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op6_quality_classifier(spark, sf_dir):
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_histogram_sort(spark, sf_dir):
    return shards.assign(_table(spark, sf_dir, "documents"))


def op8_positional_decontamination(spark, sf_dir):
    return decontaminate.digest(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op9_simhash_bk_trees(spark, sf_dir):
    return simhash.classes(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_soft_membership_mixing(spark, sf_dir):
    return mixing.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [
        op1_license_scan, op2_secret_scan, op3_pruned_graph_search, op4_zip_warc, op5_perspective_rotation, op6_quality_classifier,
        op7_histogram_sort, op8_positional_decontamination, op9_simhash_bk_trees, op10_soft_membership_mixing,
    ]
    return {f.__name__: f for f in every}


_WARC_SQL = """
with rows as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
last as (select h, max(page_id) as last from rows group by 1)
select page_id, strlen(html)::bigint as payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::bigint, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::bigint, 1)), '') as payload_digest,
    case when page_id = last then 'response' else 'revisit' end as record_type,
    case when page_id = last then null else last end as refers_to
from rows join last using (h)
"""

_WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
_DECONTAMINATION_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS_SQL} as w from documents),
b as (select item_id, {_WORDS_SQL} as w from benchmark),
starts as (select item_id, w, unnest(range(greatest(1, len(w) - 12))) as i from b where len(w) > 0),
windows as (select distinct item_id, list_slice(w, i + 1, i + 13) as p, least(13, len(w)) as n from starts),
sizes as (select distinct n from windows),
places as (select r, w, n, unnest(range(len(w) - n + 1)) as i from d join sizes on len(w) >= n),
hits as (select r, i, s.n, item_id from places s join windows p on s.n = p.n and list_slice(s.w, s.i + 1, s.i + s.n) = p.p),
marks as (select r, count(distinct pos) as n_hit from (select r, unnest(range(i, i + n)) as pos from (select distinct r, i, n from hits)) group by 1),
items as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct r, item_id from hits) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from d left join marks using (r) left join items using (r)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express an operator; the others are tested against brute force."""
    return {
        "op1_license_scan": licenses.oracle_sql(),
        "op4_zip_warc": _WARC_SQL,
        "op5_perspective_rotation": chat.ORACLE,
        "op8_positional_decontamination": _DECONTAMINATION_SQL,
    }

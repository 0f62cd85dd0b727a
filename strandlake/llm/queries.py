"""The queries over the driver's tables that apply each operator of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from . import chat, gif, jaccard, langid, packing, pieces, quality, tokenfile, toxicity, warc
from .common import read_table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_learned_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_components(read_table(spark, sf_dir, "documents"), size=3, t=Fraction(9, 10))


def op3_ftrl_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op4_two_level_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read_table(spark, sf_dir, "pages"))


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.round_trip(read_table(spark, sf_dir, "documents"))


def op7_reply_tree_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.round_trip(read_table(spark, sf_dir, "conversations"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1)


def op9_prefix_table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(read_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op10_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(spark, read_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), 50257, end_id=0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_learned_quality_rules,
        op2_parity_sketch_join,
        op3_ftrl_language_id,
        op4_two_level_capture_index,
        op5_counterfactual_toxicity,
        op6_gif_columns,
        op7_reply_tree_chats,
        op8_best_fit_packing,
        op9_prefix_table_pieces,
        op10_bit_packed_tokens,
    )
    return {f.__name__: f for f in found}


OP2_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
p as (select a.doc_id as i, b.doc_id as j, a.n as ni, b.n as nj, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id where 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) group by all),
l as (select i, j from p where 100 * c >= 90 * (ni + nj - c)),
u as (select i, j from l union all select j, i from l),
r(doc_id, reach) as (select doc_id, doc_id from documents union select r.doc_id, u.j from r join u on r.reach = u.i)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, (select min(reach) from r where r.doc_id = s.doc_id) as component_id from s
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_parity_sketch_join": OP2_SQL, "op4_two_level_capture_index": warc.ORACLE_SQL, "op7_reply_tree_chats": chat.ORACLE_SQL}

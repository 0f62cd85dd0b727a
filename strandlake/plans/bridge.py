"""Genomic shapes over the driver's tables, in SQL that Spark and DuckDB both read.

They show that operators compute what they say; they carry no biology. Sequences are whole texts of all documents, one base
a letter (upper() would make two of some letters).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")

BRIDGES = {
    "gene": """select concat('ENSG', lpad(cast(p_partkey as string), 11, '0')) as gene_id, p_name as gene_name, case when p_size % 3 = 0 then 'lncRNA' else 'protein_coding' end as gene_type,
      concat('chr', cast(p_partkey % 5 + 1 as string)) as chrom, p_partkey * 400 as gstart, p_partkey * 400 + p_size * 40 + 40 as gend, case when p_partkey % 2 = 0 then '+' else '-' end as strand from {part}""",
    "exon": """select l_orderkey as transcript_id, concat('chr', cast(l_orderkey % 5 + 1 as string)) as chrom, case when l_orderkey % 2 = 0 then '+' else '-' end as strand,
      l_partkey * 400 + l_linenumber * 20 as estart, l_partkey * 400 + l_linenumber * 20 + cast(l_quantity as bigint) + 1 as eend from {lineitem}""",
    "gene_exon": """select concat('ENSG', lpad(cast(l_partkey as string), 11, '0')) as gene_id, l_partkey * 400 + l_linenumber * 20 as estart, l_partkey * 400 + l_linenumber * 20 + cast(l_quantity as bigint) + 1 as eend from {lineitem}""",
    "win": """select o_orderkey as wid, concat('chr', cast(o_custkey % 5 + 1 as string)) as chrom, o_orderkey * 50 as wstart, o_orderkey * 50 + 120 as wend, concat('fold', cast(o_orderkey % 8 as string)) as fold from {orders}""",
    "usage": """select concat('chr', cast(l_suppkey % 5 + 1 as string)) as chrom, l_partkey * 400 + l_linenumber * 20 as pos, cast(l_linenumber % 5 as bigint) as label, cast(l_quantity as bigint) as alpha,
      cast(round(l_tax * 100) as bigint) as beta, l_discount * 10 as sse, cast(year(l_shipdate) - 1992 as int) as cond, l_orderkey * 10 + l_linenumber as ord from {lineitem}""",
    "pas": """select concat('ENSG', lpad(cast(l_partkey as string), 11, '0'), '.', cast(l_linenumber as string)) as gene_id, concat('chr', cast(l_partkey % 5 + 1 as string)) as chrom,
      case when l_partkey % 2 = 0 then '+' else '-' end as strand, l_partkey * 400 + l_linenumber * 30 + cast(l_quantity as bigint) as pos from {lineitem}""",
    "big_win": """select o_custkey as wid, concat('chr', cast(o_custkey % 5 + 1 as string)) as chrom, min(o_custkey * 400) as wstart, min(o_custkey * 400) + 8192 as wend from {orders} group by o_custkey""",
    "variant": """select o_orderkey as variant_id, concat('chr', cast(o_custkey % 5 + 1 as string)) as chrom, o_orderkey * 50 + 30 as position, substr('ACGT', cast(o_orderkey % 4 as int) + 1, 1) as ref_bases,
      case when o_orderkey % 5 = 0 then concat(substr('ACGT', cast(o_orderkey % 4 as int) + 1, 1), 'GG') else substr('TGCA', cast((o_orderkey + o_custkey) % 4 as int) + 1, 1) end as alt_bases from {orders}""",
    "track": """select n_nationkey as track_index, n_name as track_name, r_name as output_name, case n_nationkey % 3 when 0 then '+' when 1 then '-' else '.' end as strand, n_nationkey % 2 as organism,
      case when n_nationkey % 7 = 0 then 'nan' else concat('UBERON:', cast(n_nationkey % 4 as string)) end as ontology_curie from {nation} join {region} on n_regionkey = r_regionkey""",
    "eval": """select doc_id, l.toxic, l.quality, cast(doc_id * 7919 % 1000 as double) / cast(1000 as double) as s1, cast(doc_id * 104729 % 997 as double) / cast(997 as double) as s2, lang from {labels} l join {documents} using (doc_id)""",
    "seq": """select doc_id as seq_id, doc_id * 100 as start, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC') as raw from {documents}""",
}
_SIGNAL = "vec_id, cast(floor(vec_id / 2) as bigint) as variant_id, case when vec_id % 2 = 0 then 'REF' else 'ALT' end as allele, cast(pos as bigint) as pos, cast(floor(pos / 8) as bigint) as bin, cast(pos % 8 as bigint) as track, abs(cast(v as double)) as value, label"
SIGNAL_SPARK = f"select {_SIGNAL} from (select vec_id, label, posexplode(embedding) as (pos, v) from {{embeddings}})"
SIGNAL_DUCK = f"select {_SIGNAL} from (select vec_id, label, unnest(range(64)) as pos, unnest(embedding) as v from embeddings)"
PAIR = "select variant_id, bin, track, max(case when allele = 'REF' then value end) as ref, max(case when allele = 'ALT' then value end) as alt from signal group by 1, 2, 3 having count(*) = 2"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bridge(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bridge table as a DataFrame."""
    text = SIGNAL_SPARK if name == "signal" else BRIDGES[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def with_bridges(sql: str, *names: str) -> str:
    """DuckDB SQL with the named bridges before it."""
    parts = []
    for n in names:
        text = SIGNAL_DUCK if n == "signal" else PAIR if n == "pair" else BRIDGES[n].format(**{t: t for t in TABLES})
        parts.append(f"{n} as ({text})")
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with " + ", ".join(parts) + ", " + body[5:]
    return "with " + ", ".join(parts) + " " + body

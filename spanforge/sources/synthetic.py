"""Observations derived from the documents table: six pseudo-models in three families whose outputs are short
substrings of documents, with empties, errors and repeats. The stand-in for real response logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MODELS = (("m0", "fa"), ("m1", "fa"), ("m2", "fb"), ("m3", "fb"), ("m4", "fc"), ("m5", "fc"))
_MODELS = ", ".join(f"({i}, '{m}', '{f}')" for i, (m, f) in enumerate(MODELS))

#: {div} is the integer division of the dialect.
OBSERVATIONS = f"""
with d as (select doc_id, text, lang, cast(n_chars as bigint) as n from documents),
m as (select * from (values {_MODELS}) v(mi, model_name, family)),
r as (select * from (values (0), (1), (2)) v(rep))
select m.model_name, m.family, m.mi as ord, concat(d.lang, '_partial_', cast(d.doc_id as varchar(20))) as probe_id, d.lang as category,
  cast(d.doc_id * 10 + r.rep as bigint) as seq,
  case when (d.doc_id + m.mi * 7) % 97 = 0 or (d.doc_id + m.mi) % 211 = 5 then ''
       else substring(d.text, cast(1 + (d.doc_id * (3 + 2 * (m.mi {{div}} 2))) % 41 as int),
         cast(1 + (d.doc_id * (1 + (m.mi {{div}} 2))) % 4 + case when d.doc_id % (4 + m.mi) = 0 then 1 else 0 end
              + case when r.rep = 2 and d.doc_id % 50 = 0 then 1 else 0 end as int)) end as output_text,
  case when (d.doc_id + m.mi) % 211 = 5 then 'http 500' end as error
from d cross join m cross join r
where r.rep = 0 or d.doc_id % 10 = 0
"""

DUCKDB = OBSERVATIONS.format(div="//")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(OBSERVATIONS.format(div="div").replace("from documents", "from {documents}"), documents=docs)


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, f, i) for i, (m, f) in enumerate(MODELS)], "model_name string, family string, ord int")

import os
import random
import zlib

import duckdb
import numpy as np
import pytest
import test_operators as T
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from spanforge.llm import packing, pii, quality_lm
from spanforge.llm import queries as Q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages_keep_columns_and_filter(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DIR)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]
    last = docs.toPandas()
    assert set(last.columns) >= {"doc_id", "piece", "sequence_id", "offset", "length"} and last.doc_id.nunique() == counts[4]


def test_run_equals_brute_force(spark, tmp_path):
    """Each stage by its definition, on a small corpus with junk, copies, leaked passages, personal data, nulls and a long text."""
    rng = random.Random(5)
    syllables = ["th", "an", "er", "on", "re", "ing", "st", "le", "mo", "ka"]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."
    items = [("b%d" % i, prose(14)) for i in range(4)]
    texts = [prose(80) for _ in range(60)]
    texts += ["".join(rng.choice("#%&$QXZJ ") for _ in range(300)) for _ in range(5)]
    texts += [texts[3], texts[4] + " more", texts[5].replace(" ", "  "), prose(200) + " " + items[1][1] + " " + prose(200), items[2][1], "short text", "short text", None, "", prose(4000)]
    texts += [prose(900) + " Write to ann.b@mail.example.org or +49 30 1234567. Dr. Anna Petrov left; Petrov said so. " + prose(900)]
    texts += [prose(120) for _ in range(120)]
    rows = [(i, t, "en" if i % 3 else None, "s%d" % (i % 2), len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(0, 60, 2), *range(76, 196, 2)]] + [(60, 0, 0)], "doc_id bigint, quality int, toxic int")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(items, "item_id string, text string"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")

    kept = {r.doc_id for r in quality_lm.classify(docs, labels).collect() if r.keep}
    assert kept.isdisjoint(range(60, 65)) and len(kept) >= 60 and {3, 4, 5, 68, 75} <= kept
    left = sorted(kept)
    low = T.components_by_force(left, lambda a, b: (texts[a] or "").split() != [] != (texts[b] or "").split() and T.similarity_by_force(texts[a] or "", texts[b] or "") >= 0.8 or not (texts[a] or "").split() and not (texts[b] or "").split())
    left = sorted(set(low.values()))
    leaked = [r[2] > 0 for r in T.contamination_by_force([texts[i] for i in left], items)]
    left = [i for i, bad in zip(left, leaked) if not bad]
    assert {3, 4, 5} <= set(left) and not {65, 66, 67, 68, 69} & set(left)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i in left:
        text, _ = pii.replace(texts[i], pii.session_key(spark))
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(i, k, a, n, zlib.crc32(np.array(ids[a : a + n], dtype="<u4").tobytes())) for k, (a, n) in enumerate(packing.cuts(len(ids)))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(p)]).tolist()]
        assert [o for o, _ in sorted(p)] == ends[:-1] and ends[-1] <= packing.CAPACITY


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        assert out.count() == 0 and (i + 1 == len(corpus_pipeline.STAGES) or out.columns == docs.columns), name


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    want = c.execute(Q.oracle_sql()[name]).df()
    got = Q.queries()[name](spark, DIR).toPandas()
    cols = sorted(want.columns)
    key = lambda df: sorted(map(str, df[cols].itertuples(index=False, name=None)))
    assert sorted(got.columns) == cols and key(got) == key(want)

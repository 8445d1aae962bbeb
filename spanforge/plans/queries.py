"""Registered queries of the engine over the driver's tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import features, generator, lineage, observations, probes, similarity, vocabulary
from spanforge.sources import connector, readers, sinks, synthetic, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return synthetic.observations(spark, d)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- SQL pieces ------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, {_q(T.STRIP)}, '', 'g')"


def _classify(c: str) -> str:
    m = lambda x, p: f"regexp_matches({x}, {_q(p)})"
    s = _strip(c)
    rules = [
        (f"{c} = ''", "empty"), (m(c, r"\A[\n\r]"), "newline_prefixed"), (m(c, r"\A[ \t]"), "whitespace_prefixed"), (f"{s} = ''", "empty"), (m(s, T.EMOJI), "emoji_symbol"), (m(s, T.URL), "url_like"),
        (m(s, T.JSON), "json_like"), (m(s, T.CODE), "code_like"), (m(s, T.NUMBER), "digit"), (m(s, T.PUNCTUATION), "punctuation"), (f"{m(s, T.CJK)} and {m(s, '[A-Za-z]')}", "mixed_script"),
        (m(s, T.CJK), "cjk"), (m(s, "[A-Za-z]"), "latin"),
    ]
    return "case " + " ".join(f"when {c} then '{v}'" for c, v in rules) + " else 'other' end"


_O = f"obs as ({synthetic.DUCKDB.strip()})"
_FIRST = f"""{_O}, v as (select * from obs where error is null), c as (select *, {_classify("output_text")} as token_type from v),
f as (select * from c qualify row_number() over (partition by model_name, probe_id order by seq) = 1)"""
_PAIRS = f"""{_FIRST}, s as (select model_name, family, ord, probe_id, length(output_text) as ch, strlen(output_text) as by_, output_text like ' %' as sp, starts_with(output_text, chr(10)) as nl, token_type as ty, output_text = '' as em from f),
m as (select a.model_name as model_a, a.family as family_a, a.ord as ord_a, b.model_name as model_b, b.family as family_b, b.ord as ord_b,
  (a.ch = b.ch)::int as mc, (a.by_ = b.by_)::int as mb, (a.ty = b.ty)::int as mt, (a.sp = b.sp and a.nl = b.nl)::int as mp, (a.em = b.em)::int as me,
  (a.ch = b.ch and a.by_ = b.by_ and a.ty = b.ty and a.sp = b.sp and a.nl = b.nl and a.em = b.em)::int as mx
  from s a join s b on a.probe_id = b.probe_id and a.ord < b.ord),
p as (select model_a, family_a, ord_a, model_b, family_b, ord_b, count(*) as common_probe_count, sum(mx)::bigint / count(*)::double as bcs, sum(mc)::bigint / count(*)::double as char_length_match_rate,
  sum(mb)::bigint / count(*)::double as byte_length_match_rate, sum(mt)::bigint / count(*)::double as token_type_match_rate, sum(mp)::bigint / count(*)::double as prefix_match_rate, sum(me)::bigint / count(*)::double as empty_match_rate,
  sum(mx)::bigint / count(*)::double as score from m group by all)"""
_NEAR = f"""{_PAIRS}, d as (select model_a as model, family_a as family, model_b as neighbour, family_b as neighbour_family, score, ord_b as o from p union all
  select model_b, family_b, model_a, family_a, score, ord_a from p),
n as (select model, family, neighbour, neighbour_family, score, row_number() over (partition by model order by score desc, o) as rank from d)"""
_TOK = f"""{_O}, t as (select model_name, family, ord, case when output_text = '' then '<EMPTY>' else output_text end as token, count(*) as n, min(seq) as first_seq from obs group by all)"""
_VP = f"""{_TOK}, own as (select model_name, family, ord, count(*) as size, sum(n)::bigint as total, count(*) filter (n <= 3) as rare from t group by all),
i as (select a.ord as ord_a, b.ord as ord_b, count(*) as inter, sum(least(a.n, b.n))::bigint as low, count(*) filter (a.n <= 3 and b.n <= 3) as both_rare from t a join t b on a.token = b.token and a.ord < b.ord group by all),
q as (select a.model_name as model_a, a.family as family_a, a.ord as ord_a, b.model_name as model_b, b.family as family_b, b.ord as ord_b, a.family = b.family as same_family, a.size as unique_token_count_a, b.size as unique_token_count_b,
  coalesce(inter, 0) as intersection_token_count, coalesce(inter, 0) / (a.size + b.size - coalesce(inter, 0))::double as jaccard, coalesce(inter, 0) / a.size::double as coverage_a_to_b, coalesce(inter, 0) / b.size::double as coverage_b_to_a,
  coalesce(low, 0) / (a.total + b.total - coalesce(low, 0))::double as weighted_jaccard,
  case when a.rare + b.rare - coalesce(both_rare, 0) > 0 then coalesce(both_rare, 0) / (a.rare + b.rare - coalesce(both_rare, 0))::double else 0e0 end as rare_token_jaccard
  from own a join own b on a.ord < b.ord left join i on i.ord_a = a.ord and i.ord_b = b.ord),
vp as (select *, round(0.60e0 * weighted_jaccard + 0.25e0 * jaccard + 0.15e0 * rare_token_jaccard, 9) as vocab_score from q)"""
_CONT = f"""{_VP}, dir as (select model_a as source_model, family_a as source_family, model_b as candidate_model, family_b as candidate_family, same_family, coverage_a_to_b as shell_confidence, unique_token_count_a as source_vocab_size,
  unique_token_count_b as candidate_vocab_size, intersection_token_count, jaccard, weighted_jaccard, rare_token_jaccard, coverage_b_to_a as reverse_shell_confidence, round(coverage_a_to_b - coverage_b_to_a, 9) as containment_gap, ord_b as o from vp
  union all select model_b, family_b, model_a, family_a, same_family, coverage_b_to_a, unique_token_count_b, unique_token_count_a, intersection_token_count, jaccard, weighted_jaccard, rare_token_jaccard, coverage_a_to_b,
  round(coverage_b_to_a - coverage_a_to_b, 9), ord_a from vp),
k as (select * exclude (o), row_number() over (partition by source_model order by shell_confidence desc, o) as rank from dir)"""
_TRUTH = [("m0", "m1"), ("m1", "m0"), ("m2", "m3"), ("m3", "m2"), ("m4", "m5")]
_TRUTH_SQL = "truth as (select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in _TRUTH) + ") v(model_name, target_model))"
_TOPS = f"""{_CONT}, {_TRUTH_SQL}, tops as (select source_model as model, max(candidate_model) filter (rank = 1) as top1_model, max(shell_confidence) filter (rank = 1) as score,
  round(max(shell_confidence) filter (rank = 1) - coalesce(max(shell_confidence) filter (rank = 2), 0), 9) as margin from k group by 1),
sweep as (select score_threshold, margin_threshold, count(*) filter (said and hit) as tp, count(*) filter (said and not hit) as fp, count(*) filter (not said and pos) as fn, count(*) filter (not said and not pos) as tn from (
  select s.score_threshold, g.margin_threshold, t.score >= s.score_threshold and t.margin >= g.margin_threshold as said, exists (select 1 from truth where model_name = t.model and target_model = t.top1_model) as hit,
  exists (select 1 from truth where model_name = t.model) as pos from tops t, (select distinct round(score, 4) as score_threshold from tops) s, (select round(margin, 4) as margin_threshold from tops union select 0e0) g) group by 1, 2),
sw as (select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0e0 end as precision, case when tp + fn > 0 then tp / (tp + fn)::double else 0e0 end as recall, (tp + tn) / (tp + fp + fn + tn)::double as accuracy from sweep),
swf as (select *, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0e0 end, 9) as f1 from sw)"""


def _truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TRUTH, "model_name string, target_model string")


# ---- scans and scalar functions ----------------------------------------------------------------------


@query(f"with {_O} select model_name, probe_id, seq, output_text, error from obs")
def scan_observations(spark, d):
    return _obs(spark, d).select("model_name", "probe_id", "seq", "output_text", "error")


@query("select concat(lang, '_partial_', cast(doc_id as varchar)) as probe_id, text, lang as category, 0e0 as truncation_ratio, 'mixed' as source_lang from documents")
def scan_probes(spark, d):
    docs = _table(spark, d, "documents")
    return docs.select(F.concat("lang", F.lit("_partial_"), F.col("doc_id")).alias("probe_id"), "text", F.col("lang").alias("category"), F.lit(0.0).alias("truncation_ratio"), F.lit("mixed").alias("source_lang"))


@query(f"with {_O} select model_name, seq, length(output_text) as char_length, strlen(output_text) as byte_length from obs")
def token_lengths(spark, d):
    t = F.col("output_text")
    return _obs(spark, d).select("model_name", "seq", T.char_length(t).alias("char_length"), T.byte_length(t).alias("byte_length"))


@query(f"with {_O} select model_name, seq, starts_with(output_text, ' ') as has_leading_space, starts_with(output_text, chr(10)) as has_leading_newline, output_text = '' as is_empty from obs")
def token_flags(spark, d):
    t = F.col("output_text")
    return _obs(spark, d).select("model_name", "seq", F.startswith(t, F.lit(" ")).alias("has_leading_space"), F.startswith(t, F.lit("\n")).alias("has_leading_newline"), (t == "").alias("is_empty"))


@query(f"with {_O} select model_name, seq, output_text, {_classify('output_text')} as token_type from obs")
def classify_tokens(spark, d):
    return _obs(spark, d).select("model_name", "seq", "output_text", T.classify(F.col("output_text")).alias("token_type"))


@query(f"with x as (select page_id, unnest(string_split_regex(html, '[\\s<>]+')) as piece from pages) select page_id, piece, {_classify('piece')} as token_type, count(*) as n from x group by all")
def classify_page_pieces(spark, d):
    pieces = _table(spark, d, "pages").select("page_id", F.explode(F.split("html", r"[\s<>]+")).alias("piece"))
    return pieces.groupBy("page_id", "piece", T.classify(F.col("piece")).alias("token_type")).agg(F.count("*").alias("n"))


@query(f"with {_FIRST} select model_name, probe_id, concat_ws('|', length(output_text), strlen(output_text), starts_with(output_text, ' ')::int, starts_with(output_text, chr(10))::int, token_type, (output_text = '')::int) as sig from f")
def boundary_signature(spark, d):
    rows = observations.first_results(_obs(spark, d), "output_text")
    s = T.signature(F.col("output_text"), T.classify(F.col("output_text")))
    rows = rows.withColumn("s", s)
    bit = lambda c: F.col(f"s.{c}").cast("int").cast("string")
    return rows.select("model_name", "probe_id", F.concat_ws("|", F.col("s.chars").cast("string"), F.col("s.bytes").cast("string"), bit("space"), bit("newline"), "s.type", bit("empty")).alias("sig"))


@query(f"with {_O}, x as (select model_name, seq, output_text, regexp_replace(output_text, '\\A[\\r\\n]+', '') as normalized_text from obs) select model_name, seq, normalized_text, normalized_text <> output_text as changed from x")
def normalize_outputs(spark, d):
    return observations.audit_leading_newlines(_obs(spark, d)).select("model_name", "seq", "normalized_text", "changed")


@query(f"with {_O}, x as (select model_name, seq, {_strip('output_text')} as t from obs) select model_name, seq, case when t = '' then '<EMPTY>' else t end as token from x")
def vocab_token_text(spark, d):
    return _obs(spark, d).select("model_name", "seq", T.vocab_token(F.col("output_text"), stripped=True).alias("token"))


@query("select doc_id, concat(lang, '_', substr(sha1(concat(lang, chr(0), text)), 1, 12)) as id from documents")
def stable_ids(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.stable_id(F.col("lang"), F.col("text")).alias("id"))


@query("select doc_id, substring(text, 1, greatest(1, cast(floor(length(text) * 0.65e0) as int))) as text from documents")
def probe_truncate(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), F.lit(0.65)).alias("text"))


@query(f"with {_O} select distinct probe_id, split_part(probe_id, '_partial_', 1) as lang from obs")
def lang_from_probe_id(spark, d):
    return _obs(spark, d).select("probe_id", T.language_of(F.col("probe_id")).alias("lang")).distinct()


@query("select source, lang, coalesce(nullif(trim(regexp_replace(lower(concat(' ', lang, '--', source, '!')), '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'family') as slug from documents group by all")
def slugify(spark, d):
    return _table(spark, d, "documents").select("source", "lang").distinct().withColumn("slug", T.slugify(F.concat(F.lit(" "), "lang", F.lit("--"), "source", F.lit("!"))))


@query("select doc_id, length(regexp_replace(text, '\\P{Latin}', '', 'g')) as latin, length(regexp_replace(text, '\\P{Han}', '', 'g')) as han from documents")
def script_counts(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.script_count(F.col("text"), "Latin").alias("latin"), T.script_count(F.col("text"), "Han").alias("han"))


@query(f"with {_O}, c as (select model_name, seq, output_text, case when seq % 3 = 0 then '' when seq % 3 = 1 then 'other' else {_classify('output_text')} end as recorded from obs) select model_name, seq, case when recorded not in ('other', '') then recorded when output_text = '' then 'empty' when starts_with(output_text, chr(10)) then 'newline_prefixed' when starts_with(output_text, ' ') then 'whitespace_prefixed' else coalesce(nullif(recorded, ''), 'other') end as strict, coalesce(nullif(recorded, ''), 'other') as soft from c")
def recorded_types(spark, d):
    """Types of rows whose record says nothing, "other", or a type."""
    rows = _obs(spark, d)
    recorded = F.when(F.col("seq") % 3 == 0, "").when(F.col("seq") % 3 == 1, "other").otherwise(T.classify(F.col("output_text")))
    rows = rows.withColumn("recorded", recorded)
    return rows.select("model_name", "seq", T.strict_type(F.col("recorded"), F.col("output_text")).alias("strict"), T.soft_type(F.col("recorded")).alias("soft"))


@query(f"with {_O} select model_name, seq, to_json(output_text)::varchar as literal, printf('%.8f', seq / 7e0) as share from obs")
def json_literals(spark, d):
    return _obs(spark, d).select("model_name", "seq", T.json_string(F.col("output_text")).alias("literal"), T.share_text(F.col("seq") / F.lit(7.0)).alias("share"))


@query("select doc_id, replace(replace(concat(source, '/', lang, ':', doc_id), '/', '_'), ':', '_') as file_name, replace(concat(source, '/', lang), '/', '__') as folder, sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') as hash from documents")
def names_and_hashes(spark, d):
    name = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(":"), F.col("doc_id"))
    values = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return _table(spark, d, "documents").select("doc_id", T.sanitize_model_name(name).alias("file_name"), T.directory_name(F.concat_ws("/", "source", "lang")).alias("folder"), T.canonical_hash(values).alias("hash"))


_MARKS = ", ".join(_q(m.lower()) for m in connector.FATAL_MARKERS)


@query(f"with {_O}, e as (select model_name, seq, output_text, case when error is not null then case when seq % 2 = 0 then error else 'HTTP 403: Forbidden' end end as error from obs) select model_name, seq, coalesce(list_bool_or(list_transform([{_MARKS}], lambda m: contains(lower(error), m))), false) as fatal, error is null and output_text in ({', '.join(map(_q, connector.THINKING))}) as thinking from e")
def error_predicates(spark, d):
    rows = _obs(spark, d).withColumn("error", F.when(F.col("error").isNotNull(), F.when(F.col("seq") % 2 == 0, F.col("error")).otherwise("HTTP 403: Forbidden")))
    return observations.error_predicates(rows, connector.FATAL_MARKERS, connector.THINKING).select("model_name", "seq", "fatal", "thinking")


@query(f"with {_O}, p as (select concat(lang, '_partial_', cast(doc_id as varchar)) as probe_id, source from documents where doc_id in (select doc_id from labels)) select model_name, o.probe_id, seq, p.source from obs o join p on p.probe_id = o.probe_id")
def known_probe_results(spark, d):
    known = _table(spark, d, "documents").join(_table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(F.concat("lang", F.lit("_partial_"), F.col("doc_id")).alias("probe_id"), "source")
    return observations.with_probe(_obs(spark, d), known, "source").select("model_name", "probe_id", "seq", "source")


@query("select doc_id as seq, text from documents order by doc_id limit 100")
def first_probes(spark, d):
    return observations.first_probes(_table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text"), 100)


@query("select lang, coalesce(case when doc_id % 3 = 0 then lang when doc_id % 3 = 1 then lang end, 'mixed') as value, count(*) as n from documents group by 1, 2")
def coerced_values(spark, d):
    """Values written as an object, as text, or not at all."""
    docs = _table(spark, d, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.col("lang").alias("value")))).when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return docs.groupBy("lang", T.text_of(raw, F.lit("mixed")).alias("value")).agg(F.count("*").alias("n"))


_GENERATED = f"""with w as (select * from (values {", ".join(f"({_q(k)}, {v!r}e0, {i})" for i, (k, v) in enumerate(generator.WEIGHTS.items()))}) v(category, weight, o)),
a as (select category, o, greatest(1, cast(floor(total * weight / {sum(generator.WEIGHTS.values())!r}e0) as int)) as n, total from w, (select count(*) as total from documents)),
q as (select category, n + case when o = 0 then greatest(0, total - sum(n) over ()) else 0 end as n from a), i as (select category, unnest(range(0, n::bigint)) as i from q),
t as (select * from (values {", ".join(f"({_q(k)}, {j}, {_q(x)})" for k, v in generator.TEMPLATES.items() for j, x in enumerate(v))}) v(category, j, whole)),
n as (select category, count(*) as size from t group by 1), r as (select * from (values {", ".join(f"({j}, {x!r}e0)" for j, x in enumerate(generator.RATIOS))}) v(k, ratio)),
d as (select category, i, ('0x' || substr(md5(category || '|' || i || '|text|42'), 1, 8))::bigint % size as j, ('0x' || substr(md5(category || '|' || i || '|ratio|42'), 1, 8))::bigint % {len(generator.RATIOS)} as k from i join n using (category))
select category || '_' || substr(md5(category || '|' || i || '|42'), 1, 12) as probe_id, case when category = '{generator.PARTIAL}' then whole else substring(whole, 1, greatest(1, cast(floor(length(whole) * ratio) as int))) end as text, category,
  case when category = '{generator.PARTIAL}' then 0e0 else ratio end as truncation_ratio, case category {" ".join(f"when {_q(k)} then {_q(v)}" for k, v in generator.LANGUAGE.items())} else 'mixed' end as source_lang from d join t using (category, j) join r using (k)"""


@query(_GENERATED)
def generated_probes(spark, d):
    return generator.generate(spark, _table(spark, d, "documents").count())


# ---- written and read again ------------------------------------------------------------------------------


@query(f"with {_O} select model_name, probe_id, output_text, error is not null as failed, count(*) as n from obs group by all")
def log_round_trip(spark, d):
    """Results appended as JSON lines and read strictly."""
    path = tables.scratch(spark)
    rows = _obs(spark, d).withColumn("raw_response", F.struct("error"))
    sinks.append_observations(rows.drop("error", "seq"), path)
    back = readers.observations(spark, path)
    return back.groupBy("model_name", "probe_id", "output_text", F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"))


@query("select concat(lang, '_partial_', cast(doc_id as varchar)) as probe_id, text, lang as category, 0e0 as truncation_ratio, 'mixed' as source_lang from documents")
def probes_round_trip(spark, d):
    path = tables.scratch(spark)
    sinks.probes(scan_probes(spark, d).select(F.col("probe_id").alias("id"), "text", "category"), path)
    return readers.probes(spark, path, lines=True).drop("metadata")


@query(f"with {_FIRST} select model_name, family, ord, probe_id, output_text from f")
def bank_round_trip(spark, d):
    path = tables.scratch(spark)
    sinks.bank(observations.first_results(_obs(spark, d), "output_text", "family", "ord"), path)
    return readers.bank(spark, path).select("model_name", "family", F.col("ord").cast("int").alias("ord"), "probe_id", "output_text")


@query(f"with {_PAIRS} select model_a, model_b, common_probe_count, bcs from p")
def pair_table_round_trip(spark, d):
    path = tables.scratch(spark)
    sinks.comparison(similarity.pair_scores(_obs(spark, d)), path)
    return readers.pair_table(spark, f"{path}.json").select("model_a", "model_b", "common_probe_count", "bcs")


@query(f"with {_TOK.replace('from obs group', 'from obs where error is null group')} select model_name, token as next_token_display, n as frequency, row_number() over (partition by model_name order by n desc, token) as rank, case when token = '<EMPTY>' then 0 else length(token) end as char_length, token = '<EMPTY>' as is_empty_token from t")
def vocabulary_round_trip(spark, d):
    path = tables.scratch(spark)
    sinks.vocabulary(vocabulary.ranked(_obs(spark, d)), path, form="json")
    back = spark.read.schema("model_name string, next_token_display string, frequency bigint, rank bigint, char_length bigint, is_empty_token boolean").json(path)
    return back


# ---- filters, resumption, quality -----------------------------------------------------------------------


@query(f"with {_O} select model_name, probe_id, seq, output_text from obs where error is null")
def valid_observations(spark, d):
    return observations.valid(_obs(spark, d)).select("model_name", "probe_id", "seq", "output_text")


@query(f"with {_FIRST} select model_name, probe_id, seq, output_text, token_type from f")
def first_results(spark, d):
    rows = observations.first_results(_obs(spark, d), "output_text")
    return rows.withColumn("token_type", T.classify(F.col("output_text")))


def _excluded(spark, d):
    bad = _table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("b"))
    docs = _table(spark, d, "documents")
    return docs.join(bad, docs["doc_id"] == bad["b"], "left_semi").select(F.concat("lang", F.lit("_partial_"), F.col("doc_id")).alias("probe_id"))


_BAD = "bad as (select concat(lang, '_partial_', cast(doc_id as varchar)) as probe_id from documents where doc_id in (select doc_id from labels where quality = 0))"


@query(f"with {_O}, {_BAD} select model_name, probe_id, seq from obs where probe_id not in (select probe_id from bad)")
def exclude_probes(spark, d):
    return observations.exclude(_obs(spark, d), _excluded(spark, d)).select("model_name", "probe_id", "seq")


@query(f"with {_O}, {_BAD}, r as (select distinct probe_id, case when probe_id in (select probe_id from bad) then 2 else 1 end as required from obs), x as (select o.*, r.required, row_number() over (partition by model_name, o.probe_id order by seq) as rank from obs o join r on r.probe_id = o.probe_id where error is null) select model_name, probe_id, seq from x where rank <= required")
def resume_completed(spark, d):
    obs = _obs(spark, d)
    bad = _excluded(spark, d).withColumn("required", F.lit(2))
    required = obs.select("probe_id").distinct().join(bad, "probe_id", "left").fillna(1, ["required"])
    return observations.keep_required(obs, required).select("model_name", "probe_id", "seq")


@query(f"with {_O}, r as (select distinct probe_id, 2 as required from obs), e as (select probe_id, count(*) as done from obs where error is null and model_name = 'm0' group by 1), x as (select r.probe_id, r.required - coalesce(done, 0) as n from r left join e on e.probe_id = r.probe_id) select probe_id, unnest(range(1, n + 1)) as attempt from x where n > 0")
def pending_probes(spark, d):
    obs = _obs(spark, d)
    required = obs.select("probe_id").distinct().withColumn("required", F.lit(2))
    return observations.pending(required, obs, "m0").withColumn("attempt", F.col("attempt").cast("bigint"))


_BOTH = "select sha1(text) as probe_id, text, doc_id as seq, 0 as part from documents where doc_id in (select doc_id from labels) union all select sha1(text), text, doc_id, 1 from documents"


@query(f"with u as ({_BOTH}) select probe_id, text, seq, part from u qualify row_number() over (partition by probe_id order by part, seq) = 1")
def merge_probes(spark, d):
    """The labelled documents, then all: two sets that overlap, with a probe id for each text."""
    docs = _table(spark, d, "documents").select(F.sha1(F.col("text").cast("binary")).alias("probe_id"), "text", F.col("doc_id").alias("seq"))
    known = _table(spark, d, "labels").select(F.col("doc_id").alias("seq")).distinct()
    return observations.merge(docs.join(known, "seq", "left_semi").select(*docs.columns), docs)


@query(f"with {_O}, per as (select model_name, probe_id, count(*) as n, count(*) filter (error is not null) as bad, count(*) filter (error is null and output_text = '') as void from obs group by all) select model_name, sum(n)::bigint as total_rows, sum(n - bad)::bigint as usable_rows, sum(bad)::bigint as failed_rows, sum(void)::bigint as empty_rows, count(*) filter (n > bad) as usable_probes, count(*) filter (n = bad) as failed_only_probes from per group by 1")
def raw_summary(spark, d):
    return observations.raw_summary(_obs(spark, d))


@query(f"with {_O} select model_name, split_part(probe_id, '_partial_', 1) as lang, count(*) as n, count(*) filter (error is null and output_text = '') as empties, count(*) filter (error is not null) as errors from obs group by all")
def lang_quality(spark, d):
    return observations.language_quality(_obs(spark, d))


@query(f"with {_O}, c as (select split_part(probe_id, '_partial_', 1) as lang, output_text, count(*) as n from obs where error is null group by all) select lang, output_text, n, row_number() over (partition by lang order by n desc, output_text) as rank from c qualify rank <= 10")
def lang_top_outputs(spark, d):
    return observations.language_top_outputs(_obs(spark, d))


@query(f"with {_O} select model_name, count(*) as n, count(*) filter (error is not null) as errors, count(*) filter (output_text = '') / count(*)::double as empty_rate, count(*) filter (error is not null) = 0 and count(*) filter (output_text = '') / count(*)::double <= 0.3e0 as passed from obs group by 1")
def smoke_gate(spark, d):
    return observations.smoke_gate(_obs(spark, d))


@query(f"with {_O}, e as (select count(*) as n_expected from documents) select model_name, n_expected, count(*) as rows, count(distinct probe_id) as probes, count(*) = n_expected and count(distinct probe_id) = n_expected as complete from obs, e group by model_name, n_expected")
def completeness_gate(spark, d):
    expected = synthetic.models(spark).select("model_name").crossJoin(_table(spark, d, "documents").agg(F.count("*").alias("n_expected")))
    return observations.completeness_gate(_obs(spark, d), expected)


@query(f"with {_O} select o.model_name, o.seq, length(d.text) as n_text, case when error is not null or output_text = '' then 'fail' else 'pass' end as code from obs o left join documents d on o.probe_id = concat(d.lang, '_partial_', cast(d.doc_id as varchar))")
def evaluation_rows(spark, d):
    out = observations.evaluation_rows(_obs(spark, d), scan_probes(spark, d))
    return out.select("model_name", "seq", F.char_length("probe_text").cast("bigint").alias("n_text"), "code")


@query(f"with {_FIRST} select model_name, family, 'rows/family=' || family || '/model=' || model_name as path, count(distinct probe_id) as n_probes, ord as bank_ord from f group by model_name, family, ord")
def bank_index(spark, d):
    path = tables.scratch(spark)
    sinks.bank(observations.first_results(_obs(spark, d), "output_text", "family", "ord"), path)
    return readers.bank_index(spark, f"{path}/index.json")


@query("select source as model_name, 'target of ' || source as target_model from (select distinct source from documents where source is not null)")
def truth_parse(spark, d):
    """A line for each source, with a target and with none."""
    n = F.row_number().over(Window.orderBy("source")) * 3  # a row per source
    names = _table(spark, d, "documents").select("source").where("source is not null").distinct().withColumn("n", n)
    lines = F.array(*(F.struct((F.col("n") + i).alias("n"), F.concat(*parts).alias("value")) for i, parts in enumerate(((F.lit("  "), F.col("source"), F.lit(":")), (F.lit("    - 'target of "), F.col("source"), F.lit("'")), (F.lit("    - none"),)))))
    return readers.truth_lines(names.select(F.explode(lines).alias("x")).select("x.*"))


@query("select distinct concat(lang, '_partial_', cast(doc_id as varchar)) as probe_id from documents where doc_id in (select doc_id from labels where quality = 0)")
def exclude_list(spark, d):
    """Ids written as one JSON list, as text and as objects, and read again."""
    path = tables.scratch(spark)
    ids = _excluded(spark, d).select(F.when(F.length("probe_id") % 2 == 0, F.to_json(F.struct(F.col("probe_id").alias("id")))).otherwise(F.concat(F.lit('"'), "probe_id", F.lit('"'))).alias("x"))
    whole = ids.agg(F.concat(F.lit('{"blacklist": ['), F.concat_ws(", ", F.collect_list("x")), F.lit("]}")).alias("value"))  # a list is one text
    whole.coalesce(1).write.text(path)
    return readers.exclude_list(spark, path)


@query(f"with {_O} select model_name, probe_id, output_text, count(*) as n from obs where seq % 7 <> 0 group by all")
def lenient_log(spark, d):
    """A log in which every seventh line is no object."""
    path = tables.scratch(spark)
    rows = _obs(spark, d)
    line = F.when(F.col("seq") % 7 == 0, F.when(F.col("seq") % 2 == 0, F.lit("[1, 2]")).otherwise(F.concat(F.lit('{"probe_id": "'), "probe_id"))).otherwise(F.to_json(F.struct("model_name", "probe_id", "output_text")))
    rows.select(line.alias("value")).write.text(path)
    return readers.observations(spark, path, strict=False).groupBy("model_name", "probe_id", "output_text").agg(F.count("*").alias("n"))


# ---- features --------------------------------------------------------------------------------------------


def _hist(length: str) -> str:
    return f"with {_O} select model_name, {length} as bucket, count(*) as n, count(*) / sum(count(*)) over (partition by model_name)::double as share from obs where error is null group by model_name, {length}"


@query(_hist("length(output_text)"))
def char_len_hist(spark, d):
    return features.length_histogram(_obs(spark, d))


@query(_hist("strlen(output_text)"))
def byte_len_hist(spark, d):
    return features.length_histogram(_obs(spark, d), "byte")


@query(f"with {_O} select model_name, round(coalesce(avg(case when length(output_text) > 0 then strlen(output_text) / length(output_text)::double end), 0), 9) as bytes_per_char, count(*) filter (starts_with(output_text, ' ')) / count(*)::double as leading_space_rate, count(*) filter (starts_with(output_text, chr(10))) / count(*)::double as leading_newline_rate, count(*) filter (output_text = '') / count(*)::double as empty_rate from obs where error is null group by 1")
def surface_features(spark, d):
    return features.surface(_obs(spark, d))


@query(f"with {_O}, c as (select model_name, {_classify('output_text')} as token_type from obs where error is null) select model_name, token_type, count(*) as n, count(*) / sum(count(*)) over (partition by model_name)::double as share from c group by model_name, token_type")
def type_distribution(spark, d):
    return features.type_distribution(_obs(spark, d))


@query(f"with {_O}, c as (select model_name, category, {_classify('output_text')} as token_type from obs where error is null) select model_name, category, token_type, count(*) as n, count(*) / sum(count(*)) over (partition by model_name, category)::double as share from c group by model_name, category, token_type")
def transition_matrix(spark, d):
    return features.transitions(_obs(spark, d))


@query(f"with {_O} select model_name, count(*) as total, count(*) filter (error is not null) as failed, count(distinct case when error is null then probe_id end) as n_probes from obs group by 1")
def collection_metadata(spark, d):
    return features.metadata(_obs(spark, d))


# ---- pairs, bank, decision ---------------------------------------------------------------------------------


@query(f"with {_PAIRS} select * from p")
def bcs_pairs(spark, d):
    return similarity.pair_scores(_obs(spark, d))


@query(f"with {_PAIRS} select * replace (round(0.60e0 * bcs + 0.07e0 * char_length_match_rate + 0.07e0 * byte_length_match_rate + 0.16e0 * token_type_match_rate + 0.07e0 * prefix_match_rate + 0.03e0 * empty_match_rate, 9) as score) from p")
def soft_bcs_pairs(spark, d):
    return similarity.soft_pair_scores(_obs(spark, d))


@query(f"with {_PAIRS} select model_a, model_b, bcs as bootstrap_mean, round(sqrt(bcs * (1 - bcs) / greatest(1, floor(common_probe_count * 0.8e0))), 9) as bootstrap_std from p")
def bootstrap_bcs(spark, d):
    return similarity.bootstrap_closed(similarity.pair_scores(_obs(spark, d)))


@query()
def bootstrap_bcs_exact(spark, d):
    return similarity.bootstrap_exact(_obs(spark, d))


@query(f"with {_O}, per as (select model_name, probe_id, count(*) as n, count(distinct output_text) as k from obs where error is null group by all having count(*) > 1) select model_name, count(*) filter (k > 1) / count(*)::double as stability_variance, count(*) as repeated_probes from per group by 1")
def stability_variance(spark, d):
    return similarity.stability(_obs(spark, d))


@query(f"with {_O}, x as (select model_name, probe_id, output_text, count(*) as n from obs where error is null group by all), per as (select model_name, probe_id, 1 - max(n) / sum(n)::double as miss from x group by all having sum(n) > 1) select model_name, round(avg(miss), 9) as stability_modal from per group by 1")
def stability_modal(spark, d):
    return similarity.stability_modal(_obs(spark, d))


_STATS = """stats as (select round(coalesce(avg(score), 0), 9) as mean, round(coalesce(stddev_samp(score), 0), 9) as std, list(score order by score) as s, count(*) as n_cross_pairs from {0} where family_a <> family_b)"""


@query(f"with {_PAIRS}, {_STATS.format('p')} select mean, std, s[least(len(s), floor(len(s) * 95 / 100)::int + 1)] as p95, s[least(len(s), floor(len(s) * 99 / 100)::int + 1)] as p99, s[len(s)] as max, n_cross_pairs, (select count(distinct model_name) from f) as n_models from stats")
def bank_statistics(spark, d):
    return similarity.bank_statistics(similarity.pair_scores(_obs(spark, d)))


@query(f"with {_NEAR} select * from n where rank <= 5")
def nearest_neighbors(spark, d):
    return similarity.neighbours(similarity.pair_scores(_obs(spark, d)))


@query(f"with {_NEAR}, x as (select model, max(neighbour) filter (rank = 1) as top1, max(score) filter (rank = 1) as top1_score, max(score) filter (rank = 2) as s2 from n group by 1) select model, top1, top1_score, round(top1_score - s2, 9) as margin, coalesce(top1_score >= 0.5e0 and top1_score - s2 >= 0.08e0, false) as same_source from x")
def bank_model_summary(spark, d):
    return similarity.bank_summary(similarity.pair_scores(_obs(spark, d)))


@query(f"""with {_NEAR}, others as (select * from p where model_a <> 'm4' and model_b <> 'm4'), {_STATS.format('others')},
t as (select max(score) filter (rank = 1) as s1, max(score) filter (rank = 2) as s2, max(neighbour) filter (rank = 1) as m1, max(neighbour_family) filter (rank = 1) as f1, max(neighbour_family) filter (rank = 2) as f2, max(neighbour_family) filter (rank = 3) as f3 from n where model = 'm4'),
b as (select arg_max(round(sqrt(bcs * (1 - bcs) / greatest(1, floor(common_probe_count * 0.8e0))), 9), bcs) as sd from p where 'm4' in (model_a, model_b)),
e as (select *, case when std > 0 then (s1 - mean) / std else 0e0 end as z, (s1 - s2) / (sd + 1e-10) as ms, 1 + (f2 = f1)::int + (f3 = f1)::int as kin from t, stats, b),
g as (select *, (case when z >= 2 then 2 when z >= 1.5 then 1 else 0 end) + (case when ms >= 3 then 2 when ms >= 2 then 1 else 0 end) + (case when kin >= 2 then 1 else 0 end) as f,
  (case when z < 0.5 and n_cross_pairs > 0 then 2 else 0 end) + (case when ms < 2 then 1 else 0 end) + (case when kin < 2 then 1 else 0 end) as a from e)
select 'm4' as target, case when f >= 3 or (f >= 2 and a <= 1) then 'same_source' else 'not_same_source' end as label,
  round(case when f >= 4 then least(0.95e0, 0.65e0 + 0.05e0 * f) when f >= 3 then least(0.85e0, 0.55e0 + 0.05e0 * f) when f >= 2 and a <= 1 then 0.5e0 + 0.05e0 * f else least(0.95e0, 0.55e0 + 0.1e0 * a) end, 9) as confidence,
  case when f >= 3 or (f >= 2 and a <= 1) then m1 end as same_source_of, round(z, 6) as z, round(s1 - s2, 9) as margin, f as evidence_for, a as evidence_against from g""")
def decision(spark, d):
    return similarity.decide(similarity.pair_scores(_obs(spark, d)), "m4").drop("diagnosis")


@query(f"with {_O}, i as (select distinct model_name, probe_id from obs), r as (select *, row_number() over (partition by model_name order by md5(probe_id || '|42'), probe_id) as k, count(*) over (partition by model_name) as n from i) select model_name, probe_id from r where k <= greatest(1, floor(n * 0.1e0))")
def stability_sample(spark, d):
    return similarity.stability_sample(_obs(spark, d))


# ---- vocabulary ---------------------------------------------------------------------------------------------


@query(f"with {_TOK.replace('from obs group', 'from obs where error is null group')} select model_name, token, n, n / sum(n) over (partition by model_name)::double as share, row_number() over (partition by model_name order by n desc, token) as rank from t")
def next_token_vocab(spark, d):
    return vocabulary.ranked(_obs(spark, d))


@query(f"with {_TOK} select model_name, token, n, n / sum(n) over (partition by model_name)::double as share, row_number() over (partition by model_name order by n desc, first_seq) as rank from t qualify rank <= 10")
def top_tokens(spark, d):
    return vocabulary.ranked(_obs(spark, d), include_errors=True, k=10, ties="first_seq")


@query(f"with {_TOK}, e as (select count(*) as n_expected from documents), x as (select model_name, sum(n)::bigint as total_token_count, count(*) as unique_token_count, coalesce(sum(n) filter (token = '<EMPTY>'), 0)::bigint as empty_token_count from t group by 1), y as (select model_name, count(distinct probe_id) as n_probes from obs group by 1) select x.*, n_probes, empty_token_count / total_token_count::double as empty_token_rate, n_expected, n_probes = n_expected as probe_count_matches_index from x join y using (model_name), e")
def model_vocab(spark, d):
    expected = synthetic.models(spark).select("model_name").crossJoin(_table(spark, d, "documents").agg(F.count("*").alias("n_expected")))
    return vocabulary.model_summary(_obs(spark, d), expected)


@query(f"with {_VP} select * from vp")
def vocab_pairs(spark, d):
    return vocabulary.pairs(_obs(spark, d))


@query(f"with {_VP} select same_family, count(*) as n, min(vocab_score) as min_score, max(vocab_score) as max_score, round(avg(vocab_score), 9) as mean_score from vp group by 1")
def vocab_family_report(spark, d):
    return vocabulary.family_report(vocabulary.pairs(_obs(spark, d)))


@query(f"with {_CONT} select * from k")
def vocab_containment(spark, d):
    return vocabulary.containment(vocabulary.pairs(_obs(spark, d)))


def _tops(spark, d):
    return vocabulary.top_rows(vocabulary.containment(vocabulary.pairs(_obs(spark, d))), "source_model", "candidate_model", "shell_confidence")


@query(f"with {_TOPS} select * from swf")
def threshold_sweep(spark, d):
    return vocabulary.threshold_sweep(_tops(spark, d), _truth(spark))


@query(f"with {_TOPS} select * from (select *, 'accuracy' as criterion from swf order by accuracy desc, f1 desc, precision desc, score_threshold, margin_threshold limit 1) union all select * from (select *, 'f1' as criterion from swf order by f1 desc, accuracy desc, precision desc, score_threshold, margin_threshold limit 1) union all select * from (select *, 'high_precision' as criterion from swf where precision >= 0.95 and tp > 0 order by recall desc, accuracy desc, f1 desc, score_threshold, margin_threshold limit 1)")
def threshold_best(spark, d):
    return vocabulary.best_thresholds(vocabulary.threshold_sweep(_tops(spark, d), _truth(spark)))


@query(f"with {_NEAR}, {_TRUTH_SQL}, b as (select model, min(rank) as best from n join truth t on t.model_name = n.model and t.target_model = n.neighbour group by 1), tm as (select distinct model_name as model from truth) select k, count(*) as n, count(*) filter (best <= k) as hits, count(*) filter (best <= k) / count(*)::double as hit_rate from tm left join b using (model), (values (1), (3), (5)) v(k) group by 1")
def topk_eval(spark, d):
    return vocabulary.topk_hits(similarity.neighbours(similarity.pair_scores(_obs(spark, d)), None), _truth(spark))


# ---- tokenizer lineage: sources stand in for tokenizers, the words of their texts for tokens. Of two sources there is
# a copy, and a chain of copies that each lack some tokens more: neighbours are near equivalent, the ends aren't.

_COPIES = (("src0", "copy", ""), ("src0", "less", "00"), ("src0", "lesser", "01"), ("src0", "least", "02"), ("src5", "copy", ""), ("src5", "far", "3f"))
_COPIES_SQL = "copies as (select * from (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _COPIES) + ") v(source, kind, upto))"
_META = f"""{_COPIES_SQL}, sources as (select source, row_number() over (order by source) - 1 as o from (select distinct source from documents where source is not null)),
models as (select source as name, source, '' as kind, '' as upto, o from sources union all select s.source || '_' || kind, s.source, kind, upto, o from sources s join copies c on c.source = s.source),
meta as (select name, source, upto, 'Family ' || cast(o % 3 as varchar(9)) as family, cast(row_number() over (order by name) - 1 as int) as ord,
  case when kind = '' then case when o % 2 = 0 then 'chat' else 'base' end when kind = 'copy' then 'instruct' else 'other' end as role, cast(case when kind = 'less' then 5 else 1000 end as int) as preferred_rank, case when o % 4 = 3 then 't' else 's' end as special_tokens from models)"""
_VOCAB = f"""{_META}, w as (select distinct source, unnest(string_split(text, ' ')) as token from documents),
vocab as (select m.name as model, token, length(token) + case when m.special_tokens = 't' then 1 else 0 end as id from w join meta m on m.source = w.source where upto = '' or substr(md5(token), 1, 2) > upto),
enc as (select name as model, cast(s as varchar(9)) as sample, source || '|' || cast(s as varchar(9)) as ids from meta, (select unnest(range(1, 5)) as s))"""
_TP = _VOCAB + """, sz as (select model, count(*) as size from vocab group by 1), mm as (select meta.*, coalesce(size, 0) as size from meta left join sz on model = name),
sh as (select ma.ord as oa, mb.ord as ob, count(*) as shared, count(*) filter (a.id = b.id) as idm from vocab a join meta ma on ma.name = a.model join vocab b on a.token = b.token join meta mb on mb.name = b.model and ma.ord < mb.ord group by all),
en as (select ma.ord as oa, mb.ord as ob, count(*) as n, count(*) filter (a.ids = b.ids) as same from enc a join meta ma on ma.name = a.model join enc b on a.sample = b.sample join meta mb on mb.name = b.model and ma.ord < mb.ord group by all),
z as (select a.name as model_a, a.family as family_a, b.name as model_b, b.family as family_b, a.size as sa, b.size as sb, coalesce(shared, 0) as sh, coalesce(idm, 0) as idm, coalesce(n, 0) as en, coalesce(same, 0) as es, a.special_tokens = b.special_tokens as sp
  from mm a join mm b on a.ord < b.ord left join sh on sh.oa = a.ord and sh.ob = b.ord left join en on en.oa = a.ord and en.ob = b.ord),
y as (select *, case when sa + sb - sh > 0 then sh / (sa + sb - sh)::double else 0e0 end as j, case when sh > 0 then idm / sh::double else 0e0 end as idc, case when en > 0 then es / en::double else 0e0 end as er, sa = sb and sh = sa and idm = sh as ex from z),
tp as (select model_a, family_a, model_b, family_b, family_a = family_b as same_family, ex as exact_token_to_id_same, sp as same_special_tokens, sa as vocab_size_a, sb as vocab_size_b, sh as shared_token_count, sa + sb - sh as union_token_count, j as token_jaccard, idm as id_match_count,
  sh - idm as id_mismatch_count, idc as id_consistency, sa - sh as only_a_count, sb - sh as only_b_count, es as encoding_same_count, en as encoding_sample_count, er as encoding_same_rate, round(0.45e0 * j + 0.35e0 * idc + 0.15e0 * er + case when sp then 0.05e0 else 0e0 end, 9) as tokenizer_similarity_score,
  case when ex and er = 1 then 'hard_equivalent' when j >= 0.995 and idc >= 0.995 and er >= 0.99 then 'near_equivalent' else 'distinct' end as equivalence_label from y),
edges as (select model_a as x, model_b as y from tp where same_family and equivalence_label <> 'distinct' union all select model_b, model_a from tp where same_family and equivalence_label <> 'distinct'),
reach as (select name, name as other from meta union select r.name, e.y from reach r join edges e on e.x = r.other),
lin as (select m.name, m.family, min(r.other) as lineage from meta m join reach r on r.name = m.name group by 1, 2)"""


def _lineage(spark, d):
    docs = _table(spark, d, "documents").select("source", "text")
    meta = spark.sql("with " + _META.replace("from documents", "from {docs}") + " select * from meta", docs=docs).persist()  # a row per model
    words = tables.spread(docs).select("source", F.explode(F.split("text", " ")).alias("token")).distinct()
    kept = (F.col("upto") == "") | (F.substring(F.md5(F.col("token").cast("binary")), 1, 2) > F.col("upto"))
    id_ = F.char_length("token") + F.when(F.col("special_tokens") == "t", 1).otherwise(0)
    vocab = words.join(meta, "source").where(kept).select(F.col("name").alias("model"), "token", id_.alias("id"))
    enc = meta.withColumn("sample", F.explode(F.array(*(F.lit(str(i)) for i in range(1, 5))))).select(F.col("name").alias("model"), "sample", F.concat_ws("|", "source", "sample").alias("ids"))
    return vocab, enc, meta


def _tokenizer_pairs(spark, d):
    vocab, enc, meta = _lineage(spark, d)
    return lineage.pairs(vocab, enc, meta).persist(), meta  # models squared, read more than once


@query(f"with {_TP} select * from tp".replace("with copies", "with recursive copies"))
def tokenizer_pairs(spark, d):
    return _tokenizer_pairs(spark, d)[0]


_LIN = f"with recursive {_TP}"


@query(f"{_LIN} select * from lin")
def lineage_components(spark, d):
    return lineage.components(*_tokenizer_pairs(spark, d))


@query(f"""{_LIN}, i as (select a.lineage, count(*) as pairs, round(avg(tokenizer_similarity_score), 9) as mean, min(tokenizer_similarity_score) as min, max(tokenizer_similarity_score) as max, count(*) filter (equivalence_label = 'hard_equivalent') as hard_equivalent,
  count(*) filter (equivalence_label = 'near_equivalent') as near_equivalent, count(*) filter (equivalence_label = 'distinct') as "distinct" from tp join lin a on a.name = model_a join lin b on b.name = model_b and a.lineage = b.lineage group by 1)
select l.lineage, l.family, count(*) as members, coalesce(any_value(pairs), 0) as pairs, coalesce(any_value(mean), 1e0) as mean, coalesce(any_value(min), 1e0) as min, coalesce(any_value(max), 1e0) as max, coalesce(any_value(hard_equivalent), 0) as hard_equivalent,
  coalesce(any_value(near_equivalent), 0) as near_equivalent, coalesce(any_value("distinct"), 0) as "distinct" from lin l left join i using (lineage) group by 1, 2""")
def lineage_metrics(spark, d):
    pairs, meta = _tokenizer_pairs(spark, d)
    return lineage.metrics(pairs, lineage.components(pairs, meta))


_REP = """, ins as (select model_a, model_b, tokenizer_similarity_score as s from tp join lin a on a.name = model_a join lin b on b.name = model_b and a.lineage = b.lineage),
av as (select name, round(avg(s), 9) as mean from (select model_a as name, s from ins union all select model_b, s from ins) group by 1),
pr as (select case when role = 'base' then 0 when role = 'instruct' then 1 when role = 'chat' then 2 else 3 end as prio, * from meta),
rp as (select l.family, l.lineage, l.name as representative, role, preferred_rank, prio from lin l join pr on pr.name = l.name left join av on av.name = l.name
  qualify row_number() over (partition by l.family, l.lineage order by coalesce(mean, 1) desc, prio, preferred_rank, l.name) = 1)"""


@query(f"{_LIN}{_REP} select family, lineage, representative, role, preferred_rank from rp")
def lineage_representative(spark, d):
    pairs, meta = _tokenizer_pairs(spark, d)
    return lineage.representatives(pairs, lineage.components(pairs, meta), meta)


_REGISTRY = f"""{_LIN}{_REP}, c as (select lineage, count(*) as members, string_agg(name, ',' order by name) as member_models from lin group by 1),
r as (select rp.*, members, member_models, row_number() over (partition by family order by members desc, prio, preferred_rank, representative) as rn from rp join c using (lineage))
select case when rn = 1 then lower(replace(family, ' ', '_')) || '__primary' else lower(replace(family, ' ', '_')) || '__variant_' || lpad((rn - 1)::varchar, 2, '0') end as baseline_id, family, case when rn = 1 then 'primary' else 'variant' end as kind, representative, members, member_models from r"""


@query(_REGISTRY)
def baseline_registry(spark, d):
    pairs, meta = _tokenizer_pairs(spark, d)
    return lineage.registry(pairs, lineage.components(pairs, meta), meta)


@query(_REGISTRY)
def registry_report(spark, d):
    """The registry as its report's JSON has it."""
    path = tables.scratch(spark)
    sinks.report({"baselines": baseline_registry(spark, d)}, path, "Tokenizer baselines")
    rows = spark.read.text(f"{path}/report.json", wholetext=True)
    kind = "baselines array<struct<baseline_id: string, family: string, kind: string, representative: string, members: bigint, member_models: string>>"
    return rows.select(F.explode(F.from_json("value", kind)["baselines"]).alias("b")).select("b.*")


@query("select text, count(*) as n from documents group by 1 having count(*) > 1")
def manifest_duplicates(spark, d):
    return lineage.duplicates(_table(spark, d, "documents"), "text")


# ---- probe construction -----------------------------------------------------------------------------------------

#: Languages that differ in nothing but name and category are cut in one pass.
_SPECS = {"latin": (probes.LANGUAGES["de"], ("de", "en", "es", "fr")), "arabic": (probes.LANGUAGES["ar"], ("ar",)), "han": (probes.LANGUAGES["zh"], ("zh",))}


def _docs(spark, d, normal: bool = False):
    docs = tables.spread(_table(spark, d, "documents")).select("doc_id", "lang", "text")
    return docs.withColumn("text", probes.normalize(F.col("text"))) if normal else docs


def _per_language(docs, f):
    """f(rows, spec) over the documents of each kind of language."""
    parts = [f(docs.where(F.col("lang").isin(*langs)), spec) for spec, langs in _SPECS.values()]
    return parts[0].union(parts[1]).union(parts[2])


def _category(lang):
    return F.create_map(*(F.lit(x) for k, v in probes.LANGUAGES.items() for x in (k, v.category)))[lang]


_SP = r"[\t\n\x0b\f\r ]"
_W = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NW = r"[^\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ONE = r"[\p{Latin}\p{M}]"
_LATIN_SPAN = rf"{_ONE}+(?:[’'-]{_ONE}+)*"
_BYLANG = lambda latin, arabic, han: f"case when lang in ('de', 'en', 'es', 'fr') then {latin} when lang = 'ar' then {arabic} when lang = 'zh' then {han} end"
# DuckDB has NFC only, which is the same where no compatibility character occurs, as in these tables.
_NORM = lambda c: f"regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(nfc_normalize({c}), chr(160), ' '), chr(8203), ''), chr(8204), ''), chr(8205), ''), '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f\\p{{Cf}}]+', ' ', 'g'), '[ \\t\\r\\f\\x0b]+', ' ', 'g'), {_q(T.STRIP)}, '', 'g')"
_FRAG = lambda source: f"""docs as ({source}), para as (select doc_id, lang, unnest(string_split_regex(text, '\\n+')) as p, generate_subscripts(string_split_regex(text, '\\n+'), 1) - 1 as paragraph from docs where lang in ('de', 'en', 'es', 'fr', 'ar', 'zh')),
cut as (select doc_id, lang, paragraph, string_split({_BYLANG(f"regexp_replace(p, '([.!?;:]){_SP}+', '\\1' || chr(1), 'g')", f"regexp_replace(p, '([.!?؟؛;:]){_SP}+', '\\1' || chr(1), 'g')", f"regexp_replace(p, '([。！？；：.!?;:]){_SP}*', '\\1' || chr(1), 'g')")}, chr(1)) as f from (select * replace (regexp_replace(p, {_q(T.STRIP)}, '', 'g') as p) from para)),
frag as (select doc_id, lang, paragraph::int as paragraph, (generate_subscripts(f, 1) - 1)::int as position, regexp_replace(unnest(f), '\\A[ \\t]+|[ \\t]+\\z', '', 'g') as fragment from cut), frags as (select * from frag where fragment <> '')"""  # noqa: E731
_USABLE = r"length(fragment) >= 12 and len(regexp_extract_all(fragment, 'https?://|www\.')) <= 1 and not regexp_matches(fragment, '[<>{}\[\]|]{3,}') and length(regexp_replace(fragment, '\P{Latin}', '', 'g')) >= 8 and length(regexp_replace(fragment, '\P{P}', '', 'g')) / greatest(1, length(fragment))::double <= 0.35e0"
_SPANS = lambda source: f"""arr as (select *, regexp_extract_all(fragment, {_q(_LATIN_SPAN)}) as s, string_split_regex(fragment, {_q(_LATIN_SPAN)}) as g from {source} where lang in ('de', 'en', 'es', 'fr')),
each as (select doc_id, lang, paragraph, position, fragment, unnest(s) as span, unnest(g[1:len(s)]) as gap, generate_subscripts(s, 1) as i from arr where len(s) > 0),
placed as (select *, (sum(length(gap) + length(span)) over (partition by doc_id, paragraph, position order by i) - length(span))::int as "offset" from each),
spans as (select *, left(fragment, "offset") as before from placed),
ctx as (select *, case when len(regexp_extract_all(before, '{_NW}+')) <= 6 then before else regexp_extract(before, '(?:{_NW}+{_W}+){{5}}{_NW}+{_W}*\\z') end as context from spans)"""  # noqa: E731


@query("with p as (select doc_id, unnest(string_split_regex(text, '\\n+')) as p, generate_subscripts(string_split_regex(text, '\\n+'), 1) - 1 as paragraph from documents) select doc_id, paragraph::int as paragraph, p as fragment from p where p <> ''")
def split_paragraphs(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", r"\n+")).alias("paragraph", "fragment"))
    return rows.where("fragment <> ''")


@query(f"with {_FRAG('select doc_id, lang, text from documents')} select doc_id, lang, paragraph, position, fragment from frags")
def split_fragments(spark, d):
    return _per_language(_docs(spark, d), lambda rows, spec: probes.fragments(rows, spec).drop("text"))


@query(f"select doc_id, {_USABLE.replace('fragment', 'text')} as usable from documents")
def usable_fragments(spark, d):
    return _docs(spark, d).select("doc_id", probes.usable(F.col("text"), _SPECS["latin"][0]).alias("usable"))


def _spans(spark, d):
    return _per_language(_docs(spark, d), lambda rows, spec: probes.spans(probes.fragments(rows, spec).drop("text"), spec))


@query(f"with {_FRAG('select doc_id, lang, text from documents')}, {_SPANS('frags')} select doc_id, paragraph, position, span, \"offset\" from placed")
def span_windows(spark, d):
    return _spans(spark, d).select("doc_id", "paragraph", "position", "span", "offset")


@query(f"with {_FRAG('select doc_id, lang, text from documents')}, {_SPANS('frags')} select doc_id, paragraph, position, \"offset\", context from ctx")
def left_context(spark, d):
    return _spans(spark, d).select("doc_id", "paragraph", "position", "offset", "context")


_CUTS = "(select *, unnest([0.55e0, 0.65e0, 0.75e0]) as ratio from {0})"


@query(f"with s as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{{8,}}')) as span from documents), r as (select span, ratio, greatest(4, least(length(span) - 1, cast(floor(length(span) * ratio) as int))) as cut from {_CUTS.format('s')}) select span, min(ratio) as ratio, cut::int as cut from r where cut < length(span) group by span, cut")
def cut_lengths(spark, d):
    s = _docs(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{8,})"), 1)).alias("span")).distinct()
    return probes.cuts(s, _SPECS["latin"][0])


@query(r"with s as (select distinct unnest(regexp_extract_all(text, '[\p{Latin}''-]+')) as span from documents) select span, regexp_replace(regexp_replace(left(span, 5), '[-''’]+\z', ''), '\p{M}+\z', '') as prefix from s")
def safe_prefix(spark, d):
    s = _docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{IsLatin}'-]+)"), 1)).alias("span")).distinct()
    return s.select("span", probes.prefix(F.col("span"), F.lit(5)).alias("prefix"))


_LATIN = lambda c: f"length(regexp_replace({c}, '\\P{{Latin}}', '', 'g'))"
_CAND = f"""{_FRAG(f"select doc_id, lang, {_NORM('text')} as text from documents")}, good as (select * from frags where {_USABLE}), {_SPANS('good')},
ok as (select * from ctx where {_LATIN('span')} between 8 and 40),
cuts as (select * exclude (cut), greatest(4, least(length(span) - 1, cast(floor(length(span) * ratio) as int))) as cut from (select *, 0 as cut from {_CUTS.format('ok')})),
once as (select doc_id, lang, paragraph, position, span, "offset", context, min(ratio) as ratio, cut::int as cut from cuts where cut < length(span) group by all),
pre as (select *, regexp_replace(regexp_replace(left(span, cut), '[-''’]+\\z', ''), '\\p{{M}}+\\z', '') as prefix from once),
txt as (select *, regexp_replace(context || prefix, {_q(T.STRIP)}, '', 'g') as probe_text, case lang when 'de' then 'german' when 'en' then 'english' when 'es' then 'spanish' else 'french' end || '_partial' as category from pre where {_LATIN('prefix')} >= 4 and regexp_matches(prefix, '\\p{{Latin}}\\z')),
cand as (select *, category || '_' || substr(sha1(category || chr(0) || probe_text), 1, 12) as probe_id from txt where length(probe_text) between 4 and 140 and regexp_matches(probe_text, '\\p{{Latin}}\\z'))"""


def _candidates(spark, d):
    return _per_language(_docs(spark, d, normal=True), lambda rows, spec: probes.candidates(rows, spec, category=_category(F.col("lang"))).drop("text"))


@query(f"with {_CAND} select doc_id, probe_id, probe_text, span, \"offset\", ratio, cut from cand")
def probe_candidates(spark, d):
    return _candidates(spark, d).select("doc_id", "probe_id", "probe_text", "span", "offset", "ratio", "cut")


@query(f"with {_CAND} select count(*) as candidates, count(distinct probe_text) as unique_texts, count(*) - count(distinct probe_text) as duplicates, max(doc_id) + 1 as rows_scanned from cand")
def candidate_stats(spark, d):
    return probes.candidate_stats(_candidates(spark, d), "doc_id")


@query(f"with {_CAND} select category, count(*) as n from cand group by 1")
def probe_category_counts(spark, d):
    return _candidates(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@query("select text, min(doc_id) as seq from documents group by 1 order by 2 limit 128")
def distinct_first_n(spark, d):
    return probes.distinct_first_n(_table(spark, d, "documents").select("text", F.col("doc_id").alias("seq")), 128)


_WEIGHTS = {"de": 1.0, "en": 5.0, "es": 0.5, "fr": 1.0}
_QUOTA = """w as (select * from (values ('de', 1e0, 0), ('en', 5e0, 1), ('es', 0.5e0, 2), ('fr', 1e0, 3)) v(category, weight, o)), c as (select count(*) as total from documents),
a as (select category, o, greatest(1, cast(floor(total * weight / (select sum(weight) from w)) as int)) as n from w, c), q as (select category, (n + case when o = 0 then greatest(0, (select total from c) - (select sum(n) from a)) else 0 end)::int as n from a)"""


@query(f"with {_QUOTA} select * from q")
def probe_allocation(spark, d):
    total = _table(spark, d, "documents").count()
    return spark.createDataFrame(list(probes.allocate(total, _WEIGHTS).items()), "category string, n int")


@query(f"""with {_QUOTA}, pool as (select distinct lang as category, text from documents), k as (select *, row_number() over (partition by category order by md5(text || '|42'), text) as k from pool),
s as (select category, count(*) as size from pool group by 1), p as (select category, unnest(range(0, n)) as i from q), pick as (select category, i, ('0x' || substr(md5(category || '|' || i || '|42'), 1, 8))::bigint % size + 1 as k from p join s using (category))
select category || '_' || substr(sha1(category || chr(0) || text), 1, 12) || '_' || row_number() over (partition by category, text order by i) as probe_id, category, text from pick join k using (category, k)""")
def probe_draw(spark, d):
    docs = _table(spark, d, "documents")
    pool = docs.select(F.col("lang").alias("category"), "text").distinct()
    return probes.draw(pool, docs.count(), _WEIGHTS, 42)


@query(f"select doc_id, {_NORM('text')} as text from documents")
def normalize_text(spark, d):
    return _docs(spark, d, normal=True).select("doc_id", "text")


@query("with u as (select text as probe_text, min(doc_id) as doc_id from documents group by 1) select doc_id, probe_text from u order by md5(probe_text || '|20260704'), probe_text limit 100")
def reservoir_sample(spark, d):
    rows = _table(spark, d, "documents").groupBy(F.col("text").alias("probe_text")).agg(F.min("doc_id").alias("doc_id"))
    return probes.sample(rows.select("doc_id", "probe_text"), 100, 20260704)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

"""The queries of this subpackage, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, html, importance, lines, mixing, packing, quality, sharding, simhash, substring, toxicity, urls, winnow
from .common import table


def word_tokenizer() -> str:
    """The vocabulary file that the packing query names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return x.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score", "predicted", "llr_per_word")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Host and path rules with their verdicts.
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES, threshold=0.5)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 24)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_line_dedup, op4_document_fingerprints, op5_url_filters, op6_simhash_near_dedup, op7_best_fit_packing, op8_source_mixing, op9_html_extraction, op10_substring_dedup, op11_importance_resampling, op12_sharding, op13_cross_tokenizer_alignment)}

ORACLE: dict[str, str] = {
    "op10_substring_dedup": r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents
), words as (select doc_id, unnest(w) word, unnest(range(len(w))) i from docs
), starts as (select doc_id, w, unnest(range(greatest(len(w) - 49, 0))) s from docs
), keyed as (select doc_id, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) k from starts
), least as (select k, min(doc_id) first from keyed group by k
), hits as (select doc_id, s from keyed join least using (k) where doc_id > first
), gone as (select distinct doc_id, unnest(range(s, s + 50)) i from hits
), kept as (
  select doc_id, count(g.i) n_removed, string_agg(word, ' ' order by i) filter (g.i is null) t
  from words left join gone g using (doc_id, i) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from docs d left join kept using (doc_id)
""",
    "op3_line_dedup": r"""
with docs as (select doc_id, text, string_split(text, chr(10)) ls from documents
), lines as (select doc_id, unnest(range(len(ls))) line_no, unnest(ls) line from docs where doc_id is not null and text is not null
), sets as (select doc_id, line_no, unnest(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) s from lines
), sizes as (select doc_id, line_no, count(*) n from sets group by all
), common as (
  select b.doc_id, b.line_no, a.doc_id a_doc, a.line_no a_line, count(*) c
  from sets a join sets b on a.s = b.s and (a.doc_id < b.doc_id or (a.doc_id = b.doc_id and a.line_no < b.line_no)) group by all
), gone as (
  select distinct c.doc_id, c.line_no from common c
  join sizes x on x.doc_id = c.doc_id and x.line_no = c.line_no join sizes y on y.doc_id = a_doc and y.line_no = a_line where 5 * c >= 4 * (x.n + y.n - c)
), kept as (
  select doc_id, string_agg(line, chr(10) order by line_no) filter (g.doc_id is null) t, count(g.doc_id) r
  from lines left join gone g using (doc_id, line_no) group by doc_id
)
select d.doc_id, case when text is not null then coalesce(t, case when k.doc_id is null then text else '' end) end text,
  coalesce(len(ls), 0) n_lines, coalesce(r, 0) n_lines_removed from docs d left join kept k using (doc_id)
""",
    "op8_source_mixing": r"""
with base as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size from documents
), units as (select doc_id, source, cast(sum(size) as bigint) size from base group by all
), sizes as (select source, cast(sum(size) as bigint) source_size from units group by all
), weighed as (
  select *, ([3.0::double, 1.0::double, 2.0::double])[1 + (row_number() over (order by source nulls last) - 1) % 3] weight, 2.0::double * source_size most from sizes
), filled as (
  select *, (1.5::double * sum(source_size) over ()
    - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
    / sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) lvl from weighed
), goals as (
  select source, source_size, least(most, max(lvl) over () * weight) target,
    ('0x' || substr(md5('0:' || case when source is null then 'null' else 'source ' || source end), 1, 8))::bigint::double / 4294967296.0::double u from filled
), ranked as (
  select d.*, source_size, target, u, case when source_size > 0 then target / source_size else 0.0::double end rate,
    row_number() over (partition by d.source order by d.size, d.doc_id) r
  from units d join goals g on d.source is not distinct from g.source
)
select doc_id, size, source_size, target, cast(floor(rate * r + u) - floor(rate * (r - 1) + u) as bigint) * size taken from ranked
""",
    # a CRC-32 goes byte by byte through a table that eight shifts of each number from 0 to 255 make
    "op11_importance_resampling": r"""
with recursive shifted as (select i b, i::bigint v, 0 k from range(256) r(i) union all
  select b, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from shifted where k < 8
), crcs as (select list(v order by b) t from shifted where k = 8
), texts as (select doc_id id, 0 target, coalesce(text, '') text from documents union all select null, 1, coalesce(text, '') from benchmark
), numbered as (select row_number() over () r, id, target, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from texts
), runs as (select r, target, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) f from numbered
), features as (select r, target, f, count(*) n from runs group by all
), bytes as (select f, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::bigint) x from (select distinct f from features)
), buckets as (select f, xor(list_reduce(list_prepend(4294967295::bigint, x), lambda c, y: xor(c >> 8, t[1 + xor(c & 255, y)])), 4294967295) % 10000 b from bytes, crcs
), totals as (select b, sum(n) filter (target = 0) s, sum(n) filter (target = 1) t from features join buckets using (f) group by b
), whole as (select coalesce(sum(s), 0)::double ss, coalesce(sum(t), 0)::double tt from totals
), gains as (select b, floor(1000 * ln((coalesce(t, 0)::double + 1) * (ss + 10000) / ((coalesce(s, 0)::double + 1) * (tt + 10000))))::bigint g from totals, whole
), weighed as (select r, sum(n)::bigint n, floor(sum(n * g) / sum(n)::double)::bigint weight from features join buckets using (f) join gains using (b) where target = 0 group by r
), scored as (
  select id doc_id, len(w) n_words, coalesce(n, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint score
  from numbered left join weighed using (r) where target = 0
), ranked as (select doc_id, row_number() over (order by score desc, doc_id) rank, count(*) over () n from scored where n_words >= 20)
select s.doc_id, n_features, weight, score, case when rank <= n * 25 // 100 then rank end rank from scored s left join ranked using (doc_id)
""",
    "op12_sharding": r"""
with recursive shifted as (select i b, i::bigint v, 0 k from range(256) r(i) union all
  select b, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from shifted where k < 8
), crcs as (select list(v order by b) t from shifted where k = 8
), docs as (select doc_id, encode(coalesce(text, '')) x, ('0x' || substr(md5('0:key ' || doc_id), 1, 16))::ubigint::hugeint h from documents
), sized as (
  select doc_id, h, octet_length(x) + 8 size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(x), '..'), lambda y: ('0x' || y)::bigint)), lambda c, y: xor(c >> 8, t[1 + xor(c & 255, y)])), 4294967295) text_crc32 from docs, crcs
), jumps as (
  select distinct h, h k, -1::bigint b, 0::bigint j from docs union all
  select h, (k * 2862933555777941757 + 1) % 18446744073709551616::hugeint, j,
    floor((j + 1) * (2147483648.0::double / (((k * 2862933555777941757 + 1) % 18446744073709551616::hugeint) // 8589934592 + 1)::double))::bigint from jumps where j < 25
), placed as (select h, max(b) filter (b < 24) shard, max(b) filter (b < 25) grown_shard from jumps group by h)
select doc_id, size, text_crc32, 'key' law, shard::int shard, row_number() over (partition by shard order by doc_id, size, text_crc32) - 1 slot, grown_shard::int grown_shard from sized join placed using (h)
""",
}
